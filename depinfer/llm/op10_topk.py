"""Exact top-k inner-product search on a bit-sliced index.

Components become integers ``floor(scale * x)``.  Rows lie in blocks; a block
keeps, per dimension, one bitmap over its rows for each bit of the (shifted)
component.  For a query, each set bit of each of its components selects slices
of a weight; carry-save adders on bitmaps add all slices of a weight, from the
lightest up, which gives the slices of every row's score at once.  A negative
query component takes the complements.  The top rows are then selected from the
most significant slice downward; rows that tie at the boundary are resolved by
their id, and the scores are read off the slices, so the result is exact.

Queries go to the row blocks (a stated query set against all rows), one after
another past a block that a task holds, so a block moves once; only where there
are fewer blocks than tasks it moves to several, and the queries are dealt out.
Blocks are bounded, whatever the table's size, and only ``k`` rows per query and
block leave a task.

Defined cases: vectors that are null, or hold a null or non-finite component,
take no part; a vector that is shorter than others counts as filled with zeros;
a row is never its own result, but rows that repeat its id are candidates; a
null ``vec_id`` is no query and loses ties; an empty table gives an empty
result; other columns are ignored.  Rows with a component of ``WIDE`` or more (as
integer) are not indexed but compared, by Python's integers; a score beyond the
range of a long is given as the end of that range, and ties there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depinfer.llm.common import materialize, ship, shuffle_partitions

BLOCK_ROWS = 65_536
#: Below it, products of up to 4,096 components stay within 62 bits.
WIDE = 1 << 25


def _matrix(lists, scale: int):
    import numpy as np

    n = np.diff(lists.offsets.to_numpy())
    d = int(n.max()) if len(n) else 0
    values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    if len(n) and (n == d).all():
        return values.reshape(len(n), d)
    out = np.zeros((len(n), d), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)] = values
    return out


def _packed(bits):
    """Bitmaps over the rows, as 64-bit words: (rows, ...) -> (..., words)."""
    import numpy as np

    bits = np.moveaxis(bits, 0, -1)
    pad = -bits.shape[-1] % 64
    bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), bits.dtype)], axis=-1)
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def _index_of(scale: int):
    def index(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("no_id", "ascending"), ("vec_id", "ascending"), ("key", "ascending")])
        v = _matrix(table.column("embedding").combine_chunks(), scale)
        low = v.min(axis=0)
        u = (v - low).astype(np.uint64)
        bits = max(int(u.max()).bit_length(), 1) if u.size else 1
        slices = np.stack([_packed(((u >> np.uint64(j)) & np.uint64(1)).astype(np.uint8)) for j in range(bits)], axis=1)
        ids = table.column("vec_id").combine_chunks()
        return pa.table(
            {
                "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
                "bits": pa.array([bits], pa.int32()),
                "low": pa.array([low.tolist()], pa.list_(pa.int64())),
                "slices": pa.array([slices.tobytes()], pa.large_binary()).cast(pa.binary()),
                "vec_ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                "keys": pa.array([table.column("key").to_pylist()], pa.list_(pa.int64())),
            }
        )

    return index


INDEX = "block int, bits int, low array<bigint>, slices binary, vec_ids array<bigint>, keys array<bigint>"


def _scores(query, slices, full):
    """Score slices (lightest first) of all rows, without the constant of the shifted components."""
    import numpy as np

    size, bits, words = slices.shape
    weights: dict[int, list] = {}
    q = np.abs(query)
    negative = query < 0
    for i in range(int(q.max()).bit_length() if len(q) else 0):
        set_ = ((q >> i) & 1).astype(bool)
        plus, minus = slices[set_ & ~negative], slices[set_ & negative]
        for j in range(bits):
            held = weights.setdefault(i + j, [])
            if len(plus):
                held.append(plus[:, j])
            if len(minus):
                held.append(minus[:, j] ^ full)
    out, w = [], 0
    while weights:
        held = weights.pop(w, [])
        x = np.concatenate(held) if held else np.empty((0, words), np.uint64)
        while len(x) > 1:
            n = len(x) // 3
            if n:
                a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
                half = a ^ b
                weights.setdefault(w + 1, []).append((a & b) | (c & half))
                x = np.concatenate([half ^ c, x[3 * n :]]) if len(x) > 3 * n else half ^ c
            else:
                weights.setdefault(w + 1, []).append((x[:1] & x[1:]))
                x = x[:1] ^ x[1:]
        out.append(x[0] if len(x) else np.zeros(words, np.uint64))
        w += 1
    return out


def _positions(bitmap):
    import numpy as np

    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _select(score, alive, k: int):
    """Positions of the ``k`` largest among ``alive``, ties to smaller positions."""
    import numpy as np

    sure, maybe = np.zeros_like(alive), alive
    for s in reversed(score):
        high = maybe & s
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            maybe = high
        else:
            sure, maybe = sure | high, maybe & ~s
            if n == k:
                return _positions(sure)
    found = _positions(sure)
    return np.concatenate([found, _positions(maybe)[: k - len(found)]])


def _search_of(scale: int, k: int):
    """Rows in order: a block's index, then the queries that go past it."""

    def search(batches):
        import numpy as np
        import pyarrow as pa

        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        for batch in batches:
            kinds, out = batch.column("kind").to_pylist(), []
            asked = batch.column("embedding")
            for r, kind in enumerate(kinds):
                if not kind:
                    ids, keys, low = (batch.column(c)[r].values for c in ("vec_ids", "keys", "low"))
                    keys, low, bits, n = keys.to_numpy(), low.to_numpy(), batch.column("bits")[r].as_py(), len(ids)
                    words = -(-n // 64)
                    # Copied: the block outlives its batch.
                    slices = np.frombuffer(batch.column("slices")[r].as_py(), np.uint64).reshape(len(low), bits, words)
                    rows = np.packbits(np.concatenate([np.ones(n, np.uint8), np.zeros(words * 64 - n, np.uint8)]), bitorder="little").view(np.uint64)
                    at = {int(x): i for i, x in enumerate(keys)}
                    continue
                q_id, q_key, query = batch.column("vec_id")[r].as_py(), batch.column("key")[r].as_py(), _matrix(asked.slice(r, 1), scale)[0]
                q = np.zeros(len(low), np.int64)
                q[: min(len(q), len(query))] = query[: len(q)]
                score, alive = _scores(q, slices, full), rows.copy()
                own = at.get(q_key)
                if own is not None:
                    alive[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
                found = _select(score, alive, k)
                if not len(found):
                    continue
                value = np.full(len(found), int(q @ low) - int(np.abs(q[q < 0]).sum()) * ((1 << bits) - 1), np.int64)
                for w, x in enumerate(score):
                    value += ((x[found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << w
                out.append((np.full(len(found), q_key), np.full(len(found), q_id), ids.take(pa.array(found)), keys[found], value))
            if out:
                q_key, q_id, vec_id, key, value = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q_key)), pa.array(np.concatenate(q_id)), pa.concat_arrays(vec_id), pa.array(np.concatenate(key)), pa.array(np.concatenate(value))], names=["q_key", "query_id", "vec_id", "key", "score"])

    return search


def _integers(vector: list[float], scale: int) -> list[int]:
    """Components of any size; a product that overflows a double is taken exactly."""
    from fractions import Fraction
    from math import floor, isinf

    return [floor(Fraction(x) * scale) if isinf(scale * x) else floor(scale * x) for x in vector]


def _compare_of(scale: int, k: int):
    """The best ``k`` of a block of rows for each of a block of queries, by plain products of integers of any size."""

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            for block, queries in zip(batch.column("v").to_pylist(), batch.column("q").to_pylist()):
                rows = [(x["vec_id"], x["key"], _integers(x["embedding"], scale)) for x in block]
                out = []
                for x in queries:
                    q = _integers(x["embedding"], scale)
                    scored = ((max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), i, key) for i, key, v in rows if key != x["key"])
                    found = sorted((-s, i is None, i or 0, key) for s, i, key in scored)[:k]
                    out += [(x["key"], x["vec_id"], None if none else i, key, -s) for s, none, i, key in found]
                columns = zip(*out) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q_key", "query_id", "vec_id", "key", "score"])

    return compare


FOUND = "q_key bigint, query_id bigint, vec_id bigint, key bigint, score bigint"


def _compared(queries: DataFrame, rows: DataFrame, scale: int, k: int, block: int = 512) -> DataFrame:
    """``FOUND`` for all queries against all rows, block by block."""
    packed = lambda df, size, name: df.groupBy(F.expr(f"cast(pmod(xxhash64(key), {size}) as int)").alias(f"{name}_block")).agg(F.collect_list(F.struct("vec_id", "key", "embedding")).alias(name))
    blocks = [max(1, -(-df.count() // block)) for df in (queries, rows)]
    asked = packed(queries, blocks[0], "q").withColumn("v_block", F.explode(F.expr(f"sequence(0, {blocks[1] - 1})")))
    return asked.join(packed(rows, blocks[1], "v"), "v_block").select("q", "v").mapInArrow(_compare_of(scale, k), FOUND)


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, block_rows: int = BLOCK_ROWS, tasks: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of all other rows for each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.monotonically_increasing_id().alias("key"))
    good = rows.filter("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    wide = F.coalesce(F.expr(f"exists(embedding, x -> abs(x) >= {WIDE / scale}D)"), F.lit(False))
    good = materialize(good.withColumns({"no_id": F.col("vec_id").isNull(), "wide": wide}), "op10-vectors")
    asks = F.col("vec_id") % every == 0
    narrow = good.filter("not wide")
    counts = good.agg(F.count_if(~F.col("wide")).alias("n"), F.count_if("wide").alias("wide")).first()
    blocks = max(1, -(-counts["n"] // block_rows))
    # Hashed blocks are uneven by a few hundredths only; their number follows the rows, so their size is bounded.
    index = materialize(narrow.withColumn("block", F.expr(f"cast(pmod(xxhash64(key), {blocks}) as int)")).groupBy("block").applyInArrow(_index_of(scale), INDEX), "op10-index")
    copies = max(1, -(-(tasks or min(2 * spark.sparkContext.defaultParallelism, shuffle_partitions(spark))) // blocks))
    held = index.select("*", F.explode(F.expr(f"sequence(0, {copies - 1})")).alias("copy"), F.lit(0).alias("kind"))
    asked = narrow.filter(asks).select("vec_id", "key", "embedding", F.expr(f"cast(pmod(xxhash64(key, 'q'), {copies}) as int)").alias("copy"), F.lit(1).alias("kind"), F.explode(F.expr(f"sequence(0, {blocks - 1})")).alias("block"))
    stream = held.unionByName(asked, allowMissingColumns=True).repartition(min(blocks * copies, 2000), "block", "copy").sortWithinPartitions("block", "copy", "kind")
    found = stream.mapInArrow(_search_of(scale, k), FOUND)
    if counts["wide"]:
        found = found.unionByName(_compared(good.filter(asks), good.filter("wide"), scale, k)).unionByName(_compared(good.filter(asks & F.col("wide")), narrow, scale, k))
    place = F.row_number().over(Window.partitionBy("q_key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "key"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ship(__name__)
