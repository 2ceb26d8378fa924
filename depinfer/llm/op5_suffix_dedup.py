"""Removal of repeated byte strings by distributed prefix doubling.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else (same document included, matches never cross documents) is removed.

1. *Sparse start.*  Of each ``length``-byte window only the leftmost smallest
   name of ``k`` bytes counts (its anchor; names are 64-bit mixes, doubled from
   1 to ``k`` bytes in NumPy).  Equal windows have equal anchors at equal
   distances, so a window whose anchor is unique is unique.  Neighbouring windows
   with one anchor form a run; one row stands for about 70 windows.  Names only
   rule out here: no match is concluded from one.
2. Runs whose bytes, from the first window's start to the last one's end, are
   equal (128-bit digests of these bytes) are repeated as a whole.
3. *Prefix doubling.*  Runs that share an anchor but not all bytes are cut in
   blocks of 32, then 8, then 1 windows.  A block's core is what all its windows
   have in common: 169, 193, then 200 bytes for a length of 200.  A position's
   first name is the digest of its core; after that it is the pair of the rank of
   the core it grew from and the very bytes that have come on.  Spark groups the
   pairs, drops unique ones, sorts the others and gives them their position as
   new rank, until a core is unique or reaches ``length``.  A block whose hull
   (all bytes of its windows) is that of all blocks with its core ends early.

Only one representative of equal runs takes part in 3.  What goes back to the
documents are their *unique* runs and the blocks that were found in these, so a
passage that a third of all documents hold sends back nothing: a document loses
its runs with shared anchors, but for the unique ones.  No step gathers a key in
one task: equal runs of a slice of documents are counted there, groupings are
counts with map-side combine, joined back to their rows.

Defined cases: a null text is empty; texts below ``length`` bytes lose nothing;
rows that repeat an id are documents of their own (an internal row key, not the
id, identifies them); an empty table gives an empty result; other columns are
carried along by :func:`remove_repeats`, whatever their names, and ignored by
:func:`repeat_digests`.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.functions.storage import with_index
from depinfer.llm.common import bucketed, discard, materialize, release, ship, text_or_empty

BLOCKS = (32, 8, 1)
_SEGMENT = 1 << 16


def _mix(a, b):
    import numpy as np

    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _byte_names():
    import numpy as np

    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return _mix(x, x ^ np.uint64(0x5851F42D4C957F2D))


def _anchor_size(length: int) -> int:
    """Bytes of an anchor: a power of two, and part of the core of a block of the largest size."""
    return 1 << (min(32, max(2, length // 6), max(1, length + 1 - BLOCKS[0])).bit_length() - 1)


def _names(data, size: int):
    """Names of ``size`` bytes (a power of two) at each position."""
    x, h = _byte_names()[data], 1
    while h < size:
        x, h = _mix(x[:-h], x[h:]), 2 * h
    return x


def _digests(data, start, size):
    """128-bit digests of byte ranges, as two longs each."""
    import numpy as np

    view = memoryview(data)
    found = [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + size).tolist())]
    return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def _leftmost_min(v, w: int):
    """Position of the leftmost smallest value in each window of ``w``."""
    import numpy as np

    ix, have = np.arange(len(v), dtype=np.int32), 1
    while have < w:
        step = min(have, w - have)
        right = v[step:] < v[:-step]
        v, ix = np.where(right, v[step:], v[:-step]), np.where(right, ix[step:], ix[:-step])
        have += step
    return ix


def _text_bytes(column):
    """UTF-8 bytes of a string column without nulls, and its offsets."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held else np.empty(0, np.uint8)
    return data, offsets


RUNS = "key bigint, lo int, hi int, m int, anchor bigint"


def _runs_of(length: int):
    """Runs of each document: first and last window, position and name of the anchor."""
    k = _anchor_size(length)

    def runs(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            data, offsets = _text_bytes(batch.column("text"))
            keys, out = batch.column("key").to_numpy(), []
            for p0 in range(int(offsets[0]), int(offsets[-1]) - length + 1, _SEGMENT):
                p1 = min(p0 + _SEGMENT, int(offsets[-1]) - length + 1)
                anchors = _names(data[p0 : p1 + length - 1], k)
                ix = _leftmost_min(anchors, length - k + 1)
                i0, i1 = (int(np.searchsorted(offsets, p, "right")) - 1 for p in (p0, p1 - 1))
                doc = np.repeat(np.arange(i0, i1 + 1), np.diff(np.clip(offsets[i0 : i1 + 2], p0, p1)))
                p = np.flatnonzero(np.arange(p0, p1) + length <= offsets[doc + 1]).astype(np.int32)
                if not len(p):
                    continue
                m = ix[p]
                cut = np.flatnonzero((np.diff(m) != 0) | (np.diff(p) != 1)) + 1
                first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]) - 1
                lo, hi, m = p[first], p[last], m[first]
                at = p0 - offsets[doc[lo]]
                out.append((keys[doc[lo]], (lo + at).astype(np.int32), (hi + at).astype(np.int32), (m + at).astype(np.int32), anchors[m].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["key", "lo", "hi", "m", "anchor"])

    return runs


def _slices(batches, most: int = 1000):
    """``bytes, offsets, row of each part, parts, key of each part`` of the documents that have parts."""
    import pyarrow.compute as pc

    for batch in (x.slice(i, most) for x in batches for i in range(0, x.num_rows, most)):
        batch = batch.filter(batch.column("parts").is_valid())
        if batch.num_rows:
            data, offsets = _text_bytes(batch.column("text"))
            parts = batch.column("parts")
            row, held = pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(parts)
            yield data, offsets, row, held, batch.column("key").to_numpy()[row]


SHAPES = "anchor bigint, s1 bigint, s2 bigint, n bigint, key bigint, lo int, hi int, m int"


def _shapes_of(length: int):
    """The different runs of a slice of documents, by anchor and bytes: how many, and the first of them."""

    def shapes(batches):
        import numpy as np
        import pyarrow as pa

        for data, offsets, row, held, key in _slices(batches):
            lo, hi, m, anchor = (held.field(x).to_numpy() for x in ("lo", "hi", "m", "anchor"))
            shape = _digests(data, offsets[row] + lo, hi - lo + length)
            order = np.lexsort((lo, key, shape[:, 1], shape[:, 0], anchor))
            lo, hi, m, anchor, key, shape = (x[order] for x in (lo, hi, m, anchor, key, shape))
            new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(shape, axis=0) != 0).any(axis=1)])
            first = np.flatnonzero(new)
            n = np.diff(np.concatenate([first, [len(new)]])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[first], shape[first, 0], shape[first, 1], n, key[first], lo[first], hi[first], m[first])], names=["anchor", "s1", "s2", "n", "key", "lo", "hi", "m"])

    return shapes


BLOCK_ROWS = "key bigint, lo int, hi int, m int, need boolean, rank bigint, sub int, rest binary, h1 bigint, h2 bigint"


def _blocks_of(length: int, before: int | None, block: int):
    """Blocks of the windows in ``parts``, aligned by their distance from the anchor, with the pair that names their core.

    ``before`` is the size of the blocks that the parts are, None for runs.
    """

    def cut(data, start, held, key):
        import numpy as np
        import pyarrow as pa

        lo, hi, m = (held.field(x).to_numpy().astype(np.int64) for x in ("lo", "hi", "m"))
        need, rank = held.field("need").to_numpy(zero_copy_only=False), held.field("rank").to_numpy()
        far, near = (m - lo) // block, (m - hi) // block
        n = far - near + 1
        row = np.repeat(np.arange(len(n)), n)
        q = near[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        lo, hi, m, start = lo[row], hi[row], m[row], start[row]
        first, last = np.maximum(lo, m - q * block - block + 1), np.minimum(hi, m - q * block)
        core, sub = start + m - q * block, np.zeros(len(row), np.int64)
        if before is None:
            size, rest = 16, _digests(data, core, np.full(len(row), length + 1 - block))
        else:
            # What the core has more than the one it grew from: ``sub`` bytes before that and the others behind it.
            sub, size = q * block - (m - lo) // before * before, before - block
            more = np.arange(size)
            rest = data[core[:, None] + more + np.where(more < sub[:, None], 0, length + 1 - before)]
        offsets = pa.py_buffer((np.arange(len(row) + 1) * size).astype(np.int32))
        rest = pa.Array.from_buffers(pa.binary(), len(row), [None, offsets, pa.py_buffer(np.ascontiguousarray(rest))])
        hull = _digests(data, start + first, last - first + length) if block > 1 else np.zeros((len(row), 2), np.int64)
        whole = [pa.array(key[row]), *(pa.array(x.astype(np.int32)) for x in (first, last, m)), pa.array(need[row]), pa.array(rank[row]), pa.array(sub.astype(np.int32)), rest, pa.array(hull[:, 0]), pa.array(hull[:, 1])]
        return pa.RecordBatch.from_arrays(whole, names=["key", "lo", "hi", "m", "need", "rank", "sub", "rest", "h1", "h2"])

    def blocks(batches):
        import numpy as np

        for data, offsets, row, held, key in _slices(batches):
            windows = held.field("hi").to_numpy().astype(np.int64) - held.field("lo").to_numpy() + length
            group = np.cumsum(windows) >> 19
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(edges[:-1], edges[1:]):
                yield cut(data, offsets[row[a:b]], held.slice(a, b - a), key[a:b])

    return blocks


def _by_document(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("parts"))


def _with_parts(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """Documents with their parts; texts without parts are left out, so Python gets only what it needs."""
    joined = docs.select("key", "text").join(parts.hint("shuffle_hash"), "key", "left")
    return joined.select("key", F.when(F.col("parts").isNotNull(), F.col("text")).otherwise("").alias("text"), "parts")


def repeated_windows(docs: DataFrame, length: int = 200) -> DataFrame:
    """``key, run_lo, run_hi, lo, hi, found`` for each document that shares an anchor.

    All arrays: the windows of its runs (first bytes), and marks.  A mark that is
    not ``found`` names a run, by its ``lo``, that is unique as a whole; one that is
    found is a block of such a run that occurs elsewhere too.  All windows of the
    other runs occur elsewhere too.

    ``docs`` has a unique ``key`` and a ``text`` without nulls, best bucketed by key.
    """
    spark = docs.sparkSession
    runs = materialize(docs.select("key", "text").mapInArrow(_runs_of(length), RUNS), "op5-runs")
    # Written before it is joined, so that both sides of the join are shuffled and a hot anchor's rows can be split.
    again = materialize(runs.groupBy("anchor").count().filter("count > 1").select("anchor"), "op5-again")
    mine = materialize(_by_document(runs.join(again, "anchor", "left_semi"), "lo", "hi", "m", "anchor"), "op5-mine")
    discard(runs, again)
    release(spark)
    local = materialize(_with_parts(docs, mine).mapInArrow(_shapes_of(length), SHAPES), "op5-local")
    shapes = local.groupBy("anchor", "s1", "s2").agg(F.sum("n").alias("n"), F.min(F.struct("key", "lo", "hi", "m")).alias("one"))
    shapes = materialize(shapes, "op5-shapes")
    discard(local)
    several = materialize(shapes.groupBy("anchor").count().filter("count > 1").select("anchor"), "op5-several")
    marks = shapes.filter("n = 1").select("one.key", "one.lo", "one.hi", F.lit(False).alias("found"))
    todo = shapes.join(several, "anchor", "left_semi").select("one.*", (F.col("n") == 1).alias("need"), F.lit(0).cast("long").alias("rank"))
    done = [shapes, several]
    for before, block in zip((None, *BLOCKS), BLOCKS):
        parts = _by_document(todo, "lo", "hi", "m", "need", "rank")
        blocks = materialize(_with_parts(docs, parts).mapInArrow(_blocks_of(length, before, block), BLOCK_ROWS), f"op5-blocks{block}")
        pairs = blocks.groupBy("rank", "sub", "rest").agg(F.count("*").alias("n"), F.expr("min(h1) = max(h1) and min(h2) = max(h2)").alias("same"))
        pairs = materialize(pairs.filter("n > 1").drop("n"), f"op5-pairs{block}")
        ranked = materialize(with_index(pairs, "rank", "sub", "rest", name="next"), f"op5-ranked{block}") if block > 1 else pairs.withColumn("next", F.lit(0).cast("long"))
        shared = materialize(blocks.join(ranked, ["rank", "sub", "rest"]).select("key", "lo", "hi", "m", "need", "same", "next"), f"op5-shared{block}")
        marks = marks.unionByName(shared.filter("same and need").select("key", "lo", "hi", F.lit(True).alias("found")))
        todo = shared.filter("not same").select("key", "lo", "hi", "m", "need", F.col("next").alias("rank"))
        done += [blocks, pairs, ranked, shared]
        release(spark)
    marks = materialize(_by_document(marks, "lo", "hi", "found").select("key", *(F.col(f"parts.{c}").alias(c) for c in ("lo", "hi", "found"))), "op5-marks")
    discard(*done)
    return mine.select("key", F.col("parts.lo").alias("run_lo"), F.col("parts.hi").alias("run_hi")).join(marks, "key", "left")


PARTS = ("run_lo", "run_hi", "lo", "hi", "found")


def _spans(run_lo, run_hi, lo, hi, found, length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges that the repeated windows cover."""
    unique = {a for a, f in zip(lo or (), found or ()) if not f}
    windows = [(a, b) for a, b in zip(run_lo or (), run_hi or ()) if a not in unique]
    windows += [(a, b) for a, b, f in zip(lo or (), hi or (), found or ()) if f]
    spans: list[tuple[int, int]] = []
    for a, b in sorted(windows):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b + length))
        else:
            spans.append((a, b + length))
    return spans


def _kept(data: bytes, spans) -> bytes:
    out, at = [], 0
    for lo, hi in spans:
        out.append(data[at:lo])
        at = hi
    return b"".join([*out, data[at:]])


DIGESTS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _digest_of(length: int):
    def digest(batches):
        import pyarrow as pa

        for batch in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            rows = []
            for doc_id, text, *parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", *PARTS))):
                data = text.encode()
                spans = _spans(*parts, length)
                rows.append((doc_id, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_kept(data, spans)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return digest


def _strip_of(length: int, at: int):
    """The columns but for the last ones, the parts; that at ``at`` is the text."""

    def strip(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.num_columns - len(PARTS)
            texts = batch.column(at).to_pylist()
            for i, parts in enumerate(zip(*(batch.column(n + j).to_pylist() for j in range(len(PARTS))))):
                if spans := _spans(*parts, length):
                    texts[i] = _kept(texts[i].encode(), spans).decode("utf-8", "ignore")
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(n)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n])

    return strip


def repeat_digests(docs: DataFrame, length: int = 200) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per document."""
    held = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("key")), "key", "op5-docs")
    parts = repeated_windows(held, length)
    return held.join(parts.hint("shuffle_hash"), "key", "left").select("doc_id", "text", *PARTS).mapInArrow(_digest_of(length), DIGESTS)


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the repeated strings removed from ``text``; a character cut in the middle goes as a whole.

    ``n_chars``, where present, becomes the length of the new text.
    """
    key, columns = "__op5_key", docs.columns
    held = bucketed(docs.withColumn(key, F.monotonically_increasing_id()), key, "op5-docs")
    lean = held.select(F.col(key).alias("key"), text_or_empty().alias("text"))
    parts = repeated_windows(lean, length)
    parts = parts.select(F.col("key").alias(key), *(F.col(c).alias(f"__op5_{c}") for c in PARTS))
    joined = held.join(parts.hint("shuffle_hash"), key, "left").select(*columns, *(f"__op5_{c}" for c in PARTS))
    out = joined.mapInArrow(_strip_of(length, columns.index("text")), docs.schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


ship(__name__)
