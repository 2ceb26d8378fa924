"""Near-duplicate detection by circulant MinHash, with exact confirmation.

A text's set is its distinct shingles of five words.  Two permutations give all
signature coordinates: ``sigma`` places each shingle on a ring of 2**32 places,
and coordinate ``k`` is the smallest ``pi`` of the places turned by ``k``.
Bands of five coordinates (25 of them) make candidates: at a similarity of 0.85
a pair shares no band with probability 4e-7.  Links are confirmed on full sets.

* Equal sets form one class; only its representative goes on, so a group of
  thousands of copies costs one row.
* Each bucket of a band has a centre, the member that meets most others over all
  bands.  Members are compared with their centre, not with each other.
* Links between members that are not linked to their centre would be lost, so
  these members are compared, in blocks of bounded size, with all others of the
  same centre that ended in another component.  Only links leave a block.

Defined cases: null and blank texts have an empty set and are linked with
nothing; texts below five words have their whole sequence as one shingle; rows
that repeat an id are rows of their own; an empty table gives an empty result;
a null id is never a component's id unless all of its ids are null; other
columns are ignored, :func:`deduplicate` carries them along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.llm.common import bucketed, discard, materialize, process_cache, release, ship, text_or_empty
from depinfer.llm.components import connected_components

#: Words whose hashes one Python worker keeps.
CACHE_WORDS = 200_000
#: Members of a block when members of one centre are compared.
BLOCK = 64


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def _mix(a, b):
    import numpy as np

    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def _shingle_sets(texts: list[str], width: int) -> list:
    """Sorted distinct 64-bit shingle hashes of each text."""
    import numpy as np
    import xxhash

    hashes = process_cache("op9").setdefault("words", _Words())
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    words = [x.encode().lower().split() for x in texts]
    n = [len(w) for w in words]
    x = np.fromiter(map(hashes.__getitem__, (w for ws in words for w in ws)), np.uint64, sum(n))
    if len(x) >= width:
        s = x[: len(x) - width + 1]
        for i in range(1, width):
            s = _mix(s, x[i : len(x) - width + 1 + i])
    out, at = [], 0
    for ws, size in zip(words, n):
        if size >= width:
            v = np.sort(s[at : at + size - width + 1])
            out.append(v[np.concatenate([[True], v[1:] != v[:-1]])])
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=size)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += size
    return out


def _signatures(flat, starts, coordinates: int):
    """Circulant MinHash of the sets that lie one after another in ``flat``."""
    import numpy as np

    place = (_mix(flat, flat ^ np.uint64(0x94D049BB133111EB)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), coordinates), np.uint32)
    for k in range(coordinates):
        x = place + np.uint32(k)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _groups(texts: list[str], most: int = 400_000):
    """Ranges of texts with about ``most`` characters together."""
    at, held = 0, 0
    for i, x in enumerate(texts):
        held += len(x)
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


SIGNATURES = "key bigint, doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>"


def _sign_of(width: int, rows: int, bands: int):
    def sign(batches):
        import numpy as np
        import pyarrow as pa

        for batch in (x.slice(i, 2000) for x in batches for i in range(0, x.num_rows, 2000)):
            texts = batch.column("text").to_pylist()
            for a, b in _groups(texts):
                sets = _shingle_sets(texts[a:b], width)
                n = np.array([len(x) for x in sets], np.int64)
                some = np.flatnonzero(n)
                f1, f2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                lists = [None] * len(n)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    starts = np.cumsum(n[some]) - n[some]
                    f1[some] = np.add.reduceat(_mix(flat, flat ^ np.uint64(0xA5A5A5A5)), starts).view(np.int64)
                    f2[some] = np.add.reduceat(_mix(flat ^ np.uint64(0x5851F42D4C957F2D), flat), starts).view(np.int64)
                    x = _signatures(flat, starts, rows * bands).astype(np.uint64).reshape(len(some), bands, rows)
                    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(some), bands))
                    for r in range(rows):
                        h = _mix(h, x[:, :, r])
                    for i, v in zip(some, h.view(np.int64)):
                        lists[i] = v
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(f1), pa.array(f2), pa.array(lists, pa.list_(pa.int64()))],
                    names=["key", "doc_id", "n", "f1", "f2", "bands"],
                )

    return sign


def _sets_of(width: int):
    def sets(batches):
        import pyarrow as pa

        for batch in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            found = [x.tobytes() for x in _shingle_sets(batch.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.binary())], names=["rep", "shingles"])

    return sets


def _confirm_of(part: int, whole: int):
    def confirm(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b = [], []
            for x, y, s, t in zip(*(batch.column(c).to_pylist() for c in ("centre", "rep", "s", "t"))):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                if whole * both >= part * (len(s) + len(t) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return confirm


def _compare_of(part: int, whole: int):
    """Links between the left and the other members of one pair of blocks."""

    def compare(table):
        import numpy as np
        import pyarrow as pa

        left = np.array(table.column("side").to_pylist(), bool)
        rep, comp = (table.column(c).to_numpy() for c in ("rep", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(x) for x in sets])
        li, ri = np.flatnonzero(left), np.flatnonzero(~left)
        if not len(li) or not len(ri):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        right, owner = np.concatenate([sets[i] for i in ri]), np.repeat(np.arange(len(ri)), n[ri])
        order = np.argsort(right, kind="stable")
        right, owner = right[order], owner[order]
        both = np.zeros((len(li), len(ri)), np.int64)
        for k, i in enumerate(li):
            lo, hi = np.searchsorted(right, sets[i], "left"), np.searchsorted(right, sets[i], "right")
            size = hi - lo
            at = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
            both[k] = np.bincount(owner[at], minlength=len(ri))
        linked = (whole * both >= part * (n[li][:, None] + n[ri][None, :] - both)) & (comp[li][:, None] != comp[ri][None, :])
        k, m = np.nonzero(linked)
        return pa.table({"a": pa.array(rep[li[k]]), "b": pa.array(rep[ri[m]])})

    return compare


def _late_links(stars: DataFrame, sets: DataFrame, linked: DataFrame, part: int, whole: int) -> DataFrame:
    """Links of members that their centre does not reach, to members of the same centre in other components."""
    comp = linked.select(F.col("node").alias("rep"), "component")
    of_centre = linked.select(F.col("node").alias("centre"), F.col("component").alias("of_centre"))
    members = stars.join(comp, "rep", "left").join(of_centre, "centre", "left")
    members = members.select("centre", "rep", F.coalesce("component", "rep").alias("component"), F.coalesce("of_centre", "centre").alias("of_centre"))
    members = materialize(members.withColumn("left_out", F.expr("component <> of_centre")), "op9-members")
    sizes = members.groupBy("centre").agg(F.count("*").alias("n"), F.count_if("left_out").alias("n_left")).filter("n > 1 and n_left > 0")
    sizes = sizes.select("centre", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n_left") / BLOCK).cast("int").alias("left_blocks"))
    rows = members.join(materialize(sizes, "op9-sizes"), "centre").withColumn("at", F.xxhash64("rep"))
    left = rows.filter("left_out").select("centre", "rep", "component", F.expr("pmod(at, left_blocks)").cast("int").alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"), F.lit(True).alias("side"))
    other = rows.select("centre", "rep", "component", F.explode(F.expr("sequence(0, left_blocks - 1)")).alias("i"), F.expr("pmod(at, blocks)").cast("int").alias("j"), F.lit(False).alias("side"))
    return left.unionByName(other).join(sets, "rep").groupBy("centre", "i", "j").applyInArrow(_compare_of(part, whole), "a bigint, b bigint")


def near_duplicate_components(held: DataFrame, part: int = 85, whole: int = 100, width: int = 5, rows: int = 5, bands: int = 25) -> DataFrame:
    """``key, doc_id, n_shingles, component_id, first_key`` per row of ``held`` (key, doc_id, text).

    Two texts are linked if ``whole * |intersection| >= part * |union|``.
    """
    spark = held.sparkSession
    signed = materialize(held.select("key", "doc_id", "text").mapInArrow(_sign_of(width, rows, bands), SIGNATURES), "op9-signed")
    some = signed.filter("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key"))
    classes = some.groupBy("f1", "f2", "n").agg(F.min(F.struct("key", "bands")).alias("one"), least.alias("least"))
    classes = materialize(classes.select("f1", "f2", "n", F.col("one.key").alias("rep"), F.col("one.bands").alias("bands"), "least"), "op9-classes")
    banded = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    # What is joined back is written first, so that both sides are shuffled and the rows of a hot key can be split.
    shared = materialize(banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "op9-shared")
    met = materialize(banded.join(shared, "bucket"), "op9-met")
    weight = met.groupBy("rep").agg(F.sum("size").alias("weight"))
    buckets, met = met, materialize(met.join(weight, "rep"), "op9-weighed")
    centres = met.groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("c"), F.max("n").alias("most")).select("bucket", (-F.col("c.minus")).alias("centre"))
    centres = materialize(centres, "op9-centres")
    stars = materialize(met.join(centres, "bucket").filter("rep <> centre").select("centre", "rep").distinct(), "op9-stars")
    release(spark)
    needed = stars.select(F.col("rep").alias("key")).union(stars.select(F.col("centre").alias("key"))).distinct()
    sets = materialize(held.select("key", "text").join(needed.hint("shuffle_hash"), "key", "left_semi").mapInArrow(_sets_of(width), "rep bigint, shingles binary"), "op9-sets")
    pairs = stars.join(sets.withColumnRenamed("shingles", "t"), "rep").join(sets.select(F.col("rep").alias("centre"), F.col("shingles").alias("s")), "centre")
    links = materialize(pairs.filter(f"{whole} * least(length(s), length(t)) >= {part} * greatest(length(s), length(t))").mapInArrow(_confirm_of(part, whole), "a bigint, b bigint"), "op9-links")
    first = materialize(connected_components(links), "op9-first")
    late = materialize(_late_links(stars, sets, first, part, whole), "op9-late")
    linked = first
    if not late.isEmpty():
        linked = materialize(connected_components(late.union(first.select("node", "component"))), "op9-linked")
    release(spark)
    comp = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", "least", F.coalesce("component", "rep").alias("component"))
    of_comp = materialize(comp.groupBy("component").agg(F.min("least").alias("first")), "op9-of-comp")
    found = materialize(comp.join(of_comp, "component").select("f1", "f2", "n", F.col("first.doc_id").alias("component_id"), F.col("first.key").alias("first_key")), "op9-found")
    discard(classes, shared, buckets, met, centres, stars, sets, links, first, late, linked, of_comp)
    out = some.select("key", "doc_id", "n", "f1", "f2").join(found, ["f1", "f2", "n"], "left").select("key", "doc_id", "n", "component_id", "first_key")
    alone = signed.filter("n = 0").select("key", "doc_id", "n", F.col("doc_id").alias("component_id"), F.col("key").alias("first_key"))
    return out.unionByName(alone).withColumnRenamed("n", "n_shingles")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per document."""
    held = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("key")), "key", "op9-docs")
    return near_duplicate_components(held, **options).select("doc_id", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` of which one stays for each component: that with the smallest id."""
    key, columns = "__op9_key", docs.columns
    held = bucketed(docs.withColumn(key, F.monotonically_increasing_id()), key, "op9-docs")
    lean = held.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    stay = near_duplicate_components(lean, **options).filter("key = first_key").select(F.col("key").alias(key))
    return held.join(stay.hint("shuffle_hash"), key, "left_semi").select(*columns)


ship(__name__)
