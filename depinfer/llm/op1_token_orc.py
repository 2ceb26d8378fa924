"""Token-id output as ORC.

Documents are range-partitioned by id, encoded, and written as ORC in ascending
id order: one list column of 32-bit ids (ORC's integer run-length encoding),
row indexes, and Bloom filters on ``doc_id``.  Readers take stripes in parallel
and prune them by the indexes' minima and maxima and by the Bloom filters.  How
many ids lie before each file is written beside the files (``<path>.starts``), so
to look up a document reads no other one.

Defined cases: a null text is empty and yields the end id alone; a null
``doc_id`` sorts first; rows with equal ids are ordered by a hash of their text
(equal rows are interchangeable); an empty table gives files without rows;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from depinfer.llm.common import ship, shuffle_partitions, text_or_empty
from depinfer.llm.tokens import broadcast_tokenizer, default_tokenizer, encoder

BROADCAST_FILES = 1_000_000
FILE_SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids array<int>"


def _encoder_of(tokenizer, end_id: int):
    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in enc.slices(batches):
            ends, ids = enc.encode(batch.column("text"), end_id)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(start + ends[:-1]), pa.array(np.diff(ends)), lists],
                names=["doc_id", "part", "part_start", "n_tokens", "ids"],
            )
            start += int(ends[-1])

    return encode


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2, partitions: int | None = None, stripe_bytes: int = 64 << 20, index_stride: int = 10_000, bloom_fpp: float = 0.01) -> None:
    """Write ``docs`` (doc_id, text) as ORC files of token ids below ``path``."""
    spark = docs.sparkSession
    tokenizer = broadcast_tokenizer(spark, tokenizer_path or default_tokenizer())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # Equal rows are told apart by where they were read, so that no range has to hold all of them.
    rows = rows.withColumn("__tie", F.xxhash64("text")).withColumn("__row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("__tie"), F.col("__row")]
    ordered = rows.repartitionByRange(partitions or shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    (
        ordered.mapInArrow(_encoder_of(tokenizer, end_id), FILE_SCHEMA)
        .write.format("orc")
        .options(**{"orc.create.index": "true", "orc.row.index.stride": str(index_stride), "orc.stripe.size": str(stripe_bytes), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(bloom_fpp), "compression": "snappy"})
        .save(path)
    )
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("total"))
    totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before")).write.parquet(f"{path}.starts")


def read_token_orc(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``start`` counts the ids of all documents before.

    The starts have one row for each written file; they are broadcast up to
    ``BROADCAST_FILES`` of them.
    """
    files, before = spark.read.schema(FILE_SCHEMA).orc(path), spark.read.parquet(f"{path}.starts")
    small = before.count() <= BROADCAST_FILES
    return files.join(F.broadcast(before) if small else before, "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _digest(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("ids")
        offsets, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what :func:`read_token_orc` gives."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


ship(__name__)
