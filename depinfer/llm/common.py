"""Shared plumbing: written intermediates and their removal, code shipping."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depinfer.functions.storage import work_folder


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


#: ``(path, table)`` of what has been written and not removed yet, in order; the table is None for plain files.
_written: list[tuple[str, str | None]] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append((path, None))
    return path


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read and not a recomputation.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`materialize` has written for these frames; nothing that is still to run may read them."""
    for x in frames:
        if path := getattr(x, "work_path", None):
            _remove(x.sparkSession, path)
            _written[:] = [w for w in _written if w[0] != path]


def mark() -> int:
    """A point in time for :func:`sweep`."""
    return len(_written)


def sweep(spark: SparkSession, since: int, keep: tuple[str, ...] = ()) -> None:
    """Delete the work files and tables written since ``since`` but for the paths in ``keep``: once the results are written."""
    for path, table_name in _written[since:]:
        if path not in keep:
            if table_name:
                spark.sql(f"DROP TABLE IF EXISTS {table_name}")
            _remove(spark, path)
    _written[since:] = [w for w in _written[since:] if w[0] in keep]


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of finished steps now, not at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write ``df`` once, hash-partitioned by ``key``; later joins on ``key`` then move only their other side."""
    spark, n = df.sparkSession, shuffle_partitions(df.sparkSession)
    path = work_dir(spark, name)
    table_name = "depinfer_" + path.rsplit("/", 1)[1].replace("-", "_")
    _written[-1] = (path, table_name)
    df.repartition(n, key).write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, key).saveAsTable(table_name)
    release(spark)
    return spark.table(table_name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def process_cache(name: str) -> dict:
    """A dictionary that lives in the Python worker process until another operator asks for its own."""
    module = sys.modules.setdefault("_depinfer_process_cache", types.ModuleType("_depinfer_process_cache"))
    held = module.__dict__.setdefault("held", {})
    if name not in held:
        held.clear()
        held[name] = {}
    return held[name]


def give_back() -> None:
    """Return freed memory of this Python worker to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


ship(__name__)
