"""Cutting lineage and numbering rows."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def work_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine, else an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="depinfer-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared work folder and go on from there.

    A written table, unlike a checkpoint, also brings its true size, so that the
    estimates of iterated plans don't multiply.
    """
    path = f"{work_folder(df.sparkSession)}/cut-{uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what :func:`cut` has written for these frames; nothing that is still to run may read them."""
    for x in frames:
        if path := getattr(x, "work_path", None):
            jpath = x.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(x.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop the shuffle files of finished steps now, not at some later collection."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_index(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Number rows from 0 in the given order (which must be total).

    Rows are range-partitioned and numbered within their range; only the count
    of each range is summed up, so no task sees all rows.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    within = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1)
    counts = ranged.groupBy("__range").count()
    before = counts.select("__range", (F.sum("count").over(Window.orderBy("__range")) - F.col("count")).alias("__before"))
    # One row for each range: at most the number of shuffle partitions.
    return within.join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__range", "__at", "__before")


def running_sum(df: DataFrame, value: str, *order: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before in the given order (which must be total); no task sees all rows."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))
    within = ranged.withColumn("__at", F.sum(value).over(Window.partitionBy("__range").orderBy(*order)) - F.col(value))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    ahead = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__ahead"))
    # One row for each range: at most the number of shuffle partitions.
    return within.join(F.broadcast(ahead), "__range").withColumn(name, F.col("__at") + F.col("__ahead")).drop("__range", "__at", "__ahead")
