"""Reading and writing node tables and adjacency lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from depinfer.functions.storage import cut, running_sum

#: Splits of files up to which their counts are broadcast.
BROADCAST_SPLITS = 50_000


def read_adjlist(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of lines ``u v1 v2 ...``; ``#`` starts a comment, a lone ``u`` is an isolate."""
    text = spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("line")).filter("line <> ''")
    lists = text.select(F.transform(F.split("line", r"\s+"), lambda x: x.cast("long")).alias("ids"))
    nodes = lists.select(F.explode("ids").alias("id")).distinct()
    pairs = lists.select(F.col("ids")[0].alias("u"), F.explode(F.slice("ids", F.lit(2), F.size("ids"))).alias("v"))
    return nodes, pairs.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).distinct()


def write_adjlist(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One line per node: its id and the larger ends of its edges."""
    pairs = edges.select(F.least("src", "dst").alias("id"), F.greatest("src", "dst").alias("v"))
    lists = pairs.groupBy("id").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    rows = nodes.select("id").join(lists, "id", "left").select(F.concat_ws(" ", F.concat(F.array("id"), F.coalesce("vs", F.array().cast("array<bigint>"))).cast("array<string>")).alias("value"))
    rows.write.text(path)


def read_node_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV with a header; the position of a row, by file name and place in the file, becomes its ``id``.

    Rows are counted by split of a file and numbered within it.
    """
    rows = spark.read.csv(path, header=True, schema=schema)
    names = rows.columns
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__row"))
    placed = cut(placed)
    splits = placed.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    splits = running_sum(splits, "__n", "__file", "__start", name="__before")
    splits = cut(splits.drop("__n"))
    # Some ten megabytes at most; rows then stay where and as they were read.
    small = splits.count() <= BROADCAST_SPLITS
    joined = placed.join(F.broadcast(splits) if small else splits, ["__file", "__start"])
    return joined.select((F.col("__before") + F.col("__row") - F.col("__first")).alias("id"), *names)


def write_node_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)
