"""Summary statistics of a network, in long format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.functions.storage import cut
from depinfer.operators import graph as G


def average_path(nodes: DataFrame, edges: DataFrame, labelled: DataFrame | None = None) -> tuple[float, int, int]:
    """``(average path length, diameter, size)`` of the giant component; ``labelled`` has the components, if known."""
    inside = cut(G.giant(G.components(nodes, edges) if labelled is None else labelled))
    row = G.path_lengths(inside, G.induced(edges, inside)).agg(F.sum("total").alias("t"), F.max("furthest").alias("d"), F.count("*").alias("n")).first()
    n = row["n"]
    return (row["t"] / (n * (n - 1)) if n > 1 else float("nan")), int(row["d"] or 0), n


def sumstats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``stat, value``: units, links, degrees, isolates, giant, paths, components, clustering."""
    spark = nodes.sparkSession
    both = G.symmetrise(edges).filter("src <> dst")
    deg = G.degrees(nodes, both).agg(F.count("*").alias("n"), F.sum("degree").alias("s"), F.max("degree").alias("m"), F.count_if(F.col("degree") == 0).alias("z")).first()
    labelled = cut(G.components(nodes, edges))
    apl, diameter, size = average_path(nodes, edges, labelled)
    parts = labelled.select("component").distinct().count()
    clustering = G.triangles(nodes, edges).agg(F.avg("clustering")).first()[0]
    rows = [("units", deg["n"]), ("links", deg["s"] / 2), ("average_degree", deg["s"] / deg["n"]), ("max_degree", deg["m"]), ("isolates", deg["z"]), ("giant_size", size), ("diameter", diameter), ("average_path_length", apl), ("components", parts), ("average_clustering", clustering)]
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "stat string, value double")
