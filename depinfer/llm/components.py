"""Connected components of an edge table, without gathering edges or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.operators import graph


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node) for each node of the undirected ``edges`` (a, b).

    The library's star rounds, to their fixed point.  Null ends and loops are
    ignored; an empty table gives an empty result.
    """
    links = edges.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    nodes = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.components(nodes, links).select(F.col("id").alias("node"), "component")
