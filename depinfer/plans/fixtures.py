"""Networks and node attributes derived from the driver's tables, in Spark and in SQL."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depinfer.functions.storage import with_index
from depinfer.operators.simulate import range_join


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, y, x1, x2, nation, segment``: balance, number of orders, their total in hundred thousands."""
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("t"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return c.join(orders, "id", "left").select("id", "y", F.coalesce("k", F.lit(0)).cast("double").alias("x1"), (F.coalesce("t", F.lit(0.0)) / 1e5).alias("x2"), "nation", "segment")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of consecutive urgent orders."""
    urgent = read(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderdate", "o_orderkey", "o_custkey")
    at = with_index(urgent, "o_orderdate", "o_orderkey")
    pairs = at.select("idx", F.col("o_custkey").alias("a")).join(at.select((F.col("idx") - 1).alias("idx"), F.col("o_custkey").alias("b")), "idx").filter("a <> b")
    return pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def geometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that are near in balance and key, with five neighbours on average."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("y"))
    lo, hi, n = c.agg(F.min("y"), F.max("y"), F.count("*")).first()
    return range_join(c.select("id", ((F.col("y") - lo) / (hi - lo)).alias("px"), (F.col("id") / n).alias("py")), sqrt(5 / (pi * n)))


def shared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share orders, weighted by how many."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    a, b = lines.withColumnRenamed("l_partkey", "src"), lines.withColumnRenamed("l_partkey", "dst")
    return a.join(b, "l_orderkey").filter("src < dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return c.select("id", F.floor(F.col("id") * 5 / c.count()).cast("int").alias("cluster"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("int").alias("cluster"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("s"))
    names = sorted(r[0] for r in c.select("s").distinct().collect())
    at = F.create_map(*(x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))))
    return c.select("id", at[F.col("s")].cast("int").alias("cluster"))


NODES = """nodes AS (
  SELECT c_custkey AS id, c_acctbal AS y, CAST(coalesce(k, 0) AS DOUBLE) AS x1, coalesce(t, 0) / 1e5 AS x2, c_nationkey AS nation, c_mktsegment AS segment
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS k, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
)"""
CHAIN = """u AS (
  SELECT o_custkey AS a, lead(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS b FROM orders WHERE o_orderpriority = '1-URGENT'
), edges AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM u WHERE b IS NOT NULL AND a <> b
), sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""
GEOMETRIC = """p AS (
  SELECT c_custkey AS id, (c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()) AS px,
         c_custkey / CAST(count(*) OVER () AS DOUBLE) AS py, count(*) OVER () AS n FROM customer
), edges AS (SELECT a.id AS src, b.id AS dst FROM p a JOIN p b ON a.id < b.id WHERE (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 5 / (pi() * a.n)
), sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"""
DEGREES = "deg AS (SELECT id, CAST(count(src) AS DOUBLE) AS degree FROM nodes LEFT JOIN sym ON src = id GROUP BY id)"
BANDS = "clusters AS (SELECT c_custkey AS id, CAST(floor(c_custkey * 5 / (SELECT CAST(count(*) AS DOUBLE) FROM customer)) AS INTEGER) AS cluster FROM customer)"
NATIONS = "clusters AS (SELECT c_custkey AS id, CAST(c_nationkey AS INTEGER) AS cluster FROM customer)"
SEGMENTS = "clusters AS (SELECT c_custkey AS id, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS cluster FROM customer)"
BALL2 = """walk(i, j, d) AS (
  SELECT id, id, 0 FROM nodes UNION SELECT i, dst, d + 1 FROM walk JOIN sym ON j = src WHERE d < 2
), ball AS (SELECT i, j, min(d) AS d FROM walk GROUP BY i, j)"""
REACH = """reach(i, j) AS (SELECT id, id FROM nodes UNION SELECT i, dst FROM reach JOIN sym ON j = src
), comp AS (SELECT i AS id, min(j) AS component FROM reach GROUP BY i
), big AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1
), giant AS (SELECT id FROM comp JOIN big USING (component))"""
PATHS = """paths(i, j, d) USING KEY (i, j) AS (
  SELECT id, id, 0 FROM nodes UNION
  SELECT p.i, s.dst, p.d + 1 FROM paths p JOIN sym s ON p.j = s.src LEFT JOIN recurring.paths r ON r.i = p.i AND r.j = s.dst WHERE r.i IS NULL
)"""


def sql(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ", ".join(parts) + "\n" + select


def uniform_sql(seed: str, counter: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}:' || CAST({counter} AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0)"


def normal_sql(seed: str, counter: str) -> str:
    return f"(sqrt(-2.0 * ln(1.0 - {uniform_sql(seed + '/u', counter)})) * cos(2.0 * pi() * {uniform_sql(seed + '/v', counter)}))"
