"""Registry of the library's queries and their oracle SQL.

Each query takes ``(spark, sf_dir)``; doubles are rounded, since sums depend on
their order in either engine.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depinfer.functions import dist
from depinfer.functions.storage import cut, with_index, work_folder
from depinfer.operators import cluster as C
from depinfer.operators import estimators as E
from depinfer.operators import graph as G
from depinfer.operators import hac as H
from depinfer.operators import randomize as R
from depinfer.operators import resample as RS
from depinfer.operators import simulate as S
from depinfer.operators import summary as SU
from depinfer.plans import fixtures as X

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if oracle:
            _SQL[f.__name__] = oracle
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _one(spark: SparkSession, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


def r(column, digits: int = 6):
    return F.round(column, digits)


# Graph relational algebra


@query(X.sql(X.CHAIN, select="SELECT src, dst FROM sym"))
def edges_symmetrised(spark, d):
    return G.symmetrise(X.chain(spark, d))


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, select="SELECT id, degree FROM deg"))
def degree_per_node(spark, d):
    return G.degrees(X.customers(spark, d), G.symmetrise(X.chain(spark, d)))


_DIRECT = "SELECT id, round(coalesce(avg(v), 0), 8) AS y FROM (SELECT n.id, m.y AS v FROM nodes n LEFT JOIN {pairs} ON src = n.id LEFT JOIN nodes m ON m.id = dst) GROUP BY id"


@query(X.sql(X.NODES, X.CHAIN, select=_DIRECT.format(pairs="sym")))
def neighbour_mean_d1(spark, d):
    return G.neighbour_mean(X.customers(spark, d), G.symmetrise(X.chain(spark, d)), ["y"]).select("id", r("y", 8).alias("y"))


@query(X.sql(X.NODES, X.CHAIN, X.BALL2, "shell AS (SELECT i AS src, j AS dst FROM ball WHERE d = 2)", select=_DIRECT.format(pairs="shell")))
def neighbour_mean_d2(spark, d):
    return G.neighbour_mean(X.customers(spark, d), X.chain(spark, d), ["y"], distance=2).select("id", r("y", 8).alias("y"))


_SHARED = """l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem
), edges AS (SELECT a.p AS src, b.p AS dst, CAST(count(*) AS DOUBLE) AS weight FROM l a JOIN l b ON a.o = b.o AND a.p < b.p GROUP BY a.p, b.p
), sym AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"""


@query(X.sql(_SHARED, select="SELECT p_partkey AS id, round(coalesce(v, 0), 9) AS price FROM part LEFT JOIN (SELECT src, sum(weight * p_retailprice) / sum(weight) AS v FROM sym JOIN part ON p_partkey = dst GROUP BY src) ON src = p_partkey"))
def neighbour_mean_weighted(spark, d):
    parts = X.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    return G.neighbour_mean(parts, G.symmetrise(X.shared_orders(spark, d), "weight"), ["price"], weight="weight").select("id", r("price", 9).alias("price"))


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, select="SELECT src, dst, round(1 / greatest(degree, 1), 9) AS w FROM sym JOIN deg ON id = src"))
def adj_row_normalised(spark, d):
    return G.row_normalise(X.customers(spark, d), G.symmetrise(X.chain(spark, d))).select("src", "dst", r("w", 9).alias("w"))


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, select="SELECT n.id, round(coalesce(s, 0), 6) AS y FROM nodes n LEFT JOIN (SELECT src, sum(y) AS s FROM sym JOIN nodes ON id = dst GROUP BY src) ON src = n.id"))
def spmv(spark, d):
    nodes = X.customers(spark, d)
    return G.spmv(nodes, G.symmetrise(X.chain(spark, d)), nodes, ["y"]).select("id", r("y").alias("y"))


@query(X.sql(X.GEOMETRIC, select="SELECT src, dst FROM edges"))
def range_join_rgg(spark, d):
    return X.geometric(spark, d)


@query(X.sql(X.NODES, X.CHAIN, X.BALL2, select="SELECT i AS id, count(*) AS n, CAST(sum(d) AS BIGINT) AS total FROM ball GROUP BY i"))
def ball_sizes_b2(spark, d):
    return G.ball(X.customers(spark, d).select("id"), X.chain(spark, d), 2).groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n"), F.sum("d").alias("total"))


@query(X.sql(X.NODES, X.CHAIN, X.REACH, select="SELECT id, component FROM comp"))
def components(spark, d):
    return G.components(X.customers(spark, d), X.chain(spark, d))


@query(X.sql(X.NODES, X.CHAIN, X.REACH, select="SELECT count(*) AS n FROM giant"))
def giant_size(spark, d):
    return G.giant(G.components(X.customers(spark, d), X.chain(spark, d))).agg(F.count("*").alias("n"))


@query(X.sql(X.NODES, X.CHAIN, X.REACH, select="SELECT src, dst FROM edges WHERE src IN (FROM giant) AND dst IN (FROM giant)"))
def induced_subgraph(spark, d):
    edges = X.chain(spark, d)
    return G.induced(edges, G.giant(G.components(X.customers(spark, d), edges)))


_LENGTHS = "l AS (SELECT CAST(sum(d) AS DOUBLE) AS t, max(d) AS m, count(DISTINCT i) AS n FROM paths WHERE i IN (FROM giant))"


@query(X.sql(X.NODES, X.CHAIN, X.REACH, X.PATHS, _LENGTHS, select="SELECT round(t / (n * (n - 1)), 9) AS apl FROM l"))
def avg_path_length(spark, d):
    return _one(spark, "apl double", round(SU.average_path(X.customers(spark, d), X.chain(spark, d))[0], 9))


@query(X.sql(X.NODES, X.CHAIN, X.REACH, X.PATHS, _LENGTHS, select="SELECT CAST(m AS BIGINT) AS diameter FROM l"))
def diameter(spark, d):
    return _one(spark, "diameter bigint", SU.average_path(X.customers(spark, d), X.chain(spark, d))[1])


@query(X.sql(X.NODES, X.CHAIN, X.PATHS, select="SELECT i AS id, CAST(sum(d) AS BIGINT) AS total, CAST(max(d) AS BIGINT) AS furthest, count(*) - 1 AS reached FROM paths GROUP BY i"))
def path_lengths(spark, d):
    return G.path_lengths(X.customers(spark, d), X.chain(spark, d)).select("id", "total", F.col("furthest").cast("long").alias("furthest"), "reached")


@query(
    X.sql(
        X.NODES, X.CHAIN, X.REACH, X.PATHS, X.DEGREES, _LENGTHS, "a AS (SELECT t / (n * (n - 1)) AS apl, (SELECT avg(degree) FROM deg) AS k, (SELECT count(*) FROM nodes) AS n FROM l)",
        select="SELECT round(apl, 9) AS apl, round(k, 9) AS average_degree, CAST(round_even(CASE WHEN apl < 2 * ln(n) / ln(k) THEN apl / 2 ELSE cbrt(apl) END, 0) AS BIGINT) AS bandwidth FROM a",
    )
)
def bandwidth_rule(spark, d):
    apl, b, degree = H.bandwidth_rule(X.customers(spark, d).select("id"), X.chain(spark, d))
    return _one(spark, "apl double, average_degree double, bandwidth bigint", round(apl, 9), round(degree, 9), b)


_TRIANGLES = """t AS (SELECT a.src AS i, a.dst AS j, b.dst AS k FROM edges a JOIN edges b ON a.dst = b.src JOIN edges c ON c.src = a.src AND c.dst = b.dst
), corner AS (SELECT unnest([i, j, k]) AS id FROM t), per AS (SELECT id, count(*) AS triangles FROM corner GROUP BY id
), tri AS (SELECT d.id, coalesce(triangles, 0) AS triangles, CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END AS clustering FROM deg d LEFT JOIN per ON per.id = d.id)"""


@query(X.sql(X.NODES, X.GEOMETRIC, X.DEGREES, _TRIANGLES, select="SELECT id, triangles, round(clustering, 9) AS clustering FROM tri"))
def triangles_clustering(spark, d):
    return G.triangles(X.customers(spark, d), X.geometric(spark, d)).select("id", "triangles", r("clustering", 9).alias("clustering"))


@query(
    X.sql(
        X.NODES, X.CHAIN, X.REACH, X.PATHS, X.DEGREES, _TRIANGLES, _LENGTHS,
        select="""SELECT stat, round(CAST(value AS DOUBLE), 6) AS value FROM (
  SELECT 'units' AS stat, (SELECT count(*) FROM nodes) AS value UNION ALL SELECT 'links', (SELECT count(*) FROM edges) UNION ALL SELECT 'average_degree', (SELECT avg(degree) FROM deg)
  UNION ALL SELECT 'max_degree', (SELECT max(degree) FROM deg) UNION ALL SELECT 'isolates', (SELECT count(*) FROM deg WHERE degree = 0) UNION ALL SELECT 'giant_size', (SELECT count(*) FROM giant)
  UNION ALL SELECT 'diameter', (SELECT m FROM l) UNION ALL SELECT 'average_path_length', (SELECT t / (n * (n - 1)) FROM l) UNION ALL SELECT 'components', (SELECT count(DISTINCT component) FROM comp)
  UNION ALL SELECT 'average_clustering', (SELECT avg(clustering) FROM tri))""",
    )
)
def graph_sumstats(spark, d):
    return SU.sumstats(X.customers(spark, d), X.chain(spark, d)).select("stat", r("value").alias("value"))


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, select="SELECT src, dst, round(-1 / sqrt(a.degree * b.degree), 9) AS value FROM sym JOIN deg a ON a.id = src JOIN deg b ON b.id = dst UNION ALL SELECT id, id, 1.0 FROM deg WHERE degree > 0"))
def laplacian_entries(spark, d):
    return G.laplacian(X.customers(spark, d), X.chain(spark, d)).select("src", "dst", r("value", 9).alias("value"))


# Estimators


@query(X.sql(X.NODES, select="SELECT count(*) AS n, round(sum(x1), 4) AS s1, round(sum(x2), 4) AS s2, round(sum(x1 * x1), 4) AS s11, round(sum(x1 * x2), 4) AS s12, round(sum(x2 * x2), 4) AS s22, round(sum(y), 2) AS sy, round(sum(x1 * y), 2) AS s1y, round(sum(x2 * y), 2) AS s2y FROM nodes"))
def gram_matrix(spark, d):
    df = X.customers(spark, d).withColumn("one", F.lit(1.0))
    g = H.cross_product(df, ["one", "x1", "x2"], ["one", "x1", "x2", "y"])
    pick = [(0, 1, 4), (0, 2, 4), (1, 1, 4), (1, 2, 4), (2, 2, 4), (0, 3, 2), (1, 3, 2), (2, 3, 2)]
    return _one(spark, "n bigint, " + ", ".join(f"{c} double" for c in "s1 s2 s11 s12 s22 sy s1y s2y".split()), int(g[0, 0]), *(round(float(g[i, j]), k) for i, j, k in pick))


_FIT2 = """m AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS v1, var_pop(x2) AS v2, covar_pop(x1, x2) AS v12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2 FROM nodes
), b AS (SELECT (c1 * v2 - c2 * v12) / (v1 * v2 - v12 * v12) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 * v12) AS b2, my, m1, m2 FROM m)"""


def _fit(model) -> list[tuple[str, float]]:
    return [(n, round(float(v), 4)) for n, v in zip(model.names, model.estimate)]


@query(X.sql(X.NODES, _FIT2, select="SELECT 'const' AS name, round(my - b1 * m1 - b2 * m2, 4) AS estimate FROM b UNION ALL SELECT 'x1', round(b1, 4) FROM b UNION ALL SELECT 'x2', round(b2, 4) FROM b"))
def ols_fit(spark, d):
    return spark.createDataFrame(_fit(E.OLS(X.customers(spark, d), "y", ["x1", "x2"])), "name string, estimate double")


@query(X.sql(X.NODES, _FIT2, select="SELECT count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(min(e), 4) AS lo, round(max(e), 4) AS hi FROM (SELECT y - my - b1 * (x1 - m1) - b2 * (x2 - m2) AS e FROM nodes, b)"))
def ols_residual_stats(spark, d):
    e = E.OLS(X.customers(spark, d), "y", ["x1", "x2"]).residuals()
    return e.agg(F.count("*").alias("n"), r(F.sqrt(F.avg(F.col("resid") * F.col("resid"))), 4).alias("rmse"), r(F.min("resid"), 4).alias("lo"), r(F.max("resid"), 4).alias("hi"))


@query(X.sql(X.NODES, "b AS (SELECT covar_pop(x1, y) / covar_pop(x1, x2) AS b, avg(y) AS my, avg(x2) AS mx FROM nodes)", select="SELECT 'const' AS name, round(my - b * mx, 4) AS estimate FROM b UNION ALL SELECT 'x2', round(b, 4) FROM b"))
def tsls_fit(spark, d):
    return spark.createDataFrame(_fit(E.TSLS(X.customers(spark, d), "y", ["x2"], ["x1"])), "name string, estimate double")


def _exposure(spark, d) -> tuple[DataFrame, DataFrame]:
    edges = cut(X.chain(spark, d))
    nodes = X.customers(spark, d).withColumn("treated", (F.col("segment") == "BUILDING").cast("double"))
    both = G.symmetrise(edges)
    near = G.spmv(nodes, both, nodes, ["treated"]).withColumnRenamed("treated", "near")
    joined = nodes.join(near, "id").join(G.degrees(nodes, both), "id")
    exposed, none = F.col("near") > 0, F.pow(F.lit(0.8), F.col("degree"))
    return joined.select("id", "y", exposed.cast("int").alias("ind1"), (~exposed).cast("int").alias("ind2"), (1.0 - none).alias("pscore1"), none.alias("pscore2")), edges


_EXPOSURE = """near AS (SELECT src, count(*) AS k FROM sym JOIN nodes ON id = dst WHERE segment = 'BUILDING' GROUP BY src
), e AS (SELECT d.id, y, CASE WHEN k > 0 THEN 1 ELSE 0 END AS ind1, CASE WHEN k > 0 THEN 0 ELSE 1 END AS ind2, 1 - pow(0.8, degree) AS pscore1, pow(0.8, degree) AS pscore2 FROM deg d JOIN nodes n ON n.id = d.id LEFT JOIN near ON src = d.id
), w AS (SELECT id, y * (CASE WHEN ind1 = 1 THEN 1 / pscore1 ELSE 0 END - CASE WHEN ind2 = 1 THEN 1 / pscore2 ELSE 0 END) AS v FROM e)"""


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, _EXPOSURE, select="SELECT id, ind1, ind2, round(pscore1, 9) AS pscore1, round(pscore2, 9) AS pscore2 FROM e"))
def ipw_exposure(spark, d):
    return _exposure(spark, d)[0].select("id", "ind1", "ind2", r("pscore1", 9).alias("pscore1"), r("pscore2", 9).alias("pscore2"))


def _ipw(spark, d) -> E.IPW:
    data, edges = _exposure(spark, d)
    return E.IPW(cut(data), "y", "ind1", "ind2", "pscore1", "pscore2", edges)


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, _EXPOSURE, select="SELECT round(avg(v), 4) AS estimate FROM w"))
def ipw_estimate(spark, d):
    return _one(spark, "estimate double", round(float(_ipw(spark, d).estimate[0]), 4))


# Network HAC and standard errors

_Z = "z AS (SELECT id, y - avg(y) OVER () AS z FROM nodes)"


def _y(spark, d) -> DataFrame:
    return X.customers(spark, d).select("id", "y")


@query(X.sql(X.NODES, _Z, select="SELECT round(avg(z * z), 2) AS hac FROM z"))
def hac_iid(spark, d):
    return _one(spark, "hac double", round(float(H.network_hac(_y(spark, d), ["y"], b=0).matrix[0, 0]), 2))


@query(X.sql(X.NODES, X.CHAIN, X.BALL2, _Z, select="SELECT round(sum(a.z * b.z) / (SELECT count(*) FROM nodes), 2) AS hac FROM ball JOIN z a ON a.id = i JOIN z b ON b.id = j"))
def hac_network_b2(spark, d):
    return _one(spark, "hac double", round(float(H.network_hac(_y(spark, d), ["y"], X.chain(spark, d), 2).matrix[0, 0]), 2))


@query(X.sql(X.NODES, X.CHAIN, X.BALL2, _Z, "n AS (SELECT i, sqrt(count(*)) AS r FROM ball GROUP BY i), v AS (SELECT j, sum(z / r) AS v FROM ball JOIN z ON z.id = ball.i JOIN n ON n.i = ball.i GROUP BY j)", select="SELECT round(sum(v * v) / (SELECT count(*) FROM nodes), 2) AS hac FROM v"))
def hac_fallback(spark, d):
    z = cut(H.demean(_y(spark, d), ["y"]))
    pairs = G.ball(z.select("id"), X.chain(spark, d), 2).select("i", "j")
    return _one(spark, "hac double", round(float(H.normalised_kernel_variance(z, ["y"], pairs)[0, 0]), 2))


_SCORES = """f AS (SELECT regr_intercept(y, x2) AS b0, regr_slope(y, x2) AS b1, count(*) AS n, sum(x2) AS sx, sum(x2 * x2) AS sxx FROM nodes
), h AS (SELECT *, sxx / (n * sxx - sx * sx) AS h00, -sx / (n * sxx - sx * sx) AS h01, n / (n * sxx - sx * sx) AS h11 FROM f
), sc AS (SELECT id, y - b0 - b1 * x2 AS s0, x2 * (y - b0 - b1 * x2) AS s1 FROM nodes, f
), z AS (SELECT id, s0 - avg(s0) OVER () AS s0, s1 - avg(s1) OVER () AS s1 FROM sc)"""
_SANDWICH = """SELECT CAST(dim AS INTEGER) AS dim, name, round(estimate, 4) AS estimate, round(se, 4) AS se, round(estimate - 1.959963984540054 * se, 3) AS ci_lo, round(estimate + 1.959963984540054 * se, 3) AS ci_hi FROM (
  SELECT 0 AS dim, 'const' AS name, b0 AS estimate, sqrt(n * (h00 * h00 * v00 + 2 * h00 * h01 * v01 + h01 * h01 * v11)) AS se FROM h, v
  UNION ALL SELECT 1, 'x2', b1, sqrt(n * (h01 * h01 * v00 + 2 * h01 * h11 * v01 + h11 * h11 * v11)) FROM h, v)"""


def _rounded(table: DataFrame) -> DataFrame:
    return table.select("dim", "name", r("estimate", 4).alias("estimate"), r("se", 4).alias("se"), r("ci_lo", 3).alias("ci_lo"), r("ci_hi", 3).alias("ci_hi"))


@query(X.sql(X.NODES, X.CHAIN, X.BALL2, _SCORES, "v AS (SELECT sum(a.s0 * b.s0) / (SELECT count(*) FROM nodes) AS v00, sum(a.s0 * b.s1) / (SELECT count(*) FROM nodes) AS v01, sum(a.s1 * b.s1) / (SELECT count(*) FROM nodes) AS v11 FROM ball JOIN z a ON a.id = i JOIN z b ON b.id = j)", select=_SANDWICH))
def network_se_ols(spark, d):
    return _rounded(E.OLS(X.customers(spark, d), "y", ["x2"], X.chain(spark, d)).network_se(b=2))


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, _EXPOSURE, X.BALL2, "z AS (SELECT id, v - avg(v) OVER () AS z FROM w), v AS (SELECT sum(a.z * b.z) / (SELECT count(*) FROM nodes) AS v FROM ball JOIN z a ON a.id = i JOIN z b ON b.id = j)", select="SELECT round((SELECT avg(v) FROM w), 4) AS estimate, round(sqrt(v.v / (SELECT count(*) FROM nodes)), 4) AS se FROM v"))
def network_se_ipw(spark, d):
    return _ipw(spark, d).network_se(b=2).select(r("estimate", 4).alias("estimate"), r("se", 4).alias("se"))


_BANDWIDTH = "bw AS (SELECT CAST(round_even(CASE WHEN apl < 2 * ln(n) / ln(k) THEN apl / 2 ELSE cbrt(apl) END, 0) AS BIGINT) AS b FROM (SELECT t / (n * (n - 1)) AS apl, (SELECT avg(degree) FROM deg) AS k, (SELECT count(*) FROM nodes) AS n FROM l)), ball AS (SELECT i, j FROM paths, bw WHERE d <= b)"
_HAC2 = """p AS (SELECT sum(a.s0 * b.s0) / (SELECT count(*) FROM nodes) AS p00, sum(a.s0 * b.s1) / (SELECT count(*) FROM nodes) AS p01, sum(a.s1 * b.s1) / (SELECT count(*) FROM nodes) AS p11 FROM ball JOIN z a ON a.id = i JOIN z b ON b.id = j
), size AS (SELECT i, sqrt(count(*)) AS r FROM ball GROUP BY i), q AS (SELECT j, sum(s0 / r) AS q0, sum(s1 / r) AS q1 FROM ball JOIN z ON z.id = ball.i JOIN size ON size.i = ball.i GROUP BY j
), fb AS (SELECT sum(q0 * q0) / (SELECT count(*) FROM nodes) AS f00, sum(q0 * q1) / (SELECT count(*) FROM nodes) AS f01, sum(q1 * q1) / (SELECT count(*) FROM nodes) AS f11 FROM q
), v AS (SELECT if(ok, p00, f00) AS v00, if(ok, p01, f01) AS v01, if(ok, p11, f11) AS v11 FROM (SELECT *, p00 > 0 AND p00 * p11 - p01 * p01 > 0 AS ok FROM p, fb))"""


@query(X.sql(X.NODES, X.CHAIN, X.REACH, X.PATHS, X.DEGREES, _LENGTHS, _BANDWIDTH, _SCORES, _HAC2, select=_SANDWICH))
def network_se_default_ols(spark, d):
    return _rounded(E.OLS(X.customers(spark, d), "y", ["x2"], X.chain(spark, d)).network_se())


_SCORES_IV = """g AS (SELECT regr_intercept(x2, x1) AS g0, regr_slope(x2, x1) AS g1, covar_pop(x1, y) / covar_pop(x1, x2) AS b1, avg(y) AS my, avg(x2) AS mx FROM nodes
), iv AS (SELECT id, y, x2, g0 + g1 * x1 AS xh, my - b1 * mx AS b0, b1 FROM nodes, g
), f0 AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, count(*) AS n, sum(xh) AS sx, sum(xh * xh) AS sxx FROM iv
), h AS (SELECT *, sxx / (n * sxx - sx * sx) AS h00, -sx / (n * sxx - sx * sx) AS h01, n / (n * sxx - sx * sx) AS h11 FROM f0
), sc AS (SELECT id, y - b0 - b1 * x2 AS s0, xh * (y - b0 - b1 * x2) AS s1 FROM iv
), z AS (SELECT id, s0 - avg(s0) OVER () AS s0, s1 - avg(s1) OVER () AS s1 FROM sc)"""


@query(X.sql(X.NODES, X.CHAIN, X.REACH, X.PATHS, X.DEGREES, _LENGTHS, _BANDWIDTH, _SCORES_IV, _HAC2, select=_SANDWICH))
def network_se_default_tsls(spark, d):
    return _rounded(E.TSLS(X.customers(spark, d), "y", ["x2"], ["x1"], X.chain(spark, d)).network_se())


_IV2 = """w AS (SELECT *, CAST(nation AS DOUBLE) AS x3 FROM nodes
), m AS (SELECT avg(y) AS my, avg(x2) AS mx, var_pop(x1) AS v1, var_pop(x3) AS v3, covar_pop(x1, x3) AS v13, covar_pop(x1, x2) AS c1, covar_pop(x3, x2) AS c3, covar_pop(x1, y) AS d1, covar_pop(x3, y) AS d3 FROM w
), a AS (SELECT *, (c1 * v3 - c3 * v13) / (v1 * v3 - v13 * v13) AS a1, (c3 * v1 - c1 * v13) / (v1 * v3 - v13 * v13) AS a3 FROM m
), b AS (SELECT my, mx, (a1 * d1 + a3 * d3) / (a1 * c1 + a3 * c3) AS b FROM a)"""


@query(X.sql(X.NODES, _IV2, select="SELECT 'const' AS name, round(my - b * mx, 4) AS estimate FROM b UNION ALL SELECT 'x2', round(b, 4) FROM b"))
def tsls_overidentified(spark, d):
    data = X.customers(spark, d).withColumn("x3", F.col("nation").cast("double"))
    return spark.createDataFrame(_fit(E.TSLS(data, "y", ["x2"], ["x1", "x3"])), "name string, estimate double")


# Clusters

_CONDUCTANCE = """c AS (SELECT a.cluster, sum(CASE WHEN a.cluster <> b.cluster THEN 1.0 ELSE 0 END) AS cut, CAST(count(*) AS DOUBLE) AS volume FROM sym JOIN clusters a ON a.id = src JOIN clusters b ON b.id = dst GROUP BY a.cluster
), cond AS (SELECT cluster, coalesce(cut, 0) AS cut, coalesce(volume, 0) AS volume, coalesce(cut, 0) / greatest(coalesce(volume, 0), 1) AS conductance FROM (SELECT DISTINCT cluster FROM clusters) LEFT JOIN c USING (cluster))"""


@query(X.sql(X.GEOMETRIC, X.BANDS, _CONDUCTANCE, select="SELECT cluster, CAST(cut AS DOUBLE) AS cut, volume, round(conductance, 9) AS conductance FROM cond"))
def conductance_by_cluster(spark, d):
    return C.conductance(X.bands(spark, d), X.geometric(spark, d)).select("cluster", "cut", "volume", r("conductance", 9).alias("conductance"))


@query(X.sql(X.GEOMETRIC, X.NATIONS, _CONDUCTANCE, select="SELECT round(max(conductance), 9) AS conductance FROM cond"))
def max_conductance(spark, d):
    return _one(spark, "conductance double", round(C.max_conductance(X.nations(spark, d), X.geometric(spark, d)), 9))


@query(X.sql(X.NODES, X.NATIONS, _Z, select="SELECT round(sum(s * s) / (SELECT count(*) FROM nodes), 2) AS v FROM (SELECT sum(z) AS s FROM z JOIN clusters USING (id) GROUP BY cluster)"))
def cluster_var(spark, d):
    return _one(spark, "v double", round(float(C.cluster_var(_y(spark, d).join(X.nations(spark, d), "id"), ["y"])[0, 0]), 2))


@query(
    X.sql(
        X.NODES, X.NATIONS, _Z, "placed AS (SELECT z, row_number() OVER (ORDER BY id) - 1 AS k FROM z), s AS (SELECT cluster, count(*) AS n FROM clusters GROUP BY cluster), b AS (SELECT cluster, sum(n) OVER (ORDER BY cluster) - n AS lo, sum(n) OVER (ORDER BY cluster) AS hi FROM s)",
        select="SELECT round(sum(s * s) / (SELECT count(*) FROM nodes), 2) AS v FROM (SELECT sum(z) AS s FROM placed JOIN b ON k >= lo AND k < hi GROUP BY cluster)",
    )
)
def cluster_var_positional(spark, d):
    return _one(spark, "v double", round(float(C.cluster_var(_y(spark, d).join(X.nations(spark, d), "id"), ["y"], "positional")[0, 0]), 2))


@query(X.sql(X.NODES, X.NATIONS, _SCORES, "g AS (SELECT sum(s0) AS s0, sum(s1) AS s1 FROM z JOIN clusters USING (id) GROUP BY cluster), v AS (SELECT sum(s0 * s0) / (SELECT count(*) FROM nodes) AS v00, sum(s0 * s1) / (SELECT count(*) FROM nodes) AS v01, sum(s1 * s1) / (SELECT count(*) FROM nodes) AS v11 FROM g)", select=_SANDWICH))
def cluster_se_ols(spark, d):
    model = E.OLS(X.customers(spark, d), "y", ["x2"])
    model.get_clusters(clusters=X.nations(spark, d))
    return _rounded(model.cluster_se())


def _labelled(spark, d, values: list[float], digits: int = 4) -> DataFrame:
    return spark.createDataFrame([(i, round(float(v), digits)) for i, v in enumerate(values)], "cluster int, theta double")


def _ols_in_segments(spark, d) -> E.OLS:
    model = E.OLS(X.customers(spark, d), "y", ["x2"])
    model.get_clusters(clusters=X.segments(spark, d))
    return model


_THETA = "theta AS (SELECT cluster, regr_slope(y, x2) AS t FROM nodes JOIN clusters USING (id) GROUP BY cluster)"


@query(X.sql(X.NODES, X.SEGMENTS, _THETA, select="SELECT cluster, round(t, 4) AS theta FROM theta"))
def ols_by_cluster(spark, d):
    return _labelled(spark, d, _ols_in_segments(spark, d).estimates_by_cluster(1))


@query(X.sql(X.NODES, X.SEGMENTS, select="SELECT cluster, round(covar_pop(x1, y) / covar_pop(x1, x2), 4) AS theta FROM nodes JOIN clusters USING (id) GROUP BY cluster"))
def tsls_by_cluster(spark, d):
    model = E.TSLS(X.customers(spark, d), "y", ["x2"], ["x1"])
    model.get_clusters(clusters=X.segments(spark, d))
    return _labelled(spark, d, model.estimates_by_cluster(1))


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, _EXPOSURE, X.SEGMENTS, select="SELECT cluster, round(avg(v), 4) AS theta FROM w JOIN clusters USING (id) GROUP BY cluster"))
def ipw_by_cluster(spark, d):
    model = _ipw(spark, d)
    model.clusters = X.segments(spark, d)
    return _labelled(spark, d, model.estimates_by_cluster())


@query(X.sql(X.NODES, X.SEGMENTS, _THETA, select=f"SELECT CAST(1 AS INTEGER) AS dim, round(avg(t) - {dist.t_quantile(0.975, 4)!r} * stddev_pop(t) / sqrt(count(*)), 3) AS ci_lo, round(avg(t) + {dist.t_quantile(0.975, 4)!r} * stddev_pop(t) / sqrt(count(*)), 3) AS ci_hi FROM theta"))
def trobust_ci(spark, d):
    return _ols_in_segments(spark, d).trobust_ci(dimension=1).select("dim", r("ci_lo", 3).alias("ci_lo"), r("ci_hi", 3).alias("ci_hi"))


_SIGNS = "sums AS (SELECT g, sum((1 - 2 * ((g >> cluster) & 1)) * t) AS s, sum(1 - 2 * ((g >> cluster) & 1)) AS n FROM range(32) x(g), theta GROUP BY g), tot AS (SELECT sum(t) AS total FROM theta)"


@query(X.sql(X.NODES, X.SEGMENTS, _THETA, _SIGNS, select="SELECT round(avg(CASE WHEN abs(s + 3.0 * n) >= abs(total + 15.0) - 1e-9 THEN 1.0 ELSE 0 END), 6) AS p_value, round(max(abs(total + 15.0)) / 5, 4) AS statistic FROM sums, tot"))
def arand_pvalue(spark, d):
    p, t = _ols_in_segments(spark, d).arand_test(-3.0, dimension=1)
    return _one(spark, "p_value double, statistic double", round(p, 6), round(t, 4))


_GRID = "grid AS (SELECT k AS point, CASE WHEN k = {last} THEN {stop} ELSE {start} + k * ({stop} - {start}) / {last} END AS mu FROM range(1, {size}) x(k))"
_HULL = "SELECT round(coalesce(min(mu) FILTER (ok), {start}), 4) AS ci_lo, round(coalesce(max(mu) FILTER (ok), {stop}), 4) AS ci_hi FROM acc"
_WIDE = {"start": "-200.0", "stop": "200.0", "size": 151, "last": 150}


@query(X.sql(X.NODES, X.SEGMENTS, _THETA, _SIGNS, _GRID.format(**_WIDE), "acc AS (SELECT mu, avg(CASE WHEN abs(s - mu * n) >= abs(total - mu * 5) - 1e-9 THEN 1.0 ELSE 0 END) > 0.1 AS ok FROM sums, tot, grid GROUP BY mu)", select=_HULL.format(**_WIDE)))
def arand_ci(spark, d):
    return _ols_in_segments(spark, d).arand_ci(-200, 200, dimension=1, coverage=0.9).select(r("ci_lo", 4).alias("ci_lo"), r("ci_hi", 4).alias("ci_hi"))


@query(X.sql(X.NODES, X.NATIONS, _SCORES_IV, "c AS (SELECT sum(s0) AS s0, sum(s1) AS s1 FROM z JOIN clusters USING (id) GROUP BY cluster), v AS (SELECT sum(s0 * s0) / (SELECT count(*) FROM nodes) AS v00, sum(s0 * s1) / (SELECT count(*) FROM nodes) AS v01, sum(s1 * s1) / (SELECT count(*) FROM nodes) AS v11 FROM c)", select=_SANDWICH))
def cluster_se_tsls(spark, d):
    model = E.TSLS(X.customers(spark, d), "y", ["x2"], ["x1"])
    model.get_clusters(clusters=X.nations(spark, d))
    return _rounded(model.cluster_se())


def _ipw_in_segments(spark, d) -> E.IPW:
    model = _ipw(spark, d)
    model.get_clusters(clusters=X.segments(spark, d))
    return model


_THETA_IPW = "theta AS (SELECT cluster, avg(v) AS t FROM w JOIN clusters USING (id) GROUP BY cluster)"


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, _EXPOSURE, X.NATIONS, "z AS (SELECT id, v - avg(v) OVER () AS z FROM w), c AS (SELECT sum(z) AS s FROM z JOIN clusters USING (id) GROUP BY cluster)", select="SELECT round((SELECT avg(v) FROM w), 4) AS estimate, round(sqrt(sum(s * s)) / (SELECT count(*) FROM nodes), 4) AS se FROM c"))
def cluster_se_ipw(spark, d):
    model = _ipw(spark, d)
    model.get_clusters(clusters=X.nations(spark, d))
    return model.cluster_se().select(r("estimate", 4).alias("estimate"), r("se", 4).alias("se"))


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, _EXPOSURE, X.SEGMENTS, _THETA_IPW, select=f"SELECT round(avg(t) - {dist.t_quantile(0.975, 4)!r} * stddev_pop(t) / sqrt(count(*)), 3) AS ci_lo, round(avg(t) + {dist.t_quantile(0.975, 4)!r} * stddev_pop(t) / sqrt(count(*)), 3) AS ci_hi FROM theta"))
def trobust_ci_ipw(spark, d):
    return _ipw_in_segments(spark, d).trobust_ci().select(r("ci_lo", 3).alias("ci_lo"), r("ci_hi", 3).alias("ci_hi"))


@query(X.sql(X.NODES, X.SEGMENTS, "theta AS (SELECT cluster, covar_pop(x1, y) / covar_pop(x1, x2) AS t FROM nodes JOIN clusters USING (id) GROUP BY cluster)", _SIGNS, select="SELECT round(avg(CASE WHEN abs(s + 3.0 * n) >= abs(total + 15.0) - 1e-9 THEN 1.0 ELSE 0 END), 6) AS p_value, round(max(abs(total + 15.0)) / 5, 4) AS statistic FROM sums, tot"))
def arand_pvalue_tsls(spark, d):
    model = E.TSLS(X.customers(spark, d), "y", ["x2"], ["x1"])
    model.get_clusters(clusters=X.segments(spark, d))
    p, t = model.arand_test(-3.0, dimension=1)
    return _one(spark, "p_value double, statistic double", round(p, 6), round(t, 4))


@query(X.sql(X.NODES, X.CHAIN, X.GEOMETRIC.replace("edges AS", "near AS").replace("FROM edges", "FROM near").replace("sym AS", "near_sym AS"), X.SEGMENTS, "ends AS (SELECT a.cluster AS ls, b.cluster AS lt FROM near_sym JOIN clusters a ON a.id = src JOIN clusters b ON b.id = dst), c AS (SELECT ls, avg(CASE WHEN ls <> lt THEN 1.0 ELSE 0 END) AS share FROM ends GROUP BY ls)", select="SELECT (SELECT count(*) FROM clusters) AS n, (SELECT count(DISTINCT cluster) FROM clusters) AS k, round(max(share), 9) AS conductance FROM c"))
def get_clusters_given(spark, d):
    model = E.OLS(X.customers(spark, d), "y", ["x2"], X.geometric(spark, d))
    found = model.get_clusters(clusters=X.segments(spark, d)).agg(F.count("*"), F.count_distinct("cluster")).first()
    return _one(spark, "n bigint, k bigint, conductance double", *found, round(float(model.conductance), 9))


# Resampling

_DRAWS = f"""n AS (SELECT count(*) AS n, avg(y) AS m, stddev_pop(y) AS sd FROM nodes
), v AS (SELECT row_number() OVER (ORDER BY id) - 1 AS idx, (y - m) / sd AS z FROM nodes, n
), k AS (SELECT k, k // n AS draw, CAST(floor({X.uniform_sql('7/i', 'k')} * n) AS BIGINT) AS i, CAST(floor({X.uniform_sql('7/j', 'k')} * (n - 1)) AS BIGINT) AS step, n FROM n, range(CAST(1000 * n AS BIGINT)) x(k)
), s AS (SELECT draw, sum(a.z * b.z) AS a, sum(a.z + b.z) AS b FROM k JOIN v a ON a.idx = i JOIN v b ON b.idx = (i + 1 + step) % n GROUP BY draw)"""
_CRITICAL = repr(dist.chi2_one_quantile(0.96))
_STAT = "(a - ((mu - m) / sd) * b + n * ((mu - m) / sd) * ((mu - m) / sd)) / sqrt(n) - sqrt(n) / n"
_MONEY = {"start": "3000.0", "stop": "6000.0", "size": 151, "last": 150}


@query(X.sql(X.NODES, _DRAWS, f"q AS (SELECT {_STAT} AS s FROM s, n, (SELECT 4500.0 AS mu))", select=f"SELECT round(avg(CASE WHEN s * s <= {_CRITICAL} THEN 1.0 ELSE 0 END), 6) AS rcf, CASE WHEN avg(CASE WHEN s * s <= {_CRITICAL} THEN 1.0 ELSE 0 END) >= 0.95 THEN 'Not reject' ELSE 'Reject' END AS result FROM q"))
def drobust_test(spark, d):
    found = RS.drobust_test(_y(spark, d), "y", 4500.0, seed=7)
    return _one(spark, "rcf double, result string", round(found["rcf"], 6), found["result"])


@query(X.sql(X.NODES, _DRAWS, _GRID.format(**_MONEY), f"acc AS (SELECT mu, avg(CASE WHEN ({_STAT}) * ({_STAT}) <= {_CRITICAL} THEN 1.0 ELSE 0 END) >= 0.95 AS ok FROM s, n, grid GROUP BY mu)", select=_HULL.format(**_MONEY)))
def drobust_ci(spark, d):
    return RS.drobust_ci(_y(spark, d), "y", 3000.0, 6000.0, seed=7).select(r("ci_lo", 4).alias("ci_lo"), r("ci_hi", 4).alias("ci_hi"))


def _influence(draws: int, values: str) -> str:
    return _DRAWS.replace("n AS (SELECT count(*) AS n, avg(y) AS m, stddev_pop(y) AS sd FROM nodes", f"{values}, n AS (SELECT count(*) AS n, avg(y) AS m, stddev_pop(y) AS sd FROM vals").replace("(y - m) / sd AS z FROM nodes, n", "(y - m) / sd AS z FROM vals, n")


_SLOPE = _influence(1000, _SCORES + ", vals AS (SELECT nodes.id, h.n * (h01 * nodes.y + h11 * x2 * nodes.y) AS y FROM nodes, h)")
_CONST = _influence(1000, _SCORES + ", vals AS (SELECT nodes.id, h.n * (h00 * nodes.y + h01 * x2 * nodes.y) AS y FROM nodes, h)")
_EFFECT = _influence(1000, "vals AS (SELECT id, v AS y FROM w)")
_WIDER = {"start": "-6000.0", "stop": "9000.0", "size": 151, "last": 150}


@query(X.sql(X.NODES, _SLOPE, f"q AS (SELECT {_STAT} AS s FROM s, n, (SELECT 0.0 AS mu))", select=f"SELECT CASE WHEN avg(CASE WHEN s * s <= {_CRITICAL} THEN 1.0 ELSE 0 END) >= 0.95 THEN 'Not reject' ELSE 'Reject' END AS result FROM q"))
def drobust_test_ols(spark, d):
    return _one(spark, "result string", E.OLS(X.customers(spark, d), "y", ["x2"]).drobust_test(0.0, dimension=1, seed=7))


def _interval_sql(values: str) -> str:
    return values + ", " + _GRID.format(**_WIDER) + f", acc AS (SELECT mu, avg(CASE WHEN ({_STAT}) * ({_STAT}) <= {_CRITICAL} THEN 1.0 ELSE 0 END) >= 0.95 AS ok FROM s, n, grid GROUP BY mu)"


_BOTH = "WITH " + ", ".join(f"d{k} AS (WITH {X.NODES}, {_interval_sql(v)} {_HULL.format(**_WIDER)})" for k, v in enumerate((_CONST, _SLOPE)))


@query(_BOTH + " SELECT CAST(0 AS INTEGER) AS dim, * FROM d0 UNION ALL SELECT 1, * FROM d1")
def drobust_ci_ols(spark, d):
    return E.OLS(X.customers(spark, d), "y", ["x2"]).drobust_ci(-6000.0, 9000.0, seed=7).select("dim", r("ci_lo", 4).alias("ci_lo"), r("ci_hi", 4).alias("ci_hi"))


@query(X.sql(X.NODES, X.CHAIN, X.DEGREES, _EXPOSURE, _interval_sql(_EFFECT), select=_HULL.format(**_WIDER)))
def drobust_ci_ipw(spark, d):
    return _ipw(spark, d).drobust_ci(-6000.0, 9000.0, seed=7).select(r("ci_lo", 4).alias("ci_lo"), r("ci_hi", 4).alias("ci_hi"))


# Spectra; SQL has no eigenvalues, so the sums that fix them are what is compared

_SPECTRUM = """ds AS (SELECT src, count(*) AS k FROM sym JOIN giant ON giant.id = src GROUP BY src)"""


@query()
def spectrum(spark, d):
    return C.spectrum(X.customers(spark, d), X.chain(spark, d)).select("rank", r("eigenvalue").alias("eigenvalue"))


@query(X.sql(X.NODES, X.CHAIN, X.REACH, _SPECTRUM, select="SELECT count(*) AS n, round(CAST(count(*) AS DOUBLE), 4) AS total, round(count(*) + (SELECT sum(1.0 / (a.k * b.k)) FROM sym JOIN ds a ON a.src = sym.src JOIN ds b ON b.src = sym.dst), 4) AS squares FROM giant"))
def spectrum_moments(spark, d):
    return C.spectrum_moments(X.customers(spark, d), X.chain(spark, d)).select("n", r("total", 4).alias("total"), r("squares", 4).alias("squares"))


@query()
def spectrum_histogram(spark, d):
    return C.network_histogram(X.customers(spark, d), X.chain(spark, d))


# Suppliers in a ring: the eigenvalues are 1 - cos(2 pi k / n), none of them on the inner edge of a seventh.
_RING = """s AS (SELECT count(*) AS n FROM supplier), v AS (SELECT 1 - cos(2 * pi() * k / n) AS value FROM s, unnest(range(n)) AS t(k))"""


def _ring(spark, d) -> tuple[DataFrame, DataFrame]:
    nodes = with_index(X.read(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("id")), "id")
    following = nodes.select(F.col("id").alias("dst"), F.pmod(F.col("idx") - 1, F.lit(nodes.count())).alias("idx"))
    return nodes.select("id"), nodes.withColumnRenamed("id", "src").join(following, "idx").select("src", "dst")


@query(X.sql(_RING, select="SELECT row_number() OVER (ORDER BY value) - 1 AS rank, round(value, 6) AS eigenvalue FROM v"))
def spectrum_ring(spark, d):
    return C.spectrum(*_ring(spark, d)).select("rank", (r("eigenvalue") + 0.0).alias("eigenvalue"))


@query(X.sql(_RING, "c AS (SELECT least(greatest(floor(value / (2.0 / 7)), 0), 6) AS bin, count(*) AS n FROM v GROUP BY ALL)",
             select="SELECT CAST(b AS INTEGER) AS bin, round(b * (2.0 / 7), 9) AS lo, round((b + 1) * (2.0 / 7), 9) AS hi, coalesce(c.n, 0) AS n FROM range(7) t(b) LEFT JOIN c ON c.bin = b"))
def spectrum_histogram_ring(spark, d):
    found = C.network_histogram(*_ring(spark, d), bins=7)
    return found.select("bin", r("lo", 9).alias("lo"), r("hi", 9).alias("hi"), "n")


@query()
def spectral_clusters(spark, d):
    return C.spectral_clustering(X.customers(spark, d), X.geometric(spark, d), 4)


# Nations of a region are all linked, and the first nation of each region with that of the next: the clusters must be the regions.
_REGIONS = """edges AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
  UNION ALL SELECT least(a, b), greatest(a, b) FROM (SELECT min(n_nationkey) AS a, lead(min(n_nationkey)) OVER (ORDER BY n_regionkey) AS b FROM nation GROUP BY n_regionkey) WHERE b IS NOT NULL
), sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), clusters AS (SELECT n_nationkey AS id, n_regionkey AS cluster FROM nation)"""


def _regions(spark, d) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.window import Window

    nation = X.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("region"))
    a, b = nation.select(F.col("id").alias("src"), "region"), nation.select(F.col("id").alias("dst"), "region")
    within = a.join(b, "region").filter("src < dst").select("src", "dst")
    first = nation.groupBy("region").agg(F.min("id").alias("a")).withColumn("b", F.lead("a").over(Window.orderBy("region"))).filter("b is not null")
    return nation.select("id", F.col("id").cast("double").alias("y")), within.unionByName(first.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")))


@query(X.sql(_REGIONS, _CONDUCTANCE, select="SELECT CAST(n.n_nationkey AS BIGINT) AS id, CAST(min(m.n_nationkey) AS BIGINT) AS first, round((SELECT max(conductance) FROM cond), 9) AS conductance FROM nation n JOIN nation m USING (n_regionkey) GROUP BY n.n_nationkey"))
def get_clusters_spectral(spark, d):
    from pyspark.sql.window import Window

    nodes, edges = _regions(spark, d)
    model = E.OLS(cut(nodes), "y", [], cut(edges))
    found = model.get_clusters(5)
    return found.select("id", F.min("id").over(Window.partitionBy("cluster")).alias("first"), F.lit(round(float(model.conductance), 9)).alias("conductance"))


# Simulators

_N = 300
_POINTS = f"""nodes AS (SELECT i AS id, {X.uniform_sql('3/px', 'i')} AS px, {X.uniform_sql('3/py', 'i')} AS py, {X.normal_sql('3/x', 'i')} AS x, {X.normal_sql('3/e', 'i')} AS e, {X.uniform_sql('3/d', 'i')} < 0.15 AS d FROM range({_N}) t(i)
), edges AS (SELECT a.id AS src, b.id AS dst FROM nodes a JOIN nodes b ON a.id < b.id WHERE (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 5 / ({pi!r} * {_N})
), sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges
), bar AS (SELECT n.id, n.x, n.e, n.d, count(m.id) AS k, coalesce(avg(m.x), 0) AS xb, coalesce(avg(m.e), 0) AS eb, coalesce(bool_or(m.d), false) AS t FROM nodes n LEFT JOIN sym ON src = n.id LEFT JOIN nodes m ON m.id = dst GROUP BY n.id, n.x, n.e, n.d)"""


@query(X.sql(_POINTS, select="SELECT src, dst FROM edges"))
def sim_random_geometric(spark, d):
    return S.random_geometric(spark, _N, seed=3)


@query(
    f"""WITH g AS (SELECT i AS id, k, CAST(floor(ln(1.0 - {X.uniform_sql('3/gap', "i || ':' || k")}) / ln(1 - 5.0 / {_N})) AS BIGINT) + 1 AS gap FROM range({_N}) t(i), range(54) s(k)
), w AS (SELECT id AS src, id + sum(gap) OVER (PARTITION BY id ORDER BY k) AS dst FROM g) SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst FROM w WHERE dst < {_N}"""
)
def sim_erdos_renyi(spark, d):
    return S.erdos_renyi(spark, _N, seed=3)


@query(X.sql(_POINTS, select="SELECT id, round(1 + x + xb + e + eb, 6) AS y, round(x + xb, 6) AS x FROM bar"))
def sim_ols(spark, d):
    return S.ols_data(spark, _N, seed=3)[0].select("id", r("y").alias("y"), r("x").alias("x"))


@query(X.sql(_POINTS, select="SELECT id, round((CASE WHEN t THEN (1 + x) + (1 + xb) ELSE 0 END) + e + eb, 6) AS y, CAST(t AS INTEGER) AS ind1, 1 - CAST(t AS INTEGER) AS ind2, round(1 - pow(0.85, k), 6) AS pscores1, round(pow(0.85, k), 6) AS pscores2 FROM bar"))
def sim_ipw(spark, d):
    return S.ipw_data(spark, _N, seed=3)[0].select("id", r("y").alias("y"), "ind1", "ind2", r("pscores1").alias("pscores1"), r("pscores2").alias("pscores2"))


# The right side, and 60 rounds of y = c + A y / 2 over lists in id order: the error falls below 1e-17.
_MEANS = """c AS (SELECT id, x, 1 + 3 * xb + x + e + eb AS c FROM bar
), lists AS MATERIALIZED (SELECT list(nbrs ORDER BY id) AS nbrs, list(c ORDER BY id) AS cs FROM (SELECT c.id, c.c, coalesce(list(dst) FILTER (dst IS NOT NULL), []) AS nbrs FROM c LEFT JOIN sym ON src = c.id GROUP BY c.id, c.c)
), walk(k, y) AS (
  SELECT 0, cs FROM lists UNION ALL
  SELECT k + 1, list_transform(nbrs, lambda js, i: cs[i] + coalesce(0.5 * list_avg(list_transform(js, lambda j: y[j + 1])), 0)) FROM walk, lists WHERE k < 60
), lim AS (SELECT c.id, y[c.id + 1] AS y, x FROM c, walk WHERE k = 60)"""


@query(X.sql(_POINTS, _MEANS, select="SELECT id, round(y, 6) AS y, round(x, 6) AS x FROM lim"))
def sim_linear_in_means(spark, d):
    edges = S.random_geometric(spark, _N, seed=3)
    return S.linear_in_means(S._drawn(spark, _N, 3), edges).select("id", r("y").alias("y"), r("x").alias("x"))


_FAR = "far AS (SELECT DISTINCT a.src AS i, b.dst AS j FROM sym a JOIN sym b ON a.dst = b.src WHERE a.src <> b.dst AND (a.src, b.dst) NOT IN (SELECT src, dst FROM sym))"


@query(
    X.sql(
        _POINTS, _MEANS, _FAR, "n1 AS (SELECT src AS id, avg(y) AS yb, avg(x) AS xb FROM sym JOIN lim ON lim.id = dst GROUP BY src), n2 AS (SELECT i AS id, avg(x) AS x2 FROM far JOIN lim ON lim.id = j GROUP BY i)",
        select="SELECT lim.id, round(y, 6) AS y, round(coalesce(yb, 0), 6) AS y_bar, round(coalesce(xb, 0), 6) AS x_bar, round(x, 6) AS x, round(coalesce(x2, 0), 6) AS x_bar2 FROM lim LEFT JOIN n1 ON n1.id = lim.id LEFT JOIN n2 ON n2.id = lim.id",
    )
)
def sim_tsls(spark, d):
    return S.tsls_data(spark, _N, seed=3)[0].select("id", *(r(c).alias(c) for c in ("y", "y_bar", "x_bar", "x", "x_bar2")))


# Sources


@query(X.sql(X.CHAIN, select="SELECT src, dst FROM edges"))
def adjlist_round_trip(spark, d):
    from uuid import uuid4

    from depinfer.sources.io import read_adjlist, write_adjlist

    nodes, edges = X.customers(spark, d).select("id"), X.chain(spark, d)
    path = f"{work_folder(spark)}/adjlist-{uuid4().hex}"
    write_adjlist(nodes, edges, path)
    return read_adjlist(spark, path)[1]


@query("SELECT c_custkey AS id FROM customer")
def adjlist_nodes(spark, d):
    from uuid import uuid4

    from depinfer.sources.io import read_adjlist, write_adjlist

    path = f"{work_folder(spark)}/adjlist-{uuid4().hex}"
    write_adjlist(X.customers(spark, d).select("id"), X.chain(spark, d), path)
    return read_adjlist(spark, path)[0]


@query(X.sql(X.NODES, select="SELECT row_number() OVER (ORDER BY id) - 1 AS id, id AS customer, y, x1 FROM nodes"))
def node_csv_round_trip(spark, d):
    from uuid import uuid4

    from depinfer.sources.io import read_node_csv, write_node_csv

    path = f"{work_folder(spark)}/nodes-{uuid4().hex}"
    write_node_csv(X.customers(spark, d).select(F.col("id").alias("customer"), "y", "x1").orderBy("customer"), path)
    return read_node_csv(spark, path, "customer bigint, y double, x1 double")


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_custkey AS id FROM customer")
def row_index(spark, d):
    return with_index(X.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id").select("idx", "id")
