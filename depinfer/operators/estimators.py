"""Least squares, two-stage least squares and inverse-probability weighting, with inference.

Data are DataFrames with an ``id``; regressors are named columns and dimension 0
is the added constant.  Only small matrices reach the driver.  An estimator is
anything with ``influence`` rows (id and one column per dimension) and
``estimates_by_cluster``: subclass :class:`Estimator` to add one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.functions import dist
from depinfer.functions.storage import cut
from depinfer.operators import cluster, randomize, resample
from depinfer.operators.hac import cross_product, network_hac

RESULT = "dim int, name string, estimate double, se double, ci_lo double, ci_hi double"


class Estimator:
    """Shared inference.  Subclasses set ``frame`` (with the columns below), ``names``, ``estimate`` and ``invhessian``."""

    frame: DataFrame
    names: list[str]
    edges: DataFrame | None = None
    #: k x k, or None for a plain mean.
    invhessian = None
    clusters: DataFrame | None = None
    conductance: float | None = None

    @property
    def is_scalar(self) -> bool:
        return self.invhessian is None

    @property
    def spark(self):
        return self.frame.sparkSession

    @cached_property
    def n(self) -> int:
        return self.frame.count()

    def _columns(self, kind: str) -> list[str]:
        return [f"__{kind}{i}" for i in range(len(self.names))]

    def scores(self) -> DataFrame:
        """``id`` and the scores, whose variance the sandwich needs."""
        return self.frame.select("id", *self._columns("score"))

    def influence(self, dimension: int = 0) -> DataFrame:
        """``id, value``: values whose mean is the estimate of the dimension."""
        if self.is_scalar:
            return self.frame.select("id", F.col("__sum0").alias("value"))
        row = sum((F.col(c) * float(self.n * self.invhessian[i, dimension]) for i, c in enumerate(self._columns("sum"))), F.lit(0.0))
        return self.frame.select("id", row.alias("value"))

    def estimates_by_cluster(self, dimension: int) -> list[float]:
        raise NotImplementedError

    def _sandwich(self, variance) -> list[float]:
        import numpy as np

        if self.is_scalar:
            return [dist.root_of_nonnegative(float(variance[0, 0]) / self.n)]
        vcov = self.n * self.invhessian @ variance @ self.invhessian
        self.vcov = vcov
        return [dist.root_of_nonnegative(float(x)) for x in np.diag(vcov)]

    def _table(self, se: Sequence[float], level: float) -> DataFrame:
        rows = []
        for i, (name, s) in enumerate(zip(self.names, se)):
            estimate = float(self.estimate[i])
            rows.append((i, name, estimate, float(s), *map(float, dist.standard_error_bounds(estimate, s, level))))
        return self.spark.createDataFrame(rows, RESULT)

    def network_se(self, b: int | None = None, level: float = 0.95) -> DataFrame:
        """Estimates with network-HAC standard errors."""
        self.network_hac_result = network_hac(self.scores(), self._columns("score"), self.edges, b)
        self.network_se_result = self._sandwich(self.network_hac_result.matrix)
        return self._table(self.network_se_result, level)

    def get_clusters(self, num_clusters: int = 5, clusters: DataFrame | None = None, seed: int = 0, weight: str | None = "weight") -> DataFrame:
        """Take ``clusters`` (id, cluster) or make them by spectral clustering; keeps them and their conductance."""
        nodes = self.frame.select("id")
        self.clusters = cut(clusters if clusters is not None else cluster.spectral_clustering(nodes, self.edges, num_clusters, seed, weight))
        weight = weight if self.edges is not None and weight in self.edges.columns else None
        self.conductance = cluster.max_conductance(self.clusters, self.edges, weight) if self.edges is not None else None
        return self.clusters

    def _clustered(self, num_clusters: int) -> DataFrame:
        if self.clusters is None:
            self.get_clusters(num_clusters)
        return self.frame.join(self.clusters, "id")

    def cluster_se(self, num_clusters: int = 30, level: float = 0.95, layout: str = "labels") -> DataFrame:
        """Estimates with cluster-robust standard errors."""
        columns = self._columns("score")
        variance = cluster.cluster_var(self._clustered(num_clusters).select("id", "cluster", *columns), columns, layout)
        self.cluster_se_result = self._sandwich(variance)
        return self._table(self.cluster_se_result, level)

    def _dimensions(self, dimension: int | None) -> list[int]:
        return [0] if self.is_scalar else [dimension] if dimension is not None else list(range(len(self.names)))

    def _intervals(self, dimensions: Sequence[int], found: Sequence[tuple[float, float]]) -> DataFrame:
        rows = [(d, self.names[d], float(self.estimate[d]), round(float(lo), 6), round(float(hi), 6)) for d, (lo, hi) in zip(dimensions, found)]
        return self.spark.createDataFrame(rows, "dim int, name string, estimate double, ci_lo double, ci_hi double")

    def trobust_ci(self, dimension: int | None = None, num_clusters: int = 5, coverage: float = 0.95) -> DataFrame:
        self._clustered(num_clusters)
        dims = self._dimensions(dimension)
        self.trobust_ci_result = [randomize.trobust_ci(self.estimates_by_cluster(d), coverage) for d in dims]
        return self._intervals(dims, self.trobust_ci_result)

    def arand_test(self, mu: float, dimension: int = 0, num_clusters: int = 5, seed: int = 0) -> tuple[float, float]:
        self._clustered(num_clusters)
        self.arand_test_result, self.arand_test_stat = randomize.arand_test(self.spark, self.estimates_by_cluster(dimension), mu, seed)
        return self.arand_test_result, self.arand_test_stat

    def arand_ci(self, start: float, stop: float, dimension: int | None = None, num_clusters: int = 5, **options) -> DataFrame:
        self._clustered(num_clusters)
        dims = self._dimensions(dimension)
        self.arand_ci_result = [tuple(randomize.arand_ci(self.spark, self.estimates_by_cluster(d), start, stop, **options).first()) for d in dims]
        return self._intervals(dims, self.arand_ci_result)

    def drobust_test(self, mu: float, dimension: int = 0, **options) -> str:
        self.drobust_test_result = resample.drobust_test(self.influence(dimension), "value", mu, **options)["result"]
        return self.drobust_test_result

    def drobust_ci(self, start: float, stop: float, dimension: int | None = None, **options) -> DataFrame:
        dims = self._dimensions(dimension)
        self.drobust_ci_result = [tuple(resample.drobust_ci(self.influence(d), "value", start, stop, **options).first()) for d in dims]
        return self._intervals(dims, self.drobust_ci_result)


def _dot(columns: Sequence[str], weights):
    return sum((F.col(c) * float(w) for c, w in zip(columns, weights)), F.lit(0.0))


class OLS(Estimator):
    """Least squares of ``y`` on a constant and ``x``."""

    def __init__(self, df: DataFrame, y: str, x: Sequence[str], edges: DataFrame | None = None):
        import numpy as np

        self.names, self.edges, self.x = ["const", *x], edges, list(x)
        base = df.select("id", F.col(y).cast("double").alias("__y"), F.lit(1.0).alias("__x0"), *(F.col(c).cast("double").alias(f"__x{i + 1}") for i, c in enumerate(x)))
        regressors = self._columns("x")
        self.frame = base
        sums = cross_product(base, regressors, [*regressors, "__y"])
        self.invhessian = np.linalg.inv(sums[:, :-1])
        self.estimate = self.invhessian @ sums[:, -1]
        self.frame = base.withColumn("__resid", F.col("__y") - _dot(regressors, self.estimate)).select(
            "*", *((F.col(c) * F.col("__y")).alias(s) for c, s in zip(regressors, self._columns("sum"))), *((F.col(c) * F.col("__resid")).alias(s) for c, s in zip(regressors, self._columns("score")))
        )

    def residuals(self) -> DataFrame:
        return self.frame.select("id", F.col("__resid").alias("resid"))

    def _by_cluster(self, left: Sequence[str], right: Sequence[str]):
        """``(label, matrix of sums of products)`` in the order of the labels; one row per cluster comes back."""
        import numpy as np

        rows = self._clustered(0).groupBy("cluster").agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right))).orderBy("cluster").collect()
        return [(r[0], np.array(r[1:], float).reshape(len(left), len(right))) for r in rows]

    def estimates_by_cluster(self, dimension: int) -> list[float]:
        import numpy as np

        x = self._columns("x")
        return [float((np.linalg.pinv(m[:, :-1]) @ m[:, -1])[dimension]) for _, m in self._by_cluster(x, [*x, "__y"])]


class TSLS(OLS):
    """Two-stage least squares with instruments ``w``; both get a constant."""

    def __init__(self, df: DataFrame, y: str, x: Sequence[str], w: Sequence[str], edges: DataFrame | None = None):
        import numpy as np

        self.names, self.edges, self.x = ["const", *x], edges, list(x)
        self.instruments = [f"__w{i}" for i in range(len(w) + 1)]
        base = df.select(
            "id", F.col(y).cast("double").alias("__y"), F.lit(1.0).alias("__x0"), *(F.col(c).cast("double").alias(f"__x{i + 1}") for i, c in enumerate(x)),
            F.lit(1.0).alias("__w0"), *(F.col(c).cast("double").alias(f"__w{i + 1}") for i, c in enumerate(w)),
        )
        regressors = self._columns("x")
        k, d = len(regressors), len(self.instruments)
        self.frame = base
        sums = cross_product(base, self.instruments, [*self.instruments, *regressors, "__y"])
        ww, s, wy = sums[:, :d], sums[:, d : d + k], sums[:, -1]
        p = np.linalg.inv(ww)
        self.invhessian = np.linalg.inv(s.T @ p @ s)
        project = p @ s
        self.estimate = self.invhessian @ (project.T @ wy)
        fitted = [_dot(self.instruments, project[:, j]) for j in range(k)]
        self.frame = base.withColumn("__resid", F.col("__y") - _dot(regressors, self.estimate)).select(
            "*", *((f * F.col("__y")).alias(c) for f, c in zip(fitted, self._columns("sum"))), *((f * F.col("__resid")).alias(c) for f, c in zip(fitted, self._columns("score")))
        )

    def estimates_by_cluster(self, dimension: int) -> list[float]:
        import numpy as np

        x, w = self._columns("x"), self.instruments
        out = []
        for _, m in self._by_cluster(w, [*w, *x, "__y"]):
            p, s, wy = np.linalg.pinv(m[:, : len(w)]), m[:, len(w) : -1], m[:, -1]
            out.append(float((np.linalg.pinv(s.T @ p @ s) @ s.T @ p @ wy)[dimension]))
        return out


class IPW(Estimator):
    """The mean of ``y * (ind1 / pscore1 - ind2 / pscore2)``."""

    def __init__(self, df: DataFrame, y: str, ind1: str, ind2: str, pscore1: str, pscore2: str, edges: DataFrame | None = None):
        self.names, self.edges = ["ipw"], edges
        # Divided only where the indicator is 1, so a zero score elsewhere does no harm.
        weight = lambda i, p: F.when(F.col(i) == 1, F.col(i).cast("double") / F.col(p)).otherwise(F.col(i).cast("double"))
        value = F.col(y).cast("double") * (weight(ind1, pscore1) - weight(ind2, pscore2))
        self.frame = df.select("id", value.alias("__sum0"), value.alias("__score0"))
        self.estimate = [self.frame.agg(F.avg("__sum0")).first()[0]]

    def estimates_by_cluster(self, dimension: int = 0) -> list[float]:
        rows = self._clustered(0).groupBy("cluster").agg(F.avg("__sum0").alias("m")).orderBy("cluster").collect()
        return [r["m"] for r in rows]
