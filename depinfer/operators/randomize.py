"""Inference from a few cluster estimates: t-statistic, randomization test and interval.

There is one estimate per cluster, so a vector of them is small; sign vectors
are rows, and only their sums ``S = sum sign * z`` and ``N = sum sign`` matter:
the mean at any hypothesis is ``(S - mu N) / q``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depinfer.functions import dist, rng
from depinfer.operators.resample import grid_value, hull

#: Clusters up to which all sign vectors are enumerated, and the draws beyond.
ENUMERATED, DRAWN = 12, 5000


def trobust_ci(z: Sequence[float], coverage: float = 0.95) -> tuple[float, float]:
    """Mean plus and minus the t quantile times the standard error (population deviation)."""
    if 1 - coverage > 0.08326:
        raise ValueError("the interval is valid for a coverage of at least 0.91674")
    q = len(z)
    mean = sum(z) / q
    half = dist.t_quantile(1 - (1 - coverage) / 2, q - 1) * (sum((x - mean) ** 2 for x in z) / q) ** 0.5 / q**0.5
    return mean - half, mean + half


def sign_sums(spark: SparkSession, z: Sequence[float], seed=0) -> DataFrame:
    """``g, s, n``: the sums of each sign vector; vector 0 is all plus where they are enumerated."""
    q = len(z)
    if q <= ENUMERATED:
        signs = [F.lit(1.0) - F.lit(2.0) * F.expr(f"shiftright(id, {c}) & 1") for c in range(q)]
        rows = spark.range(1 << q)
    else:
        signs = [F.when(rng.uniform(seed, F.col("id"), c) < 0.5, 1.0).otherwise(-1.0) for c in range(q)]
        rows = spark.range(DRAWN)
    s, n = F.lit(0.0), F.lit(0.0)
    for sign, x in zip(signs, z):
        s, n = s + sign * F.lit(float(x)), n + sign
    return rows.select(F.col("id").alias("g"), s.alias("s"), n.alias("n"))


def _observed(z: Sequence[float]) -> float:
    """The sum of the estimates, added in the order that the rows use."""
    total = 0.0
    for x in z:
        total += float(x)
    return total


def arand_test(spark: SparkSession, z: Sequence[float], mu: float, seed=0) -> tuple[float, float]:
    """``(p-value, statistic)``: the share of sign vectors whose statistic is not below the observed one."""
    q = len(z)
    centred = [float(x) - mu for x in z]
    t = abs(_observed(centred)) / q
    sums = sign_sums(spark, centred, seed)
    return sums.agg(F.avg((F.abs(F.col("s")) / q >= F.lit(t)).cast("double"))).first()[0], t


def arand_grid(spark: SparkSession, z: Sequence[float], start: float, stop: float, grid_size: int = 151, coverage: float = 0.95, seed=0) -> DataFrame:
    """``point, mu, p_value, accepted`` for each grid point but the first."""
    if stop <= start:
        raise ValueError("the grid must rise")
    q, total = len(z), _observed(z)
    placed = sign_sums(spark, z, seed).withColumn("point", F.explode(F.sequence(F.lit(1), F.lit(grid_size - 1))))
    placed = placed.withColumn("mu", grid_value(F.col("point"), start, stop, grid_size))
    t = F.abs(F.lit(total) - F.col("mu") * F.lit(float(q)))
    shares = placed.groupBy("point").agg(F.first("mu").alias("mu"), F.avg((F.abs(F.col("s") - F.col("mu") * F.col("n")) >= t).cast("double")).alias("p_value"))
    return shares.withColumn("accepted", F.col("p_value") > 1 - coverage)


def arand_ci(spark: SparkSession, z: Sequence[float], start: float, stop: float, **options) -> DataFrame:
    return hull(arand_grid(spark, z, start, stop, **options), start, stop)
