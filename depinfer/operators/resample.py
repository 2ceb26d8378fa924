"""Resampling test and interval that are robust to dependence of unknown form.

Products of random pairs of standardised values are summed in ``draws`` sets of
``size`` pairs.  A pair is two different positions drawn by counter-based
hashes, which has the law of a uniform draw from all pairs without listing them.
For the interval, the sum at any mean is ``A - m B + size m**2`` with
``A = sum of products`` and ``B = sum of sums``: one pass serves all grid points.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depinfer.functions import dist, rng
from depinfer.functions.storage import cut, release, with_index


#: Values up to which the drawn positions are looked up in a broadcast array (8 bytes each).
BROADCAST_VALUES = 8_000_000
#: Pairs that a task draws at once, and that are joined with their values at a time where these are not broadcast.
TASK_PAIRS, JOINED_PAIRS = 4_000_000, 100_000_000


def _numbers(spark: SparkSession, start: int, stop: int) -> DataFrame:
    return spark.range(start, stop, 1, max(spark.sparkContext.defaultParallelism, -(-(stop - start) // TASK_PAIRS))).withColumnRenamed("id", "k")


def _pairs(z: DataFrame, n: int, size: int, start: int, stop: int, seed) -> DataFrame:
    """``draw, i, j``: the positions of the pairs from ``start`` to ``stop``."""
    ids = _numbers(z.sparkSession, start, stop)
    first = rng.below(n, f"{seed}/i", F.col("k"))
    pairs = ids.select(F.expr(f"k div {size}").alias("draw"), first.alias("i"), rng.below(n - 1, f"{seed}/j", F.col("k")).alias("step"))
    return pairs.select("draw", "i", ((F.col("i") + 1 + F.col("step")) % n).alias("j"))


def _sums_of(shared, n: int, size: int, seed):
    """Pairs by their numbers: sums of the products and of the sums of the values at drawn positions, for each draw of a task."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        value, first, held = shared.value, None, np.zeros((2, 0))
        for batch in batches:
            k = batch.column("k").to_numpy()
            if not len(k):
                continue
            draw, i = k // size, rng.below_of(n, f"{seed}/i", k)
            j = (i + 1 + rng.below_of(n - 1, f"{seed}/j", k)) % n
            first = int(draw[0]) if first is None else first
            u, v, at = value[i], value[j], draw - first
            if at[-1] >= held.shape[1]:
                held = np.hstack([held, np.zeros((2, max(int(at[-1]) + 1 - held.shape[1], held.shape[1])))])
            lo = int(at[0])
            for row, x in zip(held, (u * v, u + v)):
                part = np.bincount(at - lo, weights=x)
                row[lo : lo + len(part)] += part
            last = int(at[-1])
        for at in range(0, last + 1 if first is not None else 0, 10_000):
            a, b = held[:, at : min(at + 10_000, last + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a)) + first + at), pa.array(a), pa.array(b)], names=["draw", "a", "b"])

    return sums


def _draw_sums(z: DataFrame, n: int, size: int, draws: int, seed) -> DataFrame:
    """``draw, a, b``: sums of the products and of the sums of each draw's pairs of values; ``z`` has ``idx, value``.

    Up to ``BROADCAST_VALUES`` values no pair is shuffled or written; beyond that
    pairs are joined with them, ``JOINED_PAIRS`` at a time, and only sums are kept.
    """
    import numpy as np

    spark = z.sparkSession
    if n <= BROADCAST_VALUES:
        table = z.select("idx", F.col("value").cast("double")).toArrow()
        held = np.empty(n)
        held[table.column("idx").to_numpy()] = table.column("value").to_numpy()
        shared = spark.sparkContext.broadcast(held)
        found = _numbers(spark, 0, draws * size).mapInArrow(_sums_of(shared, n, size, seed), "draw bigint, a double, b double")
        return cut(found.groupBy("draw").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    u, v = z.select(F.col("idx").alias("i"), F.col("value").alias("u")), z.select(F.col("idx").alias("j"), F.col("value").alias("v"))
    parts = []
    for start in range(0, draws * size, JOINED_PAIRS):
        pairs = _pairs(z, n, size, start, min(start + JOINED_PAIRS, draws * size), seed).join(u, "i").join(v, "j")
        parts.append(cut(pairs.groupBy("draw").agg(F.sum(F.col("u") * F.col("v")).alias("a"), F.sum(F.col("u") + F.col("v")).alias("b"))))
        release(spark)
    return reduce(DataFrame.unionByName, parts).groupBy("draw").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _moments(df: DataFrame, column: str):
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd")).first()


def drobust_test(df: DataFrame, column: str, mu: float, alpha: float = 0.05, beta: float = 0.01, size: int | None = None, draws: int = 1000, seed=0) -> dict:
    """``{"rcf", "result"}``: the share of draws below the critical value, and the conclusion."""
    if not 0 < beta <= alpha:
        raise ValueError("beta must be positive and at most alpha")
    m = _moments(df, column)
    n, size = m["n"], size or m["n"]
    z = cut(with_index(df.select("id", ((F.col(column) - mu) / m["sd"]).alias("value")), "id"))
    critical = dist.chi2_one_quantile(1 - alpha + beta)
    root = float(size) ** 0.5
    sums = _draw_sums(z, n, size, draws, seed).select("draw", (F.col("a") / root).alias("s"))
    rcf = sums.agg(F.avg(((F.col("s") - _bias(n, size)) ** 2 <= F.lit(critical)).cast("double"))).first()[0]
    return {"rcf": rcf, "result": "Not reject" if rcf >= 1 - alpha else "Reject"}


def _bias(n: int, size: int) -> float:
    """What a set's standardised sum is off by on average under the hypothesis."""
    return size**0.5 / n


def drobust_grid(df: DataFrame, column: str, start: float, stop: float, grid_size: int = 151, coverage: float = 0.95, beta: float = 0.01, size: int | None = None, draws: int = 1000, seed=0) -> DataFrame:
    """``point, mu, rcf, accepted`` for each grid point but the first."""
    alpha = 1 - coverage
    if not 0 < beta <= alpha:
        raise ValueError("beta must be positive and at most 1 - coverage")
    if stop <= start:
        raise ValueError("the grid must rise")
    m = _moments(df, column)
    n, size = m["n"], size or m["n"]
    # Centred first, so that the terms of the square stay small.
    z = cut(with_index(df.select("id", ((F.col(column) - m["mean"]) / m["sd"]).alias("value")), "id"))
    sums = _draw_sums(z, n, size, draws, seed)
    critical, root = dist.chi2_one_quantile(1 - alpha + beta), float(size) ** 0.5
    point = F.explode(F.sequence(F.lit(1), F.lit(grid_size - 1)))
    placed = sums.withColumn("point", point).withColumn("mu", grid_value(F.col("point"), start, stop, grid_size))
    at = (F.col("mu") - m["mean"]) / m["sd"]
    s = (F.col("a") - at * F.col("b") + float(size) * at * at) / root - _bias(n, size)
    shares = placed.groupBy("point").agg(F.first("mu").alias("mu"), F.avg((s * s <= F.lit(critical)).cast("double")).alias("rcf"))
    return shares.withColumn("accepted", F.col("rcf") >= coverage)


def grid_value(point, start: float, stop: float, grid_size: int):
    return F.when(point == grid_size - 1, F.lit(float(stop))).otherwise(F.lit(float(start)) + point * ((stop - start) / (grid_size - 1)))


def hull(grid: DataFrame, start: float, stop: float) -> DataFrame:
    """``ci_lo, ci_hi``: the hull of the accepted points, or the whole grid without any."""
    lo, hi = F.min(F.when(F.col("accepted"), F.col("mu"))), F.max(F.when(F.col("accepted"), F.col("mu")))
    return grid.agg(F.coalesce(lo, F.lit(float(start))).alias("ci_lo"), F.coalesce(hi, F.lit(float(stop))).alias("ci_hi"))


def drobust_ci(df: DataFrame, column: str, start: float, stop: float, **options) -> DataFrame:
    return hull(drobust_grid(df, column, start, stop, **options), start, stop)


# Executors need no copy of the package for the functions that they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
