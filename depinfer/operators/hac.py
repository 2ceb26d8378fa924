"""Network HAC: the kernel-weighted variance of scores over balls in the network."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import inf, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.functions.storage import cut
from depinfer.operators import graph as G
from depinfer.operators.summary import average_path


@dataclass
class Hac:
    matrix: object
    bandwidth: int
    pd_failure: bool
    measure: Callable[[], float]

    @cached_property
    def apl(self) -> float:
        """The average path length; measured when asked for, as a given bandwidth does not need it."""
        return self.measure()


def demean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns minus their means; the means are one row, broadcast."""
    means = df.agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    return df.crossJoin(F.broadcast(means)).select(*(c for c in df.columns if c not in columns), *((F.col(c) - F.col(f"__{c}")).alias(c) for c in columns))


def default_bandwidth(apl: float, n: int, average_degree: float) -> int:
    """Half the average path if paths grow with the logarithm of n, else its cube root; rounded half to even."""
    growth = log(average_degree) if average_degree > 0 else -inf
    threshold = inf if growth == 0 else 2 * log(n) / growth
    return round(apl / 2) if apl < threshold else round(apl ** (1 / 3))


def cross_product(df: DataFrame, left: Sequence[str], right: Sequence[str]):
    """Sums of products of columns, as a small matrix; one aggregation."""
    import numpy as np

    row = df.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right))).first()
    return np.array([float(x or 0.0) for x in row]).reshape(len(left), len(right))


def _over_ball(pairs: DataFrame, values: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``id`` and the sums of the columns over each node's ball."""
    return pairs.join(values.withColumnRenamed("id", "j"), "j").groupBy(F.col("i").alias("id")).agg(*(F.sum(c).alias(f"ball_{c}") for c in columns))


def bandwidth_rule(nodes: DataFrame, edges: DataFrame) -> tuple[float, int, float]:
    """``(average path length, bandwidth, average degree)``."""
    apl, _, _ = average_path(nodes, edges)
    row = G.degrees(nodes, G.symmetrise(edges)).agg(F.count("*"), F.avg("degree")).first()
    return apl, default_bandwidth(apl, row[0], row[1]), row[1]


def kernel_variance(z: DataFrame, columns: Sequence[str], pairs: DataFrame):
    """Sums of products of each node's values with those of its ball, over n."""
    return _kernel(z, columns, _over_ball(pairs, z, columns))


def _kernel(z: DataFrame, columns: Sequence[str], sums: DataFrame):
    return cross_product(z.join(sums, "id"), columns, [f"ball_{c}" for c in columns]) / z.count()


def normalised_kernel_variance(z: DataFrame, columns: Sequence[str], pairs: DataFrame):
    """The same with values over the root of the ball's size and the kernel squared: semi-definite.

    The kernel is symmetric, so its square needs one sum over balls.
    """
    size = pairs.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("r"))
    names = [f"ball_{c}" for c in columns]
    return cross_product(_over_ball(pairs, _scaled(z, columns, size), columns), names, names) / z.count()


def _scaled(z: DataFrame, columns: Sequence[str], size: DataFrame) -> DataFrame:
    """The values over the root of the size ``r`` of their ball."""
    return z.join(size.select("id", "r"), "id").select("id", *((F.col(c) / F.sqrt("r")).alias(c) for c in columns))


def network_hac(scores: DataFrame, columns: Sequence[str], edges: DataFrame | None = None, b: int | None = None) -> Hac:
    """Variance matrix of ``columns`` of ``scores`` (id, columns) with uniform kernel up to ``b`` hops.

    Without positive definiteness the normalised kernel takes over; with ``b = 0``
    both kernels are the identity, so the failure is only reported.
    """
    z = cut(demean(scores.select("id", *columns), columns))
    if b == 0:
        return _checked(cross_product(z, columns, columns) / z.count(), lambda: 0.0, 0, None)
    nodes, measure = z.select("id"), lambda: average_path(z.select("id"), edges)[0]
    if b is None:
        apl, b, _ = bandwidth_rule(nodes, edges)
        measure = lambda: apl
    sums, names = G.ball_sums(z, edges, b, columns), [f"ball_{c}" for c in columns]

    def normalised():
        return cross_product(G.ball_sums(_scaled(z, columns, sums), edges, b, columns), names, names) / z.count()

    return _checked(_kernel(z, columns, sums), measure, b, normalised)


def _checked(matrix, measure: Callable[[], float], b: int, fallback) -> Hac:
    import numpy as np

    symmetric = (matrix + matrix.T) / 2
    failed = bool((np.linalg.eigvalsh(symmetric) <= 0).any())
    return Hac(fallback() if failed and fallback else symmetric, b, failed, measure)
