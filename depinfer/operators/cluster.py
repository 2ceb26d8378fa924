"""Clusters of a network: conductance, cluster variance, spectra, spectral clustering."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depinfer.functions.storage import cut, discard, running_sum, with_index
from depinfer.operators import graph as G
from depinfer.operators.hac import cross_product, demean

#: Nodes up to which all eigenvalues are computed densely on the driver (8 n**2 bytes), and up to which eigenvectors are.
SPECTRUM_NODES, DENSE_NODES = 20_000, 5_000
#: Distance of neighbours in the best order up to which a network's matrix is made tridiagonal by rotations.
BAND = 8
#: Steps of the Lanczos process for each row at most, and width within which its eigenvalues are told apart.
LANCZOS_MOST, LANCZOS_WIDTH = 8, 1e-10
#: Columns of a block when eigenvalues are computed on the executors, and bytes that it has at most.
BLOCK_COLUMNS, BLOCK_BYTES = 512, 32 << 20
#: Entries that a sparse product on the driver takes at a time.
PRODUCT_ENTRIES = 1 << 13
#: Entries of the Laplacian up to which its sparse products are made on the driver (24 bytes each).
SPARSE_ENTRIES = 4_000_000
#: Restarts of k-means that run at once.
RESTARTS_AT_ONCE = 6
#: Cycles of filter (or inverse) and Rayleigh-Ritz before eigenvectors are given up.
CYCLES = 100


def conductance(clusters: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``cluster, cut, volume, conductance``; volumes below 1 count as 1."""
    both = G.symmetrise(edges, weight)
    ends = both.join(clusters.select(F.col("id").alias("src"), F.col("cluster").alias("ls")), "src").join(clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("lt")), "dst")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = ends.groupBy(F.col("ls").alias("cluster")).agg(F.sum(F.when(F.col("ls") != F.col("lt"), w).otherwise(0.0)).alias("cut"), F.sum(w).alias("volume"))
    out = clusters.select("cluster").distinct().join(sums, "cluster", "left").na.fill(0.0, ["cut", "volume"])
    return out.withColumn("conductance", F.col("cut") / F.greatest("volume", F.lit(1.0)))


def max_conductance(clusters: DataFrame, edges: DataFrame, weight: str | None = None) -> float:
    return float(conductance(clusters, edges, weight).agg(F.max("conductance")).first()[0] or 0.0)


def positional_labels(labelled: DataFrame) -> DataFrame:
    """Labels by position: blocks in the order of the sorted labels, laid over the rows in id order.

    Blocks and rows meet by stretches of a block's average length, of which a
    block overlaps about two.
    """
    sizes = running_sum(labelled.groupBy("cluster").agg(F.count("*").alias("size")), "size", "cluster", name="lo")
    total = sizes.agg(F.count("*").alias("k"), F.sum("size").alias("n")).first()
    stretch = max(1, (total["n"] or 1) // max(total["k"], 1))
    blocks = sizes.select("cluster", "lo", (F.col("lo") + F.col("size")).alias("hi"), F.explode(F.expr(f"sequence(lo div {stretch}, (lo + size - 1) div {stretch})")).alias("stretch"))
    indexed = with_index(labelled.drop("cluster"), "id").withColumn("stretch", F.expr(f"idx div {stretch}"))
    return indexed.join(blocks, "stretch").filter("idx >= lo and idx < hi").drop("idx", "lo", "hi", "stretch")


def cluster_var(scores: DataFrame, columns: Sequence[str], layout: str = "labels"):
    """Cluster-robust variance matrix of ``scores`` (id, cluster, columns).

    ``layout="positional"`` takes the rows in id order for the blocks of the
    sorted labels, whatever their own labels: right only for sorted rows.
    """
    z = demean(scores.select("id", "cluster", *columns), columns)
    if layout == "positional":
        z = positional_labels(z)
    sums = z.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in columns))
    return cross_product(sums, columns, columns) / scores.count()


def _entries(nodes: DataFrame, entries: DataFrame):
    """The ids in order, and the entries' positions and values."""
    import numpy as np

    ids, table = np.sort(nodes.select("id").toPandas()["id"].to_numpy()), entries.toPandas()
    return ids, *(np.searchsorted(ids, table[c].to_numpy()) for c in ("src", "dst")), table["value"].to_numpy()


def _dense(nodes: DataFrame, edges: DataFrame, weight: str | None):
    import numpy as np

    ids, i, j, value = _entries(nodes, G.laplacian(nodes, edges, weight))
    matrix = np.zeros((len(ids), len(ids)))
    np.add.at(matrix, (i, j), value / 2)
    np.add.at(matrix, (j, i), value / 2)
    return ids, matrix


def spectrum(nodes: DataFrame, edges: DataFrame, giant: bool = True, weight: str | None = None) -> DataFrame:
    """``rank, eigenvalue`` of the normalised Laplacian, ascending.

    Up to ``SPECTRUM_NODES`` nodes by a dense solver on the driver.  Beyond that
    a network that can be put in an order in which neighbours are at most
    ``BAND`` apart is made tridiagonal there, and its eigenvalues are bisected on
    the executors; others go by :func:`_lanczos_eigenvalues`, and where that does
    not prove to have all of them (as with multiple ones) by :func:`spread_eigenvalues`.
    """
    import numpy as np

    if giant:
        nodes = cut(G.giant(G.components(nodes, edges)))
        edges = cut(G.induced(edges, nodes))
    spark, n = nodes.sparkSession, nodes.count()
    if n > SPECTRUM_NODES:
        entries = cut(G.laplacian(nodes, edges, weight))
        if entries.count() <= SPARSE_ENTRIES:
            matrix = _symmetric(n, *_entries(nodes, entries)[1:])
            if (bands := _narrow(*matrix)) is not None:
                return _tridiagonal_spectrum(spark, *bands)
            if (values := _lanczos_eigenvalues(spark, *matrix)) is not None:
                return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "rank bigint, eigenvalue double")
        values = spread_eigenvalues(with_index(nodes.select("id"), "id"), entries, n)
        return with_index(values, "eigenvalue", "column", name="rank").select("rank", "eigenvalue")
    values = np.linalg.eigvalsh(_dense(nodes, edges, weight)[1])
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "rank bigint, eigenvalue double")


def _symmetric(n: int, i, j, values):
    """Diagonal, and positions and values of the entries off it, each place once; the mean of both triangles."""
    import numpy as np

    off = i != j
    key = np.concatenate([i[off] * n + j[off], j[off] * n + i[off]])
    key, at = np.unique(key, return_inverse=True)
    v = np.bincount(at, np.concatenate([values[off], values[off]]) / 2, minlength=len(key))
    return np.bincount(i[~off], values[~off], minlength=n), key // n, key % n, v


def _narrow(diagonal, i, j, v):
    """Diagonal and subdiagonal of a tridiagonal matrix with the same eigenvalues, or None where no order keeps entries within ``BAND``."""
    import numpy as np

    from depinfer.functions.sparse import band_to_tridiagonal, narrow_order

    n = len(diagonal)
    at, width = narrow_order(n, i, j)
    if width > BAND:
        return None
    band = np.zeros((width + 1, n))
    band[0, at] = diagonal
    below = at[i] > at[j]
    band[(at[i] - at[j])[below], at[j][below]] = v[below]
    return band_to_tridiagonal(list(band))


def _tridiagonal_spectrum(spark, diagonal, off) -> DataFrame:
    """``rank, eigenvalue`` of a tridiagonal matrix, bisected in tasks."""
    import pyarrow as pa

    from depinfer.functions.sparse import tridiagonal_eigenvalues

    def bisect(batches):
        for batch in batches:
            rank = batch.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(tridiagonal_eigenvalues(diagonal, off, rank))], names=["rank", "eigenvalue"])

    return cut(spark.range(0, len(diagonal), 1, spark.sparkContext.defaultParallelism).mapInArrow(bisect, "rank bigint, eigenvalue double"))


def _lanczos_eigenvalues(spark, diagonal, i, j, v):
    """All eigenvalues, ascending, of a sparse symmetric matrix whose eigenvalues are simple and in [0, 2]; None where that is not certain.

    The Lanczos process without reorthogonalisation finds each eigenvalue, most
    of them repeatedly, and others on their way there.  Those within
    ``LANCZOS_WIDTH`` that the last three parts of the process agree on count.
    They are all if there are as many as rows and their sum and sum of squares
    are those of the matrix; else the process goes on, up to ``LANCZOS_MOST``
    steps a row.  It runs on the driver, bisection in tasks.
    """
    import numpy as np
    import pyarrow as pa

    from depinfer.functions.sparse import Lanczos, settled, sturm

    n = len(diagonal)
    total, squares = diagonal.sum(), (diagonal**2).sum() + (v**2).sum()
    process, tasks, found = Lanczos(diagonal, i, j, v), spark.sparkContext.defaultParallelism, []
    while len(process.alpha) < LANCZOS_MOST * n:
        if not process.run(5 * n // 2 if not found else n // 2):
            return None
        alpha, beta, steps = process.alpha, process.beta[:-1] ** 2, len(process.alpha)
        rows = [steps - n // 10, steps - n // 20]
        # Tasks get parts of the range with about as many eigenvalues each.
        grid = np.linspace(-1e-6, 2 + 1e-6, 64 * tasks + 1)
        bounds = np.interp(np.linspace(0, steps, tasks + 1), np.maximum.accumulate(sturm(alpha, beta, grid) + np.arange(len(grid)) * 1e-6), grid)
        bounds[0], bounds[-1] = grid[0], grid[-1]

        def part(batches, alpha=alpha, beta=beta, rows=rows, bounds=bounds):
            for batch in batches:
                for t in batch.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in settled(alpha, beta, rows, bounds[t], bounds[t + 1], 2 * n // tasks + 1, LANCZOS_WIDTH)], names=["a", "b", "all"])

        table = spark.range(0, tasks, 1, tasks).mapInArrow(part, "a double, b double, all boolean").toArrow().sort_by("a")
        a, b, every = (table.column(c).to_numpy() for c in ("a", "b", "all"))
        # Cells that all but touch hold one eigenvalue, or also a late one on its way there.
        start = np.flatnonzero(np.r_[True, a[1:] - b[:-1] > 10 * LANCZOS_WIDTH])
        sure = np.maximum.reduceat(every, start)
        values = ((a[start] + b[np.r_[start[1:], len(b)] - 1]) / 2)[sure]
        if len(values) == n and abs(values.sum() - total) < 1e-6 and abs((values**2).sum() - squares) < 1e-6:
            return values
        found.append(len(values))
        if found[-3:] == [found[-1]] * 3:
            # Some eigenvalues are multiple, which no further step shows.
            return None
    return None


def _round_robin(blocks: int) -> list[list[int]]:
    """For each round the pair that each block belongs to; every two blocks meet once in ``blocks - 1`` rounds (an even number)."""
    rounds, ring = [], list(range(blocks))
    for _ in range(blocks - 1):
        pair = [0] * blocks
        for k in range(blocks // 2):
            pair[ring[k]] = pair[ring[-1 - k]] = k
        rounds.append(pair)
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


def _rotate(table, tolerance: float):
    """One-sided Jacobi step on two blocks of columns: turned until orthogonal, unless they are; ``off`` is how far they were from it."""
    import numpy as np
    import pyarrow as pa

    # Shorter columns go to the smaller block, whatever order the rows come in: else columns would wander and some never meet.
    table = table.sort_by("block")
    blocks = table.column("block").to_pylist()
    parts = [np.frombuffer(x, np.float64).reshape(k, -1) for x, k in zip(table.column("data").to_pylist(), table.column("columns").to_pylist())]
    x = np.vstack(parts)
    gram = x @ x.T
    size = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    off = np.abs(gram - np.diag(np.diag(gram)))
    worst = float((off / np.maximum(np.outer(size, size), 1e-16 * np.diag(gram).max())).max()) if len(x) > 1 else 0.0
    if worst > tolerance:
        x = np.linalg.eigh(gram)[1].T @ x
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    turned = np.split(x, cuts)
    return pa.table({"block": pa.array(blocks, pa.int32()), "columns": pa.array([len(p) for p in parts], pa.int32()), "data": pa.array([p.tobytes() for p in turned], pa.binary()), "off": pa.array([worst] * len(blocks))})


def spread_eigenvalues(indexed: DataFrame, entries: DataFrame, n: int, tolerance: float = 1e-10) -> DataFrame:
    """``column, eigenvalue`` of the symmetric matrix ``entries`` with eigenvalues from 0 to 2, on the executors.

    One-sided Jacobi on blocks of columns of the matrix plus the identity, which
    is definite: each pair of blocks is turned until its columns are orthogonal;
    sweeps over all pairs go on until one turns none, as all are within
    ``tolerance`` of that.  The columns' lengths then are the eigenvalues plus 1.  A task
    holds two blocks of ``BLOCK_COLUMNS`` columns, fewer where these take more than
    ``BLOCK_BYTES``; a round's files go after the next.
    """
    import numpy as np
    import pyarrow as pa

    blocks = -(-n // max(1, min(BLOCK_COLUMNS, BLOCK_BYTES // (8 * n))))
    blocks += blocks % 2
    blocks = max(blocks, 2)
    at = indexed.select(F.col("id"), F.col("idx"))
    placed = entries.join(at.select(F.col("id").alias("src"), F.col("idx").alias("i")), "src").join(at.select(F.col("id").alias("dst"), F.col("idx").alias("j")), "dst")
    half = placed.select("i", "j", (F.col("value") / 2).alias("v"))
    full = half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).unionByName(at.select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("v")))

    def fill(table):
        i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "v"))
        block = int(j[0]) % blocks
        columns = len(range(block, n, blocks))
        x = np.zeros((columns, n))
        np.add.at(x, (j // blocks, i), v)
        return pa.table({"block": pa.array([block], pa.int32()), "columns": pa.array([columns], pa.int32()), "data": pa.array([x.tobytes()], pa.binary()), "off": pa.array([0.0])})

    schema = "block int, columns int, data binary, off double"
    state = cut(full.groupBy(F.expr(f"j % {blocks}")).applyInArrow(fill, schema))
    worst, before = float("inf"), float("inf")
    while worst > tolerance:
        offs = []
        for pair in _round_robin(blocks):
            which = F.element_at(F.array(*(F.lit(p) for p in pair)), F.col("block") + 1)
            old, state = state, cut(state.groupBy(which.alias("pair")).applyInArrow(lambda t: _rotate(t, tolerance), schema))
            discard(old)
            offs.append(state.agg(F.max("off")).first()[0])
        worst = max(offs)
        if worst > tolerance and worst >= before and before < 1e-6:
            raise ValueError(f"eigenvalues did not converge: columns are {worst:.1e} from orthogonal")
        before = worst

    def lengths(batches):
        for batch in batches:
            for block, columns, data in zip(*(batch.column(c).to_pylist() for c in ("block", "columns", "data"))):
                size = np.sqrt((np.frombuffer(data, np.float64).reshape(columns, -1) ** 2).sum(axis=1)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(columns) * blocks + block), pa.array(size)], names=["column", "eigenvalue"])

    return state.mapInArrow(lengths, "column bigint, eigenvalue double")


def spectrum_moments(nodes: DataFrame, edges: DataFrame, giant: bool = True, weight: str | None = None) -> DataFrame:
    """``n, total, squares``: how many eigenvalues there are, their sum and that of their squares.

    These are the size, the trace and the sum of the squared entries of the
    normalised Laplacian, so they need no eigenvalues and no dense matrix.
    """
    if giant:
        nodes = cut(G.giant(G.components(nodes, edges)))
        edges = G.induced(edges, nodes)
    entries = G.laplacian(nodes, edges, weight)
    value = F.col("value")
    if weight:
        # The dense form takes the mean of both triangles.
        pairs = entries.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "value")
        entries = pairs.groupBy("a", "b").agg(F.sum("value").alias("value")).select(F.col("a").alias("src"), F.col("b").alias("dst"), "value")
        squares = F.sum(F.when(F.col("src") == F.col("dst"), value * value).otherwise(value * value / 2))
    else:
        squares = F.sum(value * value)
    sums = entries.agg(F.sum(F.when(F.col("src") == F.col("dst"), value)).alias("total"), squares.alias("squares"))
    return nodes.agg(F.count("*").alias("n")).crossJoin(sums).na.fill(0.0, ["total", "squares"])


def spectrum_histogram(values: DataFrame, bins: int = 20) -> DataFrame:
    """``bin, lo, hi, n``: how many eigenvalues lie in each of ``bins`` parts of [0, 2]."""
    width = 2.0 / bins
    at = F.least(F.greatest(F.floor(F.col("eigenvalue") / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").na.fill(0, ["n"]).select("bin", (F.col("bin") * width).alias("lo"), ((F.col("bin") + 1) * width).alias("hi"), "n")


def network_histogram(nodes: DataFrame, edges: DataFrame, bins: int = 20, giant: bool = True, weight: str | None = None) -> DataFrame:
    """:func:`spectrum_histogram` of the network's :func:`spectrum`; narrow networks only count their eigenvalues below the inner edges."""
    import numpy as np

    from depinfer.functions.sparse import sturm

    if giant:
        nodes = cut(G.giant(G.components(nodes, edges)))
        edges = cut(G.induced(edges, nodes))
    spark, n, width = nodes.sparkSession, nodes.count(), 2.0 / bins
    entries = cut(G.laplacian(nodes, edges, weight)) if n > SPECTRUM_NODES else None
    if entries is not None and entries.count() <= SPARSE_ENTRIES and (bands := _narrow(*_symmetric(n, *_entries(nodes, entries)[1:]))) is not None:
        # Eigenvalues on an edge belong above it, also where rounding puts them just below.
        below = sturm(bands[0], bands[1] ** 2, np.arange(1, bins) * width - 1e-12)
        counts = np.diff(np.r_[0, below, n])
        return spark.createDataFrame([(i, i * width, (i + 1) * width, int(c)) for i, c in enumerate(counts)], "bin int, lo double, hi double, n bigint")
    return spectrum_histogram(spectrum(nodes, edges, False, weight), bins)


class _Local:
    """Blocks of vectors as arrays on the driver, in id order."""

    def __init__(self, ids, src, dst, values, m: int):
        import numpy as np

        order = np.argsort(src, kind="stable")
        self.m, self.n, self.at, self.value = m, len(ids), dst[order], values[order][:, None]
        self.rows, self.starts = np.unique(src[order], return_index=True)
        # Rows whose entries are taken together: their products stay in the processor's cache.
        part = self.starts // PRODUCT_ENTRIES
        self.parts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        self.ends = np.append(self.starts, len(order))

    def start(self):
        import numpy as np

        return np.random.default_rng(0).normal(size=(self.n, self.m))

    def product(self, x):
        import numpy as np

        out = np.zeros_like(x)
        for a, b in zip(self.parts[:-1], self.parts[1:]):
            if a < b:
                lo, hi = self.ends[a], self.ends[b]
                out[self.rows[a:b]] = np.add.reduceat(self.value[lo:hi] * x.take(self.at[lo:hi], axis=0), self.starts[a:b] - lo)
        return out

    def sum(self, *terms):
        return sum(c * x for c, x in terms)

    def gram(self, x, y):
        return x.T @ y

    def turn(self, x, matrix):
        return x @ matrix


class _Spread:
    """The same blocks as tables ``id, v0, v1, ...``; only matrices of the block's width reach the driver."""

    def __init__(self, nodes: DataFrame, entries: DataFrame, m: int):
        self.nodes, self.entries, self.names = nodes, entries, [f"v{i}" for i in range(m)]

    def start(self):
        from depinfer.functions import rng

        return cut(self.nodes.select("id", *(rng.normal(f"subspace{i}", F.col("id")).alias(c) for i, c in enumerate(self.names))))

    def product(self, x):
        return cut(G.spmv(self.nodes, self.entries, x, self.names, "value"))

    def sum(self, *terms):
        out, parts = self.nodes.select("id"), {c: F.lit(0.0) for c in self.names}
        for i, (factor, x) in enumerate(terms):
            out = out.join(x.select("id", *(F.col(c).alias(f"{c}_{i}") for c in self.names)), "id")
            for j, c in enumerate(self.names):
                parts[c] = parts[c] + F.col(f"{c}_{i}") * float(factor if isinstance(factor, float) else factor[j])
        return cut(out.select("id", *(v.alias(c) for c, v in parts.items())))

    def gram(self, x, y):
        return cross_product(x.join(y.select("id", *(F.col(c).alias(f"{c}_y") for c in self.names)), "id"), self.names, [f"{c}_y" for c in self.names])

    def turn(self, x, matrix):
        return cut(x.select("id", *(sum((F.col(c) * float(matrix[i, j]) for i, c in enumerate(self.names)), F.lit(0.0)).alias(self.names[j]) for j in range(len(self.names)))))


def _smallest(on, k: int):
    """The ``k`` smallest eigenvalues of the normalised Laplacian and a block whose first ``k`` columns are their vectors.

    Chebyshev-filtered subspace iteration: a polynomial that is small from the
    block's largest Ritz value up to 2, then Rayleigh-Ritz.  It ends when the
    residuals are far below the gap after the ``k``-th value, and raises if that
    is not reached.
    """
    import numpy as np

    x, bound = on.start(), None
    for _ in range(CYCLES):
        if bound is not None:
            centre, half = (2.0 + bound) / 2, (2.0 - bound) / 2
            first = sigma = -half / centre
            y = on.sum((sigma / half, on.product(x)), (-centre * sigma / half, x))
            for _ in range(int(np.clip(np.ceil(8 / np.sqrt(2 * bound)), 10, 2000)) - 1):
                step = 1 / (2 / first - sigma)
                x, y, sigma = y, on.sum((2 * step / half, on.product(y)), (-2 * centre * step / half, y), (-sigma * step, x)), step
            x = y
        for _ in range(2):
            values, vectors = np.linalg.eigh(on.gram(x, x))
            x = on.turn(x, vectors / np.sqrt(np.maximum(values, 1e-15 * values[-1])))
        z = on.product(x)
        inner = on.gram(x, z)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        x, z = on.turn(x, vectors), on.turn(z, vectors)
        rest = on.sum((1.0, z), (-values, x))
        errors = np.sqrt(np.maximum(np.diag(on.gram(rest, rest))[:k], 0.0))
        gap = values[k] - values[k - 1] if len(values) > k else 1.0
        if errors.max() <= max(1e-5 * gap, 1e-12):
            return values[:k], x
        bound = float(np.clip(values[-1], 1e-9, 1.9))
    raise ValueError(f"eigenvectors did not converge: residual {errors.max():.1e} at a gap of {gap:.1e}")


def _factor(n: int, i, j, values, shift: float):
    """The symmetric matrix with these entries, less ``shift``, factored."""
    from depinfer.functions.sparse import Factor

    diagonal, i, j, v = _symmetric(n, i, j, values)
    return Factor(diagonal - shift, i, j, v)


def _smallest_inverse(on: _Local, factor, k: int):
    """What :func:`_smallest` gives, by subspace iteration with the inverse of the Laplacian plus a shift, as ``factor`` solves for it."""
    import numpy as np

    x = on.start()
    for _ in range(CYCLES):
        x = factor.solve(x)
        x = np.linalg.qr(x / np.linalg.norm(x, axis=0))[0]
        z = on.product(x)
        inner = on.gram(x, z)
        values, vectors = np.linalg.eigh((inner + inner.T) / 2)
        x, z = x @ vectors, z @ vectors
        errors = np.linalg.norm(z - values * x, axis=0)[:k]
        gap = values[k] - values[k - 1] if len(values) > k else 1.0
        if errors.max() <= max(1e-5 * gap, 1e-12):
            return values[:k], x
    raise ValueError(f"eigenvectors did not converge: residual {errors.max():.1e} at a gap of {gap:.1e}")


def _eigenvectors(inside: DataFrame, links: DataFrame, k: int, weight: str | None) -> DataFrame:
    """``id, v``: the entries of the ``k`` smallest eigenvectors; the largest entry of each is positive."""
    import numpy as np

    spark, n = inside.sparkSession, inside.count()
    m = min(n, 4 * k + 16)
    entries = None if n <= DENSE_NODES else cut(G.laplacian(inside, links, weight))
    if entries is not None and entries.count() > SPARSE_ENTRIES:
        _, x = _smallest(_Spread(inside, entries, m), k)
        names = [f"v{i}" for i in range(k)]
        sign = x.agg(*(F.signum(F.max_by(c, F.struct(F.abs(c), -F.col("id")))).alias(c) for c in names)).first()
        return x.select("id", F.array(*(F.col(c) * float(sign[c]) for c in names)).alias("v"))
    if entries is None:
        ids, matrix = _dense(inside, links, weight)
        _, vectors = np.linalg.eigh(matrix)
    else:
        ids, table = np.sort(inside.select("id").toPandas()["id"].to_numpy()), entries.orderBy("src", "dst").toPandas()
        at = [np.searchsorted(ids, table[c].to_numpy()) for c in ("src", "dst")]
        values, on = table["value"].to_numpy(), _Local(ids, *at, table["value"].to_numpy(), m)
        # The smallest positive eigenvalue of a path, the narrowest network, is about 5 / n**2.
        factor = _factor(n, *at, values, -max(0.1 / n**2, 1e-13))
        _, vectors = _smallest_inverse(on, factor, k) if factor.core is not None else _smallest(on, k)
    x = vectors[:, :k]
    # The sign of an eigenvector is free: make the largest entry positive.
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])])
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "id bigint, v array<double>")


def spectral_clustering(nodes: DataFrame, edges: DataFrame, k: int, seed: int = 0, weight: str | None = "weight", restarts: int = 30) -> DataFrame:
    """``id, cluster``: k-means on row-normalised eigenvectors of the giant component; others get label ``k``.

    The column ``weight`` counts where the edges have it.

    Up to ``DENSE_NODES`` nodes the eigenvectors come from a dense solver, beyond
    that from subspace iteration to a residual far below the gap.  Up to
    ``SPARSE_ENTRIES`` entries it runs on the driver, with the inverse where
    elimination stays sparse and with filters elsewhere; beyond, with filters on
    the executors.  k-means runs on the executors.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    weight = weight if weight in edges.columns else None
    inside = cut(G.giant(G.components(nodes, edges)))
    rows = _eigenvectors(inside, cut(G.induced(edges, inside)), k, weight)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))
    points = cut(rows.select("id", array_to_vector(F.transform("v", lambda a: a / F.greatest(norm, F.lit(1e-300)))).alias("features")))
    # A restart is many short jobs, so several run at once; of equal costs the first counts.
    with ThreadPoolExecutor(min(restarts, RESTARTS_AT_ONCE)) as pool:
        models = pool.map(lambda r: KMeans(k=k, seed=seed + r, maxIter=50).fit(points), range(restarts))
        best = min(models, key=lambda model: model.summary.trainingCost)
    labels = best.transform(points).select("id", F.col("prediction").alias("cluster"))
    return nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster", F.lit(k)).cast("int").alias("cluster"))
