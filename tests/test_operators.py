"""Small graphs that can be checked by hand, published quantiles, and dense NumPy forms."""

import numpy as np
import pytest

from depinfer.functions import dist
from depinfer.operators import cluster as C
from depinfer.operators import estimators as E
from depinfer.operators import graph as G
from depinfer.operators import hac as H
from depinfer.operators import randomize as R
from depinfer.operators import resample as RS
from depinfer.operators import simulate as S
from depinfer.operators import summary as SU

GRAPHS = {
    "tri_iso": (4, [(0, 1), (1, 2), (0, 2)]),
    "path5": (5, [(0, 1), (1, 2), (2, 3), (3, 4)]),
    "two_cliques": (8, [(a, b) for s in (0, 4) for a in range(s, s + 4) for b in range(a + 1, s + 4)] + [(3, 4)]),
    "tie": (4, [(0, 1), (2, 3)]),
    "empty": (3, []),
}


def make(spark, name):
    n, edges = GRAPHS[name]
    return spark.range(n), spark.createDataFrame(edges, "src bigint, dst bigint")


def dense(n, edges):
    a = np.zeros((n, n))
    for i, j in edges:
        a[i, j] = a[j, i] = 1
    d = np.where(a > 0, 1.0, np.inf)
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return a, d


@pytest.mark.parametrize("name", ["tri_iso", "path5", "two_cliques", "tie"])
def test_ball_and_paths(spark, name):
    n, edges = GRAPHS[name]
    _, d = dense(n, edges)
    got = {(r.i, r.j): r.d for r in G.ball(*make(spark, name), None).collect()}
    assert got == {(i, j): d[i, j] for i in range(n) for j in range(n) if np.isfinite(d[i, j])}
    lengths = {r.id: (r.total, r.furthest) for r in G.path_lengths(*make(spark, name)).collect()}
    assert lengths == {i: (d[i][np.isfinite(d[i])].sum(), d[i][np.isfinite(d[i])].max()) for i in range(n)}


def test_components_giant_tie_and_empty(spark):
    assert {r.id: r.component for r in G.components(*make(spark, "tie")).collect()} == {0: 0, 1: 0, 2: 2, 3: 2}
    assert sorted(r.id for r in G.giant(G.components(*make(spark, "tie"))).collect()) == [0, 1]
    assert {r.id: r.component for r in G.components(*make(spark, "empty")).collect()} == {0: 0, 1: 1, 2: 2}


def test_summary(spark):
    got = {r.stat: r.value for r in SU.sumstats(*make(spark, "tri_iso")).collect()}
    assert got["average_clustering"] == 0.75 and got["giant_size"] == 3 and got["isolates"] == 1 and got["components"] == 2
    assert SU.average_path(*make(spark, "path5")) == (2.0, 4, 5)


def test_default_bandwidth_of_singletons_raises(spark):
    nodes, edges = make(spark, "empty")
    with pytest.raises(ValueError):
        H.network_hac(nodes.selectExpr("id", "double(id) y"), ["y"], edges)


def test_conductance(spark):
    nodes, edges = make(spark, "two_cliques")
    clusters = nodes.selectExpr("id", "int(id div 4) cluster")
    assert C.max_conductance(clusters, edges) == pytest.approx(1 / 13)
    found = C.spectral_clustering(nodes, edges, 2, restarts=3)
    assert C.max_conductance(found, edges) == pytest.approx(1 / 13)


def test_spectral_clusters_runs_the_default_restarts(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    from depinfer.plans import catalogue

    fitted, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, *a: fitted.append(self.getSeed()) or fit(self, *a))
    assert catalogue.queries()["spectral_clusters"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(set(fitted)) == 30


def test_spectrum_moments_beyond_the_dense_size(spark, monkeypatch):
    nodes = spark.range(41)
    edges = spark.createDataFrame([(i, (i * i + 1) % 40, 1.0 + i % 3) for i in range(39)] + [(i, i + 1, 0.5) for i in range(39)], "src bigint, dst bigint, w double")
    for weight in (None, "w"):
        values = np.array([r.eigenvalue for r in C.spectrum(nodes, edges, weight=weight).collect()])
        with monkeypatch.context() as m:
            m.setattr(C, "DENSE_NODES", 10)
            found = C.spectrum_moments(nodes, edges, weight=weight).first()
        assert tuple(found) == pytest.approx((len(values), values.sum(), (values**2).sum()))


@pytest.mark.parametrize("n, k, sparse", [(900, 4, 10**6), (30, 2, 0)])
def test_eigenvectors_beyond_the_dense_size(spark, monkeypatch, n, k, sparse):
    # A path with a few chords has small gaps: 200 rounds of plain iteration are far from its vectors.
    nodes = spark.range(n)
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(i, i + 2) for i in range(0, n - 2, 7)], "src bigint, dst bigint")
    exact = np.array([r.v for r in C._eigenvectors(nodes, edges, k, None).orderBy("id").collect()])
    monkeypatch.setattr(C, "DENSE_NODES", 10)
    monkeypatch.setattr(C, "SPARSE_ENTRIES", sparse)
    found = np.array([r.v for r in C._eigenvectors(nodes, edges, k, None).orderBy("id").collect()])
    assert np.linalg.svd(exact.T @ found)[1].min() > 1 - 1e-8
    monkeypatch.setattr(C, "CYCLES", 1)
    with pytest.raises(ValueError, match="converge"):
        C._smallest(C._Local(np.arange(4), np.array([0, 1, 2, 3]), np.array([1, 0, 3, 2]), np.array([-1.0, -1.0, -0.5, -0.5]), 2), 1)


def test_eigenvectors_of_a_long_network_take_few_products(spark, monkeypatch):
    # A strip of 3,000 nodes with gaps of about 1e-6: filters take thousands of products.
    n = 3_000
    nodes = spark.range(n)
    edges = spark.range(n).selectExpr("id as src", "explode(array(id + 1, id + 2, id + 3)) as dst").filter(f"dst < {n}")
    exact = np.array([r.v for r in C._eigenvectors(nodes, edges, 3, None).orderBy("id").collect()])
    products, product = [], C._Local.product
    monkeypatch.setattr(C, "DENSE_NODES", 10)
    monkeypatch.setattr(C._Local, "product", lambda self, x: products.append(1) or product(self, x))
    found = np.array([r.v for r in C._eigenvectors(nodes, edges, 3, None).orderBy("id").collect()])
    assert np.linalg.svd(exact.T @ found)[1].min() > 1 - 1e-8
    assert len(products) < 50


@pytest.mark.parametrize("n, core", [(500, 600), (500, 5), (2_000, 50)])
def test_factor_of_a_sparse_matrix(monkeypatch, n, core):
    from depinfer.functions import sparse

    monkeypatch.setattr(sparse, "CORE_ROWS", core)
    rng = np.random.default_rng(n)
    matrix = np.diag(rng.normal(size=n))
    for i in range(n - 1):
        matrix[i, i + 1] = matrix[i + 1, i] = rng.normal()
    for i, j in rng.integers(0, n, (n // 10, 2)):
        if i != j:
            matrix[i, j] = matrix[j, i] = rng.normal()
    i, j = np.nonzero(matrix - np.diag(np.diag(matrix)))
    factor = sparse.Factor(np.diag(matrix), i, j, matrix[i, j])
    assert factor.below() == (np.linalg.eigvalsh(matrix) < 0).sum()
    x = rng.normal(size=(n, 3))
    assert np.allclose(matrix @ factor.solve(x), x, atol=1e-6)


@pytest.mark.parametrize("n, b", [(3, 2), (9, 4), (41, 3), (200, 7)])
def test_bands_become_tridiagonal(n, b):
    from depinfer.functions import sparse

    rng = np.random.default_rng(n)
    band = [np.r_[rng.normal(size=n - k), np.zeros(k)] for k in range(b + 1)]
    matrix = sum(np.diag(x[: n - k], -k) + (np.diag(x[: n - k], k) if k else 0) for k, x in enumerate(band))
    found = sparse.tridiagonal_eigenvalues(*sparse.band_to_tridiagonal(band), np.arange(n))
    assert np.allclose(found, np.linalg.eigvalsh(matrix), atol=1e-12)


def test_spectrum_of_narrow_networks_beyond_the_dense_size(spark, monkeypatch):
    # The second network is a ring with weights and a chord here and there, beside a path of its own.
    ring = spark.createDataFrame([(i, (i + 1) % 50, 1.0) for i in range(50)], "src bigint, dst bigint, w double")
    more = spark.createDataFrame([(i, (i + 1) % 40, 1.0 + i % 3) for i in range(40)] + [(i, i + 2, 0.5) for i in range(0, 38, 5)] + [(i, i + 1, 1.0) for i in range(40, 49)], "src bigint, dst bigint, w double")
    for edges, giant, weight in ((ring, True, None), (more, False, "w"), (more, False, None)):
        exact = [r.eigenvalue for r in C.spectrum(spark.range(50), edges, giant, weight).orderBy("rank").collect()]
        with monkeypatch.context() as m:
            m.setattr(C, "SPECTRUM_NODES", 10)
            m.setattr(C, "spread_eigenvalues", None)
            found = C.spectrum(spark.range(50), edges, giant, weight).orderBy("rank").collect()
        assert [r["rank"] for r in found] == list(range(len(exact)))
        assert np.allclose([r.eigenvalue for r in found], exact, atol=1e-13)


def test_histogram_of_a_narrow_network_beyond_the_dense_size(spark, monkeypatch):
    # A ring of 48 has the eigenvalues 0.5, 1 and 1.5, which are inner edges of quarters.
    nodes, edges = spark.range(48), spark.range(48).selectExpr("id as src", "(id + 1) % 48 as dst")
    monkeypatch.setattr(C, "SPECTRUM_NODES", 10)
    monkeypatch.setattr(C, "spread_eigenvalues", None)
    for bins in (4, 7):
        want = np.bincount(np.minimum((1 - np.cos(2 * np.pi * np.arange(48) / 48) + 1e-9) // (2 / bins), bins - 1).astype(int), minlength=bins)
        found = C.network_histogram(nodes, edges, bins).orderBy("bin").collect()
        assert [(r.bin, r.n) for r in found] == list(enumerate(want))


def test_spectrum_of_wide_networks_by_lanczos(spark, monkeypatch):
    nodes, rng = spark.range(300), np.random.default_rng(5)
    edges = spark.createDataFrame([(i, i + 1) for i in range(299)] + [(int(min(p)), int(max(p))) for p in rng.integers(0, 300, (300, 2)) if p[0] != p[1]], "src bigint, dst bigint")
    exact = np.array([r.eigenvalue for r in C.spectrum(nodes, edges).orderBy("rank").collect()])
    bins = [r.n for r in C.network_histogram(nodes, edges).orderBy("bin").collect()]
    monkeypatch.setattr(C, "SPECTRUM_NODES", 10)
    monkeypatch.setattr(C, "spread_eigenvalues", None)
    found = C.spectrum(nodes, edges).orderBy("rank").collect()
    assert [r["rank"] for r in found] == list(range(300))
    assert np.allclose([r.eigenvalue for r in found], exact, atol=1e-9)
    assert [r.n for r in C.network_histogram(nodes, edges).orderBy("bin").collect()] == bins


def test_spectrum_with_multiple_eigenvalues_leaves_lanczos(spark, monkeypatch):
    # The leaves of a star's arms are alike, so the eigenvalue 1 comes often.
    edges = spark.createDataFrame([(0, i) for i in range(1, 12)] + [(1 + i % 11, 12 + i) for i in range(22)], "src bigint, dst bigint")
    exact = [r.eigenvalue for r in C.spectrum(spark.range(34), edges).orderBy("rank").collect()]
    monkeypatch.setattr(C, "SPECTRUM_NODES", 10)
    monkeypatch.setattr(C, "BLOCK_COLUMNS", 17)
    spread, used = C.spread_eigenvalues, []
    monkeypatch.setattr(C, "spread_eigenvalues", lambda *a: used.append(1) or spread(*a))
    found = [r.eigenvalue for r in C.spectrum(spark.range(34), edges).orderBy("rank").collect()]
    assert used and np.allclose(found, exact, atol=1e-9)


def test_spectrum_on_the_executors(spark, monkeypatch):
    nodes = spark.range(43)
    edges = spark.createDataFrame([(i, (i * i + 1) % 42, 1.0 + i % 3) for i in range(42)] + [(i, i + 1, 0.5) for i in range(42)], "src bigint, dst bigint, w double")
    for weight in (None, "w"):
        dense = [r.eigenvalue for r in C.spectrum(nodes, edges, weight=weight).orderBy("rank").collect()]
        with monkeypatch.context() as m:
            m.setattr(C, "SPECTRUM_NODES", 10)
            m.setattr(C, "BLOCK_COLUMNS", 9)
            found = C.spectrum(nodes, edges, weight=weight).orderBy("rank").collect()
        assert [r["rank"] for r in found] == list(range(len(dense)))
        assert np.allclose([r.eigenvalue for r in found], dense, atol=1e-9)


def test_weighted_directed_means_and_rows(spark):
    nodes = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "id bigint, x double")
    edges = spark.createDataFrame([(0, 1, 0.5), (1, 2, 2.0)], "src bigint, dst bigint, w double")
    assert {r.id: r.x for r in G.neighbour_mean(nodes, edges, ["x"], weight="w").collect()} == {0: 2.0, 1: 4.0, 2: 0.0}
    assert {(r.src, r.dst): r.w for r in G.row_normalise(nodes, edges, "w").collect()} == {(0, 1): 0.5, (1, 2): 1.0}
    same = {r.id: r.x for r in G.neighbour_mean(nodes, edges, ["x"], distance=0).collect()}
    assert same == {0: 1.0, 1: 2.0, 2: 4.0}


def test_hac_against_dense_form_and_fallback(spark):
    rng = np.random.default_rng(3)
    n, edges = 30, [(i, j) for i in range(30) for j in range(i + 1, 30) if (i * 7 + j * 3) % 11 == 0]
    _, d = dense(n, edges)
    z = rng.normal(size=(n, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "id bigint, a double, b double")
    links = spark.createDataFrame(edges, "src bigint, dst bigint")
    zc, k = z - z.mean(0), (d <= 1).astype(float)
    got = H.network_hac(df, ["a", "b"], links, 1)
    plain = zc.T @ k @ zc / n
    scaled = k / np.sqrt(k.sum(1))[:, None]
    expected = plain if (np.linalg.eigvalsh(plain) > 0).all() else zc.T @ (scaled @ scaled.T) @ zc / n
    assert np.allclose(got.matrix, expected)
    pairs = G.ball(df.select("id"), links, 1).select("i", "j")
    assert np.allclose(H.normalised_kernel_variance(H.demean(df, ["a", "b"]), ["a", "b"], pairs), zc.T @ (scaled @ scaled.T) @ zc / n)
    assert got.apl == pytest.approx(SU.average_path(df.select("id"), links)[0])
    iid = H.network_hac(df, ["a", "b"], b=0)
    assert np.allclose(iid.matrix, zc.T @ zc / n) and not iid.pd_failure


def test_estimators_agree_where_they_must(spark):
    data, edges = S.tsls_data(spark, 120, seed=5)
    data = data.cache()
    ols, same = E.OLS(data, "y", ["x", "x_bar"], edges), E.TSLS(data, "y", ["x", "x_bar"], ["x", "x_bar"], edges)
    assert np.allclose(ols.estimate, same.estimate)
    assert ols.influence(1).agg({"value": "avg"}).first()[0] == pytest.approx(ols.estimate[1])
    p = data.toPandas()
    x = np.column_stack([np.ones(len(p)), p.x, p.x_bar])
    assert np.allclose(ols.estimate, np.linalg.lstsq(x, p.y, rcond=None)[0])
    e = p.y.to_numpy() - x @ ols.estimate
    s = x * e[:, None]
    h = np.linalg.inv(x.T @ x)
    assert np.allclose([r.se for r in ols.network_se(b=0).collect()], np.sqrt(np.diag(len(p) * h @ (s.T @ s / len(p)) @ h)))


def test_ipw_with_zero_scores(spark):
    df = spark.createDataFrame([(0, 2.0, 1, 0, 0.5, 0.5), (1, 3.0, 0, 1, 0.0, 1.0)], "id bigint, y double, a int, b int, p double, q double")
    assert E.IPW(df, "y", "a", "b", "p", "q").estimate[0] == pytest.approx((4.0 - 3.0) / 2)


def test_positional_variance_equals_documented_one_on_sorted_rows(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, i // 7, float(v)) for i, v in enumerate(rng.normal(size=40))], "id bigint, cluster int, y double")
    assert np.allclose(C.cluster_var(df, ["y"]), C.cluster_var(df, ["y"], "positional"))
    shuffled = df.select("id", (df.id * 7 % 40 % 6 * (df.id % 5)).cast("int").alias("cluster"), "y")
    rows = sorted(map(tuple, shuffled.collect()))
    want = [c for c in sorted(r[1] for r in rows)]
    assert [r.cluster for r in C.positional_labels(shuffled).orderBy("id").collect()] == want


def test_quantiles():
    assert dist.t_quantile(0.975, 7) == pytest.approx(2.3646, abs=1e-4)
    assert dist.t_quantile(0.95, 1) == pytest.approx(6.3138, abs=1e-4)
    assert dist.chi2_one_quantile(0.96) == pytest.approx(4.21788, abs=1e-5)
    assert dist.chi2_one_quantile(1.0) == float("inf")
    assert dist.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)


def test_randomization(spark):
    z = [1.0, 2.0, -0.5, 3.0, 0.7]
    signs = [[1 - 2 * (g >> c & 1) for c in range(5)] for g in range(32)]
    expected = np.mean([abs(np.dot(s, z)) / 5 >= abs(sum(z)) / 5 - 1e-12 for s in signs])
    assert R.arand_test(spark, z, 0.0)[0] == pytest.approx(expected)
    assert R.arand_test(spark, z, sum(z) / 5)[0] == 1.0
    assert 0 < R.arand_test(spark, [float(i % 5) for i in range(20)], 1.0, seed=3)[0] <= 1
    with pytest.raises(ValueError):
        R.trobust_ci(z, 0.9)


def test_resampling_rejects_far_means(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.random.default_rng(0).normal(size=150))], "id bigint, y double")
    assert RS.drobust_test(df, "y", 0.0, draws=100)["result"] == "Not reject"
    assert RS.drobust_test(df, "y", 3.0, draws=100)["result"] == "Reject"
    with pytest.raises(ValueError):
        RS.drobust_test(df, "y", 0.0, beta=0.2)


def test_linear_in_means_is_a_fixed_point(spark):
    edges = S.random_geometric(spark, 80, seed=2)
    nodes = S._drawn(spark, 80, 2)
    y = S.linear_in_means(nodes, edges).toPandas().set_index("id").sort_index()
    p = nodes.toPandas().set_index("id").sort_index()
    a, _ = dense(80, [tuple(r) for r in edges.collect()])
    a = a / np.maximum(a.sum(1), 1)[:, None]
    assert np.allclose(y.y, 1 + 0.5 * a @ y.y + 3 * a @ p.x + p.x + p.e + a @ p.e)


@pytest.mark.parametrize("t1", [0.95, -0.9, 1.7])
def test_linear_in_means_against_the_exact_solve(spark, t1):
    edges = S.random_geometric(spark, 40, seed=4)
    nodes = S._drawn(spark, 40, 4)
    y = S.linear_in_means(nodes, edges, (1.0, t1, 3.0, 1.0)).toPandas().sort_values("id").y.to_numpy()
    p = nodes.toPandas().sort_values("id")
    a, _ = dense(40, [tuple(r) for r in edges.collect()])
    a = a / np.maximum(a.sum(1), 1)[:, None]
    exact = np.linalg.solve(np.eye(40) - t1 * a, 1 + 3 * a @ p.x + p.x + p.e + a @ p.e)
    assert np.allclose(y, exact, rtol=1e-6, atol=1e-6)
    if t1 == 0.95:
        with pytest.raises(ValueError, match="rounds"):
            S.linear_in_means(nodes, edges, (1.0, t1, 3.0, 1.0), rounds=2)


def test_csv_positions_over_files_and_splits(spark, tmp_path):
    from depinfer.sources import io

    for k, n in enumerate((3, 500, 0, 40)):
        (tmp_path / f"f{k}.csv").write_text("Y,X\n" + "".join(f"{k}.5,{i}\n" for i in range(n)))
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    got = sorted(map(tuple, io.read_node_csv(spark, str(tmp_path), "Y double, X double").collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert got == [(i, *r) for i, r in enumerate([(k + 0.5, float(i)) for k, n in enumerate((3, 500, 0, 40)) for i in range(n)])]


def test_files(spark, tmp_path):
    from depinfer.sources import io

    nodes, edges = make(spark, "tri_iso")
    io.write_adjlist(nodes, edges, str(tmp_path / "a"))
    n, e = io.read_adjlist(spark, str(tmp_path / "a"))
    assert sorted(r.id for r in n.collect()) == [0, 1, 2, 3] and sorted(map(tuple, e.collect())) == [(0, 1), (0, 2), (1, 2)]
    io.write_node_csv(spark.createDataFrame([(1.5, 2.0), (2.5, 3.0)], "Y double, X double").coalesce(1), str(tmp_path / "c"))
    assert [tuple(r) for r in io.read_node_csv(spark, str(tmp_path / "c"), "Y double, X double").collect()] == [(0, 1.5, 2.0), (1, 2.5, 3.0)]


def test_validation(spark):
    with pytest.raises(ValueError):
        G.validate(spark.range(2), spark.createDataFrame([(0, 5)], "src bigint, dst bigint"))


def test_path_lengths_in_slices_of_pairs(spark, monkeypatch):
    """Beyond what is broadcast, only the pairs of some sources are held at a time."""
    nodes, edges = make(spark, "two_cliques")
    wanted = sorted(map(tuple, G.path_lengths(nodes, edges).collect()))
    monkeypatch.setattr(G, "BROADCAST_EDGES", 1)
    monkeypatch.setattr(G, "PAIRS", 30)
    assert sorted(map(tuple, G.path_lengths(nodes, edges).collect())) == wanted


def test_hac_lists_no_pairs(spark, monkeypatch):
    """Sums over balls of a random graph with a hub, against dense ones, without the pairs of :func:`ball`."""
    r = np.random.default_rng(3)
    n, edges = 300, [(int(a), int(b)) for a, b in r.integers(0, 280, (330, 2))] + [(0, i) for i in range(1, 120)]
    _, d = dense(n, [(a, b) for a, b in edges if a != b])
    y = r.normal(size=n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id bigint, y double")
    links = spark.createDataFrame(edges, "src bigint, dst bigint")
    lengths = {x.id: (x.total, x.furthest, x.reached) for x in G.path_lengths(df, links).collect()}
    finite = np.where(np.isfinite(d), d, 0)
    assert lengths == {i: (finite[i].sum(), finite[i].max(), np.isfinite(d[i]).sum() - 1) for i in range(n)}
    monkeypatch.setattr(G, "ball", None)
    monkeypatch.setattr(G, "STEPS", 50)
    for b in (1, 3):
        z = y - y.mean()
        near = d <= b
        found = {x.id: (x.r, x.ball_y) for x in G.ball_sums(df, links, b, ["y"]).collect()}
        assert all(found[i][0] == near[i].sum() and np.isclose(found[i][1], near[i] @ y) for i in range(n))
        got, plain = H.network_hac(df, ["y"], links, b), z @ near @ z / n
        scaled = near @ (z / np.sqrt(near.sum(1)))
        assert np.isclose(got.matrix[0, 0], plain if plain > 0 else scaled @ scaled / n)


def test_draws_without_joins(spark, monkeypatch):
    from pyspark.sql import functions as F

    from depinfer.functions import rng

    k = np.array([0, 9, 10, 99, 12345, 10**9 + 7, 987654321012])
    frame = spark.createDataFrame([(int(x),) for x in k], "k bigint")
    assert rng.bits52_of("7/i", k).tolist() == [x[0] for x in frame.select(rng.bits52("7/i", F.col("k"))).collect()]
    df = spark.range(40).select("id", (F.col("id") * F.col("id") % 17).cast("double").alias("value"))
    wanted = RS.drobust_grid(df, "value", -5.0, 20.0, draws=30, seed=5).orderBy("point").collect()
    with monkeypatch.context() as m:
        # The values are joined here, some pairs at a time.
        m.setattr(RS, "BROADCAST_VALUES", 1)
        m.setattr(RS, "JOINED_PAIRS", 500)
        assert [tuple(x) for x in RS.drobust_grid(df, "value", -5.0, 20.0, draws=30, seed=5).orderBy("point").collect()] == [tuple(x) for x in wanted]


def test_products_of_some_entries_at_a_time(monkeypatch):
    r = np.random.default_rng(1)
    src, dst, v, x = r.integers(0, 50, 400), r.integers(0, 60, 400), r.normal(size=400), r.normal(size=(60, 3))
    matrix = np.zeros((60, 60))
    np.add.at(matrix, (src, dst), v)
    for entries in (1, 7, 1000):
        monkeypatch.setattr(C, "PRODUCT_ENTRIES", entries)
        assert np.allclose(C._Local(np.arange(60), src, dst, v, 3).product(x), matrix @ x)


def test_spread_eigenvalues_in_bounded_blocks(spark, monkeypatch):
    """Blocks are bounded in bytes, and no more than the files of the last round are left."""
    from depinfer.functions.storage import with_index

    n, kept = 12, []
    ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src bigint, dst bigint")
    monkeypatch.setattr(C, "BLOCK_BYTES", 3 * 8 * n)
    monkeypatch.setattr(C, "discard", lambda *x: kept.extend(x))
    values = C.spread_eigenvalues(with_index(spark.range(n), "id"), G.laplacian(spark.range(n), ring), n).collect()
    assert np.allclose(sorted(x.eigenvalue for x in values), sorted(1 - np.cos(2 * np.pi * np.arange(n) / n)))
    assert kept and max(x.agg({"columns": "max"}).first()[0] for x in kept[:1]) == 3
