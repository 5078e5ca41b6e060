"""Operators on small matrices, held against numpy."""

import math

import numpy as np
import pytest

from grainfield.operators import blocks, cluster, graph, integrate, markers, matrix, normalize, pca, variable
from grainfield.sources.readers import from_dataframe


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(1)
    x = np.where(rng.random((12, 20)) < 0.4, rng.integers(1, 9, (12, 20)), 0).astype(float)
    x[3] = 0
    x[:, 5] = 0
    return x


@pytest.fixture(scope="module")
def assay(spark, dense):
    return from_dataframe(matrix.from_dense(spark, dense), n_genes=12, n_cells=20)


def full(df, shape=(12, 20)):
    return matrix.to_dense(df, *shape)


def test_shape_and_slices(assay, dense):
    counts = assay.layer("counts")
    assert assay.shape == (12, 20)
    assert np.array_equal(full(counts), dense)
    assert np.array_equal(full(matrix.slice_rows(counts, 2, 3))[2:5], dense[2:5])
    part = np.zeros_like(dense)
    part[np.ix_([1, 7], [0, 9])] = dense[np.ix_([1, 7], [0, 9])]
    assert np.array_equal(full(matrix.slice_ids(counts, [1, 7], [0, 9])), part)
    assert matrix.dense_slice(counts, 2, 4, 3, 5).count() == 20
    assert np.array_equal(matrix.to_dense(matrix.transpose(counts), 20, 12), dense.T)


def test_products(spark, assay, dense):
    x = np.arange(20.0)
    y = {r["gene_id"]: r["y"] for r in matrix.matvec(assay.layer("counts"), spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "cell_id long, x double")).collect()}
    assert all(math.isclose(y.get(g, 0.0), v) for g, v in enumerate(dense @ x))
    z = np.arange(12.0)
    y = {r["cell_id"]: r["y"] for r in matrix.rmatvec(assay.layer("counts"), spark.createDataFrame([(i, float(v)) for i, v in enumerate(z)], "gene_id int, x double")).collect()}
    assert all(math.isclose(y.get(c, 0.0), v) for c, v in enumerate(dense.T @ z))


def test_normalize(assay, dense):
    sums = dense.sum(0)
    got = full(normalize.log_normalize(assay.layer("counts"), assay.cells))
    assert np.allclose(got, np.log1p(dense * np.where(sums > 0, 1e4 / np.where(sums > 0, sums, 1), 1)))
    gm = np.array([np.exp(np.log(c[c > 0]).mean()) if (c > 0).any() else 1 for c in dense.T])
    assert np.allclose(full(normalize.clr(assay.layer("counts"), assay.cells, 12)), np.log((dense + 1) / gm))
    with pytest.raises(ValueError):
        normalize.normalize_data(assay, "nonsense")


def test_moments_and_scaling(assay, dense):
    m = {r["gene_id"]: (r["mean"], r["variance"]) for r in variable.gene_moments(assay.layer("counts"), assay.features, 20).collect()}
    assert all(np.allclose(m[g], (dense[g].mean(), dense[g].var(ddof=1))) for g in range(12))
    sd = dense.std(axis=1, ddof=1)
    want = np.where(sd[:, None] > 0, (dense - dense.mean(1)[:, None]) / np.where(sd > 0, sd, 1)[:, None], 0)
    assert np.allclose(full(variable.scaled_matrix(assay.layer("counts"), assay.features, assay.cells, 12, 20)), want)
    scores = variable.vst_scores(variable.gene_moments(assay.layer("counts"), assay.features, 20))
    assert scores.count() == 12
    assert variable.top_features(scores, 0).count() == 0
    assert variable.top_features(scores, 5).count() == 5


@pytest.mark.parametrize("gram_genes", [2000, 1])
def test_pca(assay, dense, gram_genes):
    got = pca.run_pca(assay.layer("counts"), assay.features, assay.cells, 4, gram_genes=gram_genes, power_steps=25)
    x = dense - dense.mean(1)[:, None]
    s = np.linalg.svd(x, compute_uv=False)
    assert np.allclose([r["stdev"] for r in got["stdev"].orderBy("pc").collect()], s[:4] / np.sqrt(19), rtol=1e-4)
    e = np.array([r["vec"] for r in got["embeddings"].orderBy("cell_id").collect()])
    v = np.array([r["vec"] for r in got["loadings"].orderBy("gene_id").collect()])
    assert np.allclose(e, x.T @ v, atol=1e-8)
    assert (v[np.abs(v).argmax(0), range(4)] > 0).all()
    assert math.isclose(got["summary"].first()[0], (s**2).sum() / 19)


def points(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "cell_id long, vec array<double>")


def test_knn_ties_and_few_cells(spark):
    line = points(spark, [[0], [1], [2], [2], [10], [11]])
    got = {(r["cell_id"], r["rank"]): (r["nbr_id"], r["dist"]) for r in graph.knn(line, 3).collect()}
    assert got[1, 0] == (1, 0.0) and got[1, 1] == (0, 1.0) and got[1, 2] == (2, 1.0)
    assert got[2, 1] == (3, 0.0)
    assert graph.knn(line, 20).count() == 36


def test_knn_blocks(spark):
    x = np.random.default_rng(2).standard_normal((60, 5))
    rows = points(spark, x).withColumnRenamed("cell_id", "id")
    got = blocks.nearest(rows, rows, 4, block=16).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i, part in got.groupby("id"):
        assert part.sort_values("rank")["nbr_id"].tolist() == np.argsort(d[i], kind="stable")[:4].tolist()


def test_two_cliques(spark):
    edges = [(a, b, 1.0) for g in ((0, 1, 2, 3), (4, 5, 6, 7)) for a in g for b in g if a != b] + [(3, 4, 0.1), (4, 3, 0.1)]
    snn = spark.createDataFrame(edges, "src long, dst long, weight double")
    cells = spark.range(8).withColumnRenamed("id", "cell_id")
    found = {r["cell_id"]: r["cluster"] for r in cluster.find_clusters(snn, cells, "louvain").collect()}
    assert len({found[i] for i in range(4)}) == 1 and len({found[i] for i in range(4, 8)}) == 1 and found[0] != found[7]
    q = cluster.modularity(snn, cluster.find_clusters(snn, cells)).first()
    m = 24.2
    assert math.isclose(q["standard_modularity"], 2 * (12 / m - (12.1 / m) ** 2))
    assert math.isclose(q["modularity"], 2 * (12 / (2 * m) - (12.1 / (2 * m)) ** 2))


def test_wilcoxon_and_bh(spark, assay, dense):
    idents = assay.cells.selectExpr("cell_id", "case when cell_id < 8 then 'a' else 'b' end as ident")
    pairs = spark.createDataFrame([("a", None)], "ident_1 string, ident_2 string")
    got = {r["gene_id"]: r for r in markers.marker_stats(assay.layer("counts"), idents, pairs, assay.features).collect()}
    for g in range(12):
        x, y = dense[g, :8], dense[g, 8:]
        every = np.concatenate([x, y])
        ranks = np.array([(every < v).sum() + ((every == v).sum() + 1) / 2 for v in every])
        u = min(ranks[:8].sum() - 36, 96 - ranks[:8].sum() + 36)
        t = np.unique(every, return_counts=True)[1].astype(float)
        var = max(1e-12, 8 * 12 / 12 * (21 - (t**3 - t).sum() / (20 * 19)))
        assert math.isclose(got[g]["wilcox_p"], min(1, math.erfc(abs((u - 48) / math.sqrt(var)) / math.sqrt(2))), abs_tol=1e-12)
        assert math.isclose(got[g]["pct_1"], (x > 0).mean())
    res = markers.find_markers(assay.layer("counts"), idents, assay.features, "a", "b", test="t").collect()
    assert len(res) == 12 and all(r["p_val_adj"] >= r["p_val"] for r in res)
    with pytest.raises(ValueError):
        markers.find_markers(assay.layer("counts"), idents, assay.features, "c")
    with pytest.raises(ValueError):
        markers.find_all_markers(assay.layer("counts"), idents, assay.features, test="x")


def test_integration(spark):
    grid = np.array([[i, j] for i in range(5) for j in range(5)], float) + 1
    both = points(spark, np.concatenate([grid, grid[:20] + [50, 0]]))
    cells = both.selectExpr("cell_id", "case when cell_id < 25 then 'x' else 'y' end as batch")
    assert integrate.reference_batch(cells).first()["batch"] == "x"
    e = {r["cell_id"]: r["vec"] for r in integrate.integrate(both, cells, n_mnn=5, sigma=0.5, max_iter=3).collect()}
    moved = np.array([e[i] for i in range(25, 45)])
    assert np.abs(moved[:, 0] - grid[:20, 0]).mean() < 5
    one = cells.selectExpr("cell_id", "'x' as batch")
    assert {tuple(r["vec"]) for r in integrate.integrate(both, one).collect()} == {tuple(r["vec"]) for r in both.collect()}
    with pytest.raises(ValueError):
        integrate.integrate(both, cells, n_mnn=0)
