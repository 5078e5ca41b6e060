"""Hubs, many groups and dense cells: the plans for them against the plain definition; and the small ends of the readers."""

import numpy as np
import pytest

from grainfield import monitor
from grainfield.functions.rank import positions
from grainfield.operators import graph, markers, pca
from grainfield.operators.matrix import from_dense, to_dense
from grainfield.sources import readers


def test_a_hub_meets_its_cells_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 8)
    rng = np.random.default_rng(1)
    near = {i: sorted({i, 0, *rng.integers(0, 60, 4).tolist()}) for i in range(60)}  # all have cell 0
    df = spark.createDataFrame([(i, n) for i, x in near.items() for n in x], "cell_id long, nbr_id long")
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.snn(df, k=5, prune=0.12).collect()}
    want = {}
    for i in near:
        for j in near:
            c = len(set(near[i]) & set(near[j]))
            if i != j and c / (10 - c) > 0.12:
                want[i, j] = c / (10 - c)
    assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((25, 80)) < 0.4, rng.integers(1, 6, (25, 80)), 0).astype(float)
    x[3] = 0
    x[4, :] = 2
    idents = spark.createDataFrame([(i, f"g{i % 7}") for i in range(80)], "cell_id long, ident string")
    genes = spark.createDataFrame([(i, f"n{i}") for i in range(25)], "gene_id int, gene string")
    return x, from_dense(spark, x), idents, genes


@pytest.mark.parametrize("test", ["wilcox", "t", "LR"])
def test_against_the_rest_equals_two_named_groups(spark, cells, test):
    """The rest as a group of its own, by the other plan."""
    _, data, idents, genes = cells
    all_ = {(r["ident_1"], r["gene"]): r for r in markers.find_all_markers(data, idents, genes, test=test).collect()}
    assert len(all_) == 7 * 25
    for g in ("g0", "g3", "g6"):
        two = spark.createDataFrame([(i, g if f"g{i % 7}" == g else "rest") for i in range(80)], "cell_id long, ident string")
        for r in markers.find_markers(data, two, genes, g, "rest", test=test).collect():
            mine = all_[g, r["gene"]]
            assert [mine[c] for c in ("p_val", "avg_log2FC", "pct_1", "pct_2", "p_val_adj")] == pytest.approx([r[c] for c in ("p_val", "avg_log2FC", "pct_1", "pct_2", "p_val_adj")], rel=1e-9, abs=1e-12)


def test_wilcoxon_by_hand(cells):
    x, data, idents, genes = cells
    got = {r["gene"]: r for r in markers.marker_stats(data, idents, idents.sparkSession.createDataFrame([("g2", None)], "ident_1 string, ident_2 string"), genes).join(genes, "gene_id").collect()}
    mine = np.arange(80) % 7 == 2
    for k in range(25):
        order = np.sort(x[k])
        mid = np.array([(np.searchsorted(order, v) + 1 + np.searchsorted(order, v, side="right")) / 2 for v in x[k]])
        assert got[f"n{k}"]["r1"] == pytest.approx(mid[mine].sum()) and got[f"n{k}"]["x2"] == pytest.approx(x[k][~mine].sum())


def test_cross_products_by_blocks_and_by_join(cells):
    x, data, _, genes = cells
    for limit in (25, 10):
        got = {(r["i"], r["j"]): r["s"] for r in pca.cross_products(data, genes, limit).collect()}
        want = x @ x.T
        assert all(got.get((i, j), 0.0) == pytest.approx(want[i, j]) for i in range(25) for j in range(i, 25)) and all(i <= j for i, j in got)


def test_positions_over_range_partitions(spark):
    df = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "v int").repartition(5)
    from pyspark.sql import functions as F

    assert all(r["v"] == r["position"] for r in positions(df, F.col("v")).collect())
    assert positions(df.limit(0), F.col("v")).count() == 0


@pytest.mark.parametrize("shape", [(1, 2), (2, 1), (1, 1)])
def test_one_gene_or_one_cell(spark, shape):
    x = np.ones(shape)
    a = readers.from_dataframe(from_dense(spark, x))
    assert a.shape == shape and np.array_equal(to_dense(a.layer("counts"), *shape), x)


def test_a_header_behind_many_comments(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n" + "% note\n" * 12_000 + "\n2 2 1\n1 2 7\n")
    coo, header = readers.read_mtx(spark, f"file://{tmp_path}/m.mtx")
    assert header == {"pattern": False, "integer": True, "rows": 2, "cols": 2, "nnz": 1} and [tuple(r) for r in coo.collect()] == [(1, 0, 7.0)]


def test_threads_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monitor.set_threads(spark, 3)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    monitor.set_threads(spark, None)
    assert spark.conf.get("spark.sql.shuffle.partitions") != "1"
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from grainfield.session import shared_folder

    sc = SimpleNamespace(master="spark://somewhere:7077", getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_folder(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d)))
