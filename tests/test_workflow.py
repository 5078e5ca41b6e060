"""From a directory of files to markers and corrected batches, on two planted groups; and the ends of the wrappers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.operators import cluster, graph, integrate, markers, normalize, pca, variable
from grainfield.sources import export, readers, store


@pytest.fixture(scope="module")
def planted():
    """40 genes x 60 cells: genes 0-9 high in the first 30 cells, genes 10-19 in the others; two batches across both."""
    rng = np.random.default_rng(8)
    x = rng.poisson(1.0, (40, 60)).astype(float)
    x[:10, :30] += rng.poisson(12, (10, 30))
    x[10:20, 30:] += rng.poisson(12, (10, 30))
    return x


@pytest.fixture(scope="module")
def assay(spark, planted, tmp_path_factory):
    from grainfield.operators.matrix import from_dense

    at = f"file://{tmp_path_factory.mktemp('run')}/tenx"
    export.write_mtx(from_dense(spark, planted), at, 40, 60)
    export.write_names(spark.createDataFrame([(i, f"id{i}\tgene{i % 38}") for i in range(40)], "gene_id int, name string"), f"{at}/features.tsv", "gene_id")
    export.write_names(spark.createDataFrame([(i, f"cell{i}") for i in range(60)], "cell_id long, name string"), f"{at}/barcodes.tsv", "cell_id")
    a = readers.load(spark, at)
    normalize.normalize_data(a)
    variable.find_variable_features(a, n=25, n_bins=1)  # 40 genes are too few for a trend
    variable.scale_data(a)
    pca.pca(a, npcs=10)
    graph.find_neighbors(a, dims=6, k=10)
    cluster.cluster_assay(a, "leiden", 0.5)
    return a


def test_names_and_shape(assay):
    assert assay.shape == (40, 60)
    names = [r["gene"] for r in assay.features.orderBy("gene_id").collect()]
    assert names[0] == "gene0" and names[38:] == ["gene0.1", "gene1.1"]


def test_variable_features_and_components(assay):
    flagged = assay.variable_features().collect()
    assert len(flagged) == 25 and {r["gene_id"] for r in flagged} >= set(range(20))
    sd = [r["stdev"] for r in assay.table("stdev").orderBy("pc").collect()]
    assert len(sd) == 10 and sd == sorted(sd, reverse=True) and sd[0] > 2 * sd[1]
    loads = {r["gene_id"]: r["vec"] for r in assay.table("loadings").collect()}
    assert len(loads) == 40 and all(not any(loads[i]) for i in set(range(40)) - {r["gene_id"] for r in flagged})


def test_clusters_and_their_summary(assay):
    label = {r["cell_id"]: r["cluster"] for r in assay.table("clusters").collect()}
    groups = {frozenset(i for i in label if label[i] == c) for c in set(label.values())}
    assert all(g <= set(range(30)) or g <= set(range(30, 60)) for g in groups)
    (r,) = assay.table("cluster_summary").collect()
    assert r["n_clusters"] == len(groups) and 0 < r["standard_modularity"] < 1


def test_markers_of_the_planted_groups(assay):
    idents = assay.cells.select("cell_id", F.when(F.col("cell_id") < 30, "a").otherwise("b").alias("ident"))
    found = markers.find_all_markers(assay.layer("data"), idents, assay.features).collect()
    up = {g: {r["gene"] for r in found if r["ident_1"] == g and r["p_val_adj"] < 0.01 and r["avg_log2FC"] > 0.25} for g in "ab"}
    assert up["a"] >= {f"gene{i}" for i in range(2, 10)} and up["b"] >= {f"gene{i}" for i in range(10, 20)} and not up["a"] & up["b"]


def test_batches_are_brought_together(spark, assay):
    shifted = assay.table("embeddings").select("cell_id", F.when(F.col("cell_id") % 2 == 1, F.transform("vec", lambda v: v + 4)).otherwise(F.col("vec")).alias("vec"))
    a = type(assay)(assay.features, assay.cells.withColumn("batch", (F.col("cell_id") % 2).cast("string")), {}, {"embeddings": shifted})
    integrate.integrate_assay(a, n_ccs=50, n_mnn=5, sigma=2.0)  # more than there are: all of them
    apart = lambda t: np.linalg.norm(np.subtract(*[np.mean([r["vec"] for r in t if r["cell_id"] % 2 == k], axis=0) for k in (0, 1)]))
    assert apart(a.table("mnn").collect()) < 0.5 * apart(shifted.collect())
    one = type(assay)(assay.features, assay.cells.withColumn("batch", F.lit("x")), {}, {"embeddings": shifted})
    assert {r["cell_id"]: r["vec"] for r in integrate.integrate_assay(one, n_ccs=4).table("mnn").collect()} == {r["cell_id"]: r["vec"][:4] for r in shifted.collect()}


def test_stored_and_opened_again(spark, assay, tmp_path):
    at = f"file://{tmp_path}/s"
    assay.attributes["source"] = "planted"
    store.write_assay(assay, at)
    b = store.read_assay(spark, at)
    assert sorted(b.layers) == ["counts", "data"] and b.attributes["source"] == "planted" and b.table("clusters").count() == 60
    assert store.read_vector(spark, f"{store.root(at, 'RNA')}/tables/stdev", "stdev", "pc") == [r["stdev"] for r in assay.table("stdev").orderBy("pc").collect()]


def test_approximate_neighbours_take_the_same_coordinates(spark, assay):
    a = type(assay)(assay.features, assay.cells, {}, {"embeddings": assay.table("embeddings")})
    key = lambda t: {(r["cell_id"], r["rank"]): r["nbr_id"] for r in t.collect()}
    assert key(graph.find_neighbors(a, dims=6, k=10, approximate=True).table("knn")) == key(assay.table("knn"))


def test_what_is_missing_or_empty(spark, assay):
    bare = type(assay)(assay.features, assay.cells)
    with pytest.raises(KeyError):
        cluster.cluster_assay(bare)
    with pytest.raises(KeyError):
        normalize.normalize_data(bare)
    empty = readers.from_dataframe(spark.createDataFrame([], "cell_id long, gene_id int, value double"), n_genes=10, n_cells=5)
    normalize.normalize_data(empty)
    assert empty.layer("data").count() == 0 and [r["size_factor"] for r in empty.table("size_factors").collect()] == [0.0] * 5
    assert readers.from_layers({"counts.1": empty.layer("counts")}, assay.features, assay.cells).layer("counts").count() == 0
