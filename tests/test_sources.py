"""Readers, the store, monitoring, streaming."""

import gzip

import numpy as np
import pytest

from grainfield import monitor
from grainfield.functions.mathx import erfc
from grainfield.operators.matrix import to_dense
from grainfield.sources import readers, store
from grainfield.streaming import incremental


def write(folder, matrix, features="g1\tA\ng2\tA\ng3\tB\n", cells="c1\nc2 \n\nc3\n"):
    folder.mkdir()
    (folder / "matrix.mtx").write_text(matrix)
    (folder / "features.tsv").write_text(features)
    with gzip.open(folder / "barcodes.tsv.gz", "wt") as f:
        f.write(cells)
    return f"file://{folder}"


def test_10x_unsorted_repeated_and_crlf(spark, tmp_path):
    d = write(tmp_path / "a", "%%MatrixMarket matrix coordinate integer general\r\n% note\r\n\r\n3 3 4\r\n3 2 5\r\n1 1 2\r\n1 1 3\r\n2 3 1\r\n")
    a = readers.load(spark, d)
    assert np.array_equal(to_dense(a.layer("counts"), 3, 3), [[5, 0, 0], [0, 0, 1], [0, 5, 0]])
    assert [r["gene"] for r in a.features.orderBy("gene_id").collect()] == ["A", "A.1", "B"]
    assert [r["cell"] for r in a.cells.orderBy("cell_id").collect()] == ["c1", "c2", "c3"]


def test_pattern_and_size_line_as_entry(spark, tmp_path):
    d = write(tmp_path / "p", "%%MatrixMarket matrix coordinate pattern general\n2 2 1\n2 2\n", "x\ny\n", "")
    a = readers.load(spark, d)
    assert a.layer("counts").collect()[0]["value"] == 1.0 and a.shape == (2, 2)
    d = write(tmp_path / "q", "%%MatrixMarket matrix coordinate real general\n3 3 2\n3 3 2\n1 1 4\n")
    assert to_dense(readers.load(spark, d).layer("counts"), 3, 3)[2, 2] == 2


@pytest.mark.parametrize("body", ["3 3 2\n1 1 1\n", "3 3 1\n4 1 1\n", "3 3 1\nx 1 1\n", "3 3\n", ""])
def test_bad_matrices(spark, tmp_path, body):
    with pytest.raises(ValueError):
        readers.load(spark, write(tmp_path / "b", "%%MatrixMarket matrix coordinate real general\n" + body))


def test_unique_names_skip_taken(spark):
    df = spark.createDataFrame(list(enumerate(["A", "A.1", "A", "A", "B"])), "gene_id int, gene string")
    assert [r["gene"] for r in readers.unique_names(df).orderBy("gene_id").collect()] == ["A", "A.1", "A.2", "A.3", "B"]


def test_store_round_trip(spark, tmp_path):
    a = readers.load(spark, np.array([[1.0, 0], [2, 3]]))
    a.attributes["note"] = "x"
    path = f"file://{tmp_path}/s"
    store.write_assay(a, path)
    b = readers.load(spark, path)
    assert np.array_equal(to_dense(b.layer("counts"), 2, 2), [[1, 0], [2, 3]]) and b.attributes == {"note": "x"}
    assert store.list_groups(spark, f"{path}/assays/RNA/layers") == ["counts"]
    with pytest.raises(FileExistsError):
        store.write_assay(a, path, "errorifexists")
    with pytest.raises(FileNotFoundError):
        readers.load(spark, f"file://{tmp_path}/none")
    assert store.export(b)["counts"].num_rows == 3
    assert readers.fold_layers(["counts.1", "counts.2", "data", "scale.data.x", "other"]) == {"counts": "counts.1", "data": "data", "scale.data": "scale.data.x", "other": "other"}


def test_erfc(spark):
    import math

    xs = [0.0, 0.1, 0.46875, 0.47, 1.0, 3.9, 4.1, 10.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc("x").alias("y"))
    assert all(math.isclose(r["y"], math.erfc(r["x"]), rel_tol=1e-12) for r in df.collect())


def test_monitor(spark):
    assert monitor.performance_snapshot()["rss_mb"] > 0
    assert monitor.bottleneck({"memory_pressure": 0.8, "cpu_pressure": 0}) == "memory"
    with pytest.raises(ValueError):
        monitor.set_chunk_size(spark, 0)
    with pytest.raises(ValueError):
        monitor.set_threads(spark, -1)


def test_streaming_sums(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0), (1, 1, 4.0)], "cell_id long, gene_id int, value double")
    rows.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    q = incremental.library_size(stream).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("sums").collect()} == {(0, 5.0), (1, 4.0)}
