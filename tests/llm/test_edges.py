"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest

import corpus_pipeline
from grainfield.llm import ann, tokenbin
from grainfield.llm.langid import language_id
from grainfield.llm.linededup import line_dedup
from grainfield.llm.mix import mix
from grainfield.llm.neardup import near_dedup
from grainfield.llm.packing import pack
from grainfield.llm.quality import quality
from grainfield.llm.secrets import secrets
from grainfield.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _t string, _row string, label int, score string, n_removed int, `a.b` int"


def rows():
    long_ = "the quick brown fox jumps over it " * 20_000
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "another text of the same id"), (2, None), (3, ""), (4, " \t\n"), (None, "no id here at all today"), (None, None), (5, long_), (6, "word"), (7, "word"), (8, "…\n…\n\n")]
    return [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", None, "x", "y", 1, "z", 2, 3) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(spark, request):
    return spark.createDataFrame(rows() if request.param == "rows" else [], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (5, None, None), (6, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("labelled", [True, False])
@pytest.mark.parametrize("name", ["secrets", "mix", "language_id", "near_dedup", "line_dedup", "toxicity", "quality"])
def test_a_row_for_each_row(docs, labels, name, labelled):
    own = labels if labelled else labels.limit(0)
    run = {"secrets": secrets, "mix": mix, "language_id": language_id, "near_dedup": near_dedup, "line_dedup": line_dedup, "toxicity": lambda d: toxicity(d, own), "quality": lambda d: quality(d, own)}
    got = run[name](docs).collect()
    assert len(got) == docs.count()
    if got:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in docs.collect())


def test_kept_columns(docs):
    assert {"_t", "_row", "a.b", "accepted"} <= set(language_id(docs).columns)
    assert {"_t", "_row", "a.b", "n_removed"} <= set(line_dedup(docs).columns)


def test_near_dedup_results(docs):
    got = near_dedup(docs).collect()
    for r in got:
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    if got:
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], []).append(r)
        assert by[7][0]["component_id"] == 6 and not by[7][0]["kept"]
        assert by[2][0]["n_shingles"] == 0 and by[2][0]["kept"]
        assert {r["component_id"] for r in by[1]} == {1} and {r["component_id"] for r in by[None]} == {None}


def test_token_files_and_packing(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/ids"
    back = tokenbin.write_and_read_back(docs, folder).collect()
    assert len(back) == docs.count()
    at = 0
    for r in sorted(back, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    if back:
        assert [len(x) for x in tokenbin.get(folder, 2)] == [1] and len(tokenbin.get(folder, 1)) == 3 and tokenbin.get(folder, 99) == []
    pieces = pack(docs).collect()
    assert sum(r["length"] for r in pieces) == at


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (21, [1.0, 0.0]), (22, [0.0, 0.0]), (23, None), (24, [nan, 1.0]), (25, [1.0, None]), (26, [inf, 1.0]), (27, [1.0]), (None, [1.0, 1.0]), (28, [2.0, 0.0]), (28, [3.0, 0.0]), (40, [])]
    got = ann.nearest(spark.createDataFrame([(a, b, 1) for a, b in v], "vec_id long, embedding array<double>, v int"))
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()}
    assert found == {(0, 1): (28, 2.0), (0, 2): (20, 1.0), (0, 3): (21, 1.0), (20, 1): (28, 2.0), (20, 2): (0, 1.0), (20, 3): (21, 1.0)}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    left = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, left, "").write.parquet(f"file://{tmp_path}/{name}")
        left = spark.read.parquet(f"file://{tmp_path}/{name}")
        if name != "packing":
            assert left.columns == list(corpus_pipeline.COLUMNS)
