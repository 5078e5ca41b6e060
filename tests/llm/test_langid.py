"""Language ID against a slow version of the stated sum, and on rows that it was not fitted on."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.llm import langid, queries


@pytest.fixture(scope="module")
def mixed(spark, sf):
    """Documents with hosts that have suffixes, and with declarations that are right, wrong or missing."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0")
    host = F.when(F.col("doc_id") % 7 != 0, F.concat("source", F.lit("."), F.when(F.col("doc_id") % 5 == 0, "org").otherwise(F.col("lang"))))
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit('<html lang="'), F.col("lang"), F.lit('">'))).when(F.col("doc_id") % 11 == 0, '<body xml:lang=fr>')
    return docs.select("doc_id", "text", "lang", host.alias("source"), said.alias("markup"))


def test_posterior_against_brute_force(mixed):
    names, model = langid.fit_text(mixed)
    got = {r["doc_id"]: r for r in langid.language_id(mixed, markup=F.col("markup")).collect()}
    rows = mixed.collect()
    text, known = {}, {}
    for r in rows:
        codes = langid._codes(r["text"]) if r["text"] and any(map(str.isalpha, r["text"])) else []
        total = sum((model[c].astype(float) for c in codes), np.zeros(len(names)))
        total = total * langid.TEMPER * min(1.0, langid.MOST_TRIGRAMS / len(codes)) if len(codes) else total
        text[r["doc_id"]] = total - total.max()
        known[r["doc_id"]] = names[int(total.argmax())] if len(codes) and total.max() > total.min() else None
    said = {r["doc_id"]: (re.search("lang=.?([a-z]{2})", r["markup"]) or [None, None])[1] if r["markup"] else None for r in rows}
    corpus, suffix, host, declared = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        k = known[r["doc_id"]]
        if k:
            corpus[k] += 1
            host[r["source"]][k] += 1
            if r["source"] and "." in r["source"]:
                suffix[r["source"].rsplit(".", 1)[1]][k] += 1
            if said[r["doc_id"]] in names:
                declared[said[r["doc_id"]]][k] += 1
    n, all_ = len(names), sum(corpus.values())
    for r in rows:
        share = {k: (corpus[k] + 1) / (all_ + n) for k in names}
        if r["source"] is not None:
            end = suffix[r["source"].rsplit(".", 1)[1]]
            share = {k: (end[k] + langid.SUFFIX_WEIGHT * share[k]) / (sum(end.values()) + langid.SUFFIX_WEIGHT) for k in names}
            own = host[r["source"]]
            share = {k: (own[k] + langid.HOST_WEIGHT * share[k]) / (sum(own.values()) + langid.HOST_WEIGHT) for k in names}
        score = []
        d = said[r["doc_id"]] if said[r["doc_id"]] in names else None
        for i, k in enumerate(names):
            x = text[r["doc_id"]][i] + math.log(share[k])
            if d:
                right = 0.9 if d == k else 0.1 / (n - 1)
                x += math.log((declared[d][k] + langid.CHANNEL_WEIGHT * right) / (sum(c[k] for c in declared.values()) + langid.CHANNEL_WEIGHT))
            score.append(x)
        best = max(score)
        mine = got[r["doc_id"]]
        if known[r["doc_id"]] is None and d is None:
            assert mine["lang_id"] == "und" and mine["posterior"] == 0 and not mine["accepted"]
        else:
            assert math.isclose(mine["posterior"], 1 / sum(math.exp(x - best) for x in score), rel_tol=1e-4)
            assert mine["lang_id"] == (names[score.index(best)] if mine["posterior"] >= langid.LEAST else "und")


def test_agreement_on_rows_not_fitted_on(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    half = docs.withColumn("said", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = langid.language_id(half, label="said").where("doc_id % 2 = 1").collect()
    assert np.mean([r["lang"] == r["lang_id"] for r in got]) > 0.97


def test_pages(spark):
    """Pages by host, suffix and declared language: the language is in the address, which the operator does not read."""
    d = "/root/testdata/sf0.01"
    got = queries.pages_language_id(spark, d).join(spark.read.parquet(f"{d}/pages.parquet"), "page_id").select("lang_id", "accepted", F.regexp_extract("url", r"://[^/]+/([a-z]{2})/", 1).alias("want")).collect()
    want = [r for r in got if r["want"]]
    assert len(want) > 100 and np.mean([r["want"] == r["lang_id"] for r in want]) > 0.95


def test_evidence_beyond_the_text(spark):
    """Equal texts, told apart by what hosts and suffixes mostly write in, and by what the markup says."""
    rows = [(i, "the house and the garden are here", "en", "a.uk") for i in range(40)] + [(100 + i, "das haus und der garten sind hier", "de", "b.de") for i in range(40)]
    rows += [(900, "and und hier x", None, "new.de"), (901, "and und hier x", None, "new.uk"), (902, "and und hier x", None, None), (903, "and und hier x", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("m", F.when(F.col("doc_id") == 902, '<html lang="de">'))
    got = {r["doc_id"]: r for r in langid.language_id(df, markup=F.col("m")).collect()}
    german = {i: got[i]["posterior"] if got[i]["lang_id"] == "de" else 1 - got[i]["posterior"] for i in range(900, 904)}
    assert german[901] < german[903] < german[900] and german[903] < german[902]


def test_hosts_of_addresses(spark):
    df = spark.createDataFrame([("http://u:p@A.b.ORG:80/x",), ("no address",), (None,), ("https://x.fr?y=1",)], "u string")
    assert [r[0] for r in df.select(langid.host_of(F.col("u"))).collect()] == ["a.b.org", None, None, "x.fr"]


def test_too_many_labels(spark):
    with pytest.raises(ValueError):
        langid.fit_text(spark.range(langid.LANGUAGES + 5).selectExpr("id doc_id", "'x' text", "cast(id as string) lang"))


def test_texts_are_scored_once_a_scan(spark, mixed, monkeypatch):
    """A filter on the verdict (the pipeline's) or on the best language must not score a text again in a second Python worker."""
    plans, cut = [], langid.cut
    monkeypatch.setattr(langid, "cut", lambda df, *a: plans.append(df) or cut(df, *a))
    plans.append(langid.language_id(mixed, markup=F.col("markup")).where("accepted"))
    scored = [df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") for df in plans]
    assert max(scored) == 1 and scored[-1] == 1 and sum(scored) == 2


def test_no_rows_through_plain_python_workers(spark, mixed, monkeypatch):
    """Executors keep Python workers for each kind of work: rows made from a list would add a daemon and workers of another kind."""
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("a list of rows"))
    assert langid.language_id(mixed, markup=F.col("markup")).where("accepted").count() > 0
