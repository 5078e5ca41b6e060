"""The log-likelihood ratio and the verdict against plain counts, and the fixed threshold on labels that were not fitted on."""

import math
import re
from collections import Counter

import numpy as np

from grainfield.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    import xxhash

    w = [x.encode() for x in WORD.findall(text or "")]
    single = [xxhash.xxh64_intdigest(x, 42) for x in w]
    signed = [h - (1 << 64) if h >> 63 else h for h in single]
    double = [xxhash.xxh64_intdigest(y, h) for y, h in zip(w[1:], single, strict=False)]
    signed += [h - (1 << 64) if h >> 63 else h for h in double]
    return [h % q.BUCKETS for h in signed]


def test_scores_and_verdicts(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    found = {r["doc_id"]: grams(r["text"]) for r in docs.collect()}
    raw, target = Counter(), Counter()
    for i, g in found.items():
        raw.update(g)
        if i in good:
            target.update(g)
    share = sum(target.values()) / sum(raw.values())
    weight = {b: math.log((target[b] + q.SMOOTHING) / (n * share + q.SMOOTHING)) for b, n in raw.items()}
    got = {r["doc_id"]: r for r in q.quality(docs, labels).collect()}
    for i, g in found.items():
        want = sum(weight[b] for b in g) / len(g) if g else 0.0
        assert math.isclose(got[i]["llr"], want, rel_tol=1e-6, abs_tol=1e-8)
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["llr"] >= q.THRESHOLD)
    assert len(got) == len(found)


def test_threshold_on_labels_not_fitted_on(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = q.quality(docs, labels.where("crc32(cast(doc_id as string)) % 2 = 0")).join(labels.where("crc32(cast(doc_id as string)) % 2 = 1").select("doc_id", "quality"), "doc_id").where("not base_failed").toPandas()
    assert got["kept"][got["quality"] == 1].mean() > 0.97 and (not (got["quality"] == 0).any() or got["kept"][got["quality"] == 0].mean() < 0.1)
    assert np.isfinite(got["llr"]).all()


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g h")], "doc_id long, text string")
    once = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    score = lambda labels: [r["llr"] for r in q.quality(docs, labels).orderBy("doc_id").collect()]
    assert score(once) == score(once.unionByName(once)) and score(once)[0] > score(once)[1] and score(once.limit(0)) == [0.0, 0.0]
