"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Native: split, hash, count and score are DataFrame functions only. Two scans of the corpus; what is
shuffled is one row for each bucket and task.

Defined results: null or blank texts have no words, so they fail the base rule. A document without
n-grams scores 0. Null or repeated doc_ids are rows like any other (one result row for each row).
Labels with a null doc_id or quality are no evidence; repeated labels count once. Without trusted rows
every score is 0. Extra columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfield.llm.common import SPACE_CLASS, let, words

#: N-gram buckets (the weights, 8 bytes each, are the only thing sent to every task), the bound on the trusted
#: documents that the target is fitted on, the pseudo-count, and the least mean log ratio (nats for each n-gram).
BUCKETS = 65_536
TRUSTED_BOUND = 20_000
SMOOTHING = 4.0
THRESHOLD = -0.09


def _repeat_words(w: Column) -> Column:
    """Words lying in a 3-word window whose content occurs twice or more in the same text."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - v, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def of_sorted(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))
        starts = F.filter(F.transform(s, lambda x, k: F.when(same(x, k), x["i"]).otherwise(F.lit(-1))), lambda i: i >= 0)
        return let(F.sort_array(starts), covered)

    def of_hashes(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(ranked, of_sorted))

    hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(hashes, of_hashes))


def _buckets(w: Column, buckets: int) -> Column:
    """Hashed one- and two-word grams."""
    put = lambda h: F.pmod(h, F.lit(buckets).cast("long")).cast("int")
    single = F.transform(w, lambda x: put(F.xxhash64(x)))
    double = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: put(F.xxhash64(x, F.get(w, i + 1))))
    return F.concat(single, double)


def base_features(text: Column) -> dict[str, Column]:
    """The rule columns, by name; every one of them is a row-local expression."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(F.regexp_replace(text, SPACE_CLASS + "+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "counted": let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))),
    }


def ngram_counts(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, raw, target: n-gram counts over all documents and over the trusted ones (a bounded, broadcast id list)."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(trusted_ids.withColumn("_trusted", F.lit(1).cast("long"))), "doc_id", "left")
    grams = flagged.select(F.coalesce("_trusted", F.lit(0).cast("long")).alias("t"), F.explode(let(words(F.col("text")), lambda w: _buckets(w, buckets))).alias("bucket"))
    return grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))


def trusted_sample(labels: DataFrame, bound: int = TRUSTED_BOUND) -> DataFrame:
    """Ids of at most `bound` documents labelled of good quality, by the order of a hash."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, bound: int = TRUSTED_BOUND, threshold: float = THRESHOLD, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, rule columns, base_failed, llr (mean over the n-grams), kept."""
    counts = ngram_counts(docs, trusted_sample(labels, bound), buckets)
    # at most `buckets` rows reach the driver; the weights go back as one literal array, read by position
    rows = counts.collect()
    raw, target = sum(r["raw"] for r in rows), sum(r["target"] for r in rows)
    # log ratio of the two shares, drawn to 0 where the target is too small to have seen the bucket anyway
    expected = target / raw if raw else 0.0
    weight = {r["bucket"]: math.log((r["target"] + smoothing) / (r["raw"] * expected + smoothing)) for r in rows} if target else {}
    weights = F.split(F.lit(",".join(f"{weight.get(i, 0.0):.9g}" for i in range(buckets))), ",").cast("array<double>")
    llr = let(
        let(words(F.col("text")), lambda w: _buckets(w, buckets)),
        lambda b: F.when(F.size(b) == 0, F.lit(0.0)).otherwise(F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(weights, x)) / F.size(b)),
    )
    f = base_features(F.col("text"))
    scored = docs.select("doc_id", *[v.alias(k) for k, v in f.items()], llr.alias("llr"))
    n, rep = F.col("counted.n_words"), F.col("counted.n_repeat_words")
    failed = (n < 50) | (rep * 100 > n * 50)
    return scored.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", rep.alias("n_repeat_words"), failed.alias("base_failed"), "llr",
        (~failed & (F.col("llr") >= threshold)).alias("kept"),
    )
