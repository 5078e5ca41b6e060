"""Language ID by Bayesian evidence fusion.

log posterior = text likelihood (hashed byte trigrams, tempered) + declared markup language + address suffix
+ host prior. The text model is fitted on a bounded sample of rows with a declared language; what
markup and suffixes say, and how hosts are made up, are counts over all documents (by their language from text alone),
gathered by grouped aggregation; host priors are smoothed towards their suffix, and suffixes towards the corpus.

Columns: text; the fitted label (lang); a host (source, or the host of a url column). Two scans, no shuffle of text. Every
host, suffix and label counts; a column of more than LANGUAGES labels is refused.

Defined results: one row for each input row. Null texts and texts without a letter have no text evidence;
a document without evidence, or whose best posterior is below `least`, is `und` and rejected. A null host has the
corpus as its prior, a host without a document of known text its suffix. An empty table, or one without labels, gives `und` for all. Ties go to the first code.
Columns of the input are kept; lang_id, posterior and accepted replace ones of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.llm.common import BROADCAST_ROWS, broadcast_if_small, cut, ship, trim

BUCKETS = 1 << 15
#: Labelled rows for each language, labels beyond which a column is refused as no language code, the pull of texts (share of a
#: trigram's evidence that counts, and trigrams that count at most), pseudo-counts of the priors, least posterior.
SAMPLE = 3_000
LANGUAGES = 1_000
TEMPER, MOST_TRIGRAMS = 0.2, 2_000
HOST_WEIGHT, SUFFIX_WEIGHT, CHANNEL_WEIGHT = 20.0, 50.0, 5.0
LEAST = 0.5

_DECLARED = r"""(?is)<(?:html|body)\b[^>]*?\b(?:xml:)?lang\s*=\s*["']?([a-z]{2,3})\b"""


def _codes(text: str | None) -> np.ndarray:
    b = np.frombuffer((text or "").lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(17)).astype(np.int64)


def fit_text(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log p(trigram bucket | language), from at most `sample` rows of each."""
    names = docs.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(label).distinct().limit(LANGUAGES + 1)
    names = sorted(r[0] for r in names.collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"{label} has more than {LANGUAGES} labels: no language code")
    if not names:
        return [], np.zeros((BUCKETS, 0), np.float32)
    ranked = docs.where(F.col(label).isin(names) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("_label"))
    order = Window.partitionBy("_label").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = cut(ranked.distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample).select("doc_id", "_label"), sample * len(names))
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id").select("_label", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            for label_, text in zip(pdf["_label"], pdf["text"], strict=True):
                c = np.bincount(_codes(text), minlength=BUCKETS)
                # a long text counts no more than some ordinary ones
                total = c.sum()
                if total:
                    sums[label_] = sums.get(label_, 0) + c * min(1.0, 20_000 / total)
        if sums:
            yield pd.DataFrame({"label": pd.Series(list(sums), dtype=object), "counts": [v.astype("<f4").tobytes() for v in sums.values()]})

    got = texts.repartition(8).mapInPandas(count, "label string, counts binary").collect()
    table = np.zeros((BUCKETS, len(names)))
    for r in got:
        table[:, names.index(r["label"])] += np.frombuffer(r["counts"], "<f4")
    seen = table.sum(axis=0)
    return names, np.log((table + 0.5) / (seen + 0.5 * BUCKETS)).astype(np.float32)


def _likelihood(model: np.ndarray):
    n = model.shape[1]

    def text_likelihood(texts: pa.Array) -> pa.Array:
        out = []
        for text in (x.as_py() for x in texts):
            codes = _codes(text) if text and any(map(str.isalpha, text)) else ()
            if not len(codes):
                out.append([0.0] * n)
                continue
            total = np.zeros(n)
            for i in range(0, len(codes), 65_536):
                total += model[codes[i : i + 65_536]].sum(axis=0, dtype=np.float64)
            total *= TEMPER * min(1.0, MOST_TRIGRAMS / len(codes))
            out.append((total - total.max()).tolist())
        trim()
        return pa.array(out, pa.list_(pa.float64()))

    # else a filter on what follows from it is pushed below and evaluates it once more, in a second Python worker for each task
    return F.arrow_udf(text_likelihood, "array<double>").asNondeterministic()


def host_of(url: Column) -> Column:
    """The host of an address, without user, port and case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _suffix(host: Column) -> Column:
    return F.when(F.instr(host, ".") > 0, F.lower(F.element_at(F.split(host, r"\."), -1)))


def _best(scores: Column) -> Column:
    """1-based place of the first maximum; null if all are equal."""
    return F.when(F.array_max(scores) > F.array_min(scores), F.array_position(scores, F.array_max(scores)))


def language_id(docs: DataFrame, host: Column | None = None, markup: Column | None = None, label: str = "lang", least: float = LEAST, targets: list[str] | None = None, sample: int = SAMPLE, fitted: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """docs with lang_id, posterior, accepted. host: defaults to the column source; markup: to the text. fitted: what fit_text
    has found on other rows; then docs need no label."""
    ship(docs.sparkSession)
    names, model = fitted or fit_text(docs, label, sample)
    named = [c for c in docs.columns if c not in ("lang_id", "posterior", "accepted")]
    # the input's columns travel as one, so that none of their names meets one of ours
    whole = F.struct(*[F.col(f"`{c}`") for c in named]).alias("_row")
    kept = [F.col("_row").getField(c).alias(c) for c in named]
    n = len(names)
    if n == 0:
        return docs.select(whole).select(*kept, F.lit("und").alias("lang_id"), F.lit(0.0).alias("posterior"), F.lit(False).alias("accepted"))
    likelihood = _likelihood(model)
    where = F.col("source") if host is None else host
    declared = F.lower(F.regexp_extract(F.coalesce(F.col("text") if markup is None else markup, F.lit("")), _DECLARED, 1))
    codes = F.array(*[F.lit(x) for x in names])
    seen = docs.select(whole, where.alias("_host"), _suffix(where).alias("_suffix"), F.nullif(F.array_position(codes, declared), F.lit(0)).alias("_said"), likelihood("text").alias("_text"))

    # one row for each host, suffix, declaration and language from text alone
    n_docs = docs.count()
    counted = seen.select("_host", "_suffix", "_said", _best(F.col("_text")).alias("_is")).where(F.col("_is").isNotNull())
    counted = cut(counted.groupBy("_host", "_suffix", "_said", "_is").agg(F.count(F.lit(1)).alias("n")), n_docs)
    per = [F.sum(F.when(F.col("_is") == i + 1, F.col("n")).otherwise(0)).cast("double") for i in range(n)]
    corpus = counted.agg(*[F.coalesce(p, F.lit(0.0)).alias(f"c{i}") for i, p in enumerate(per)]).first()
    total = sum(corpus)
    share = [(corpus[i] + 1.0) / (total + n) for i in range(n)]
    said = {r["_said"]: r["c"] for r in counted.where(F.col("_said").isNotNull()).groupBy("_said").agg(F.array(*per).alias("c")).collect()}

    literal = lambda xs: F.array(*[F.lit(float(x)) for x in xs])

    def smoothed(table: DataFrame, counts: str, towards: Column, weight: float, name: str) -> DataFrame:
        """The shares of counts, drawn to `towards` by `weight` pseudo-counts."""
        table = table.withColumns({"_m": F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), "_t": towards})
        return table.withColumn(name, F.zip_with(counts, "_t", lambda x, t: (x + t * weight) / (F.col("_m") + weight))).drop("_m", "_t", counts)

    logs = lambda c: F.transform(c, lambda x: F.log(x))
    suffixes = counted.where(F.col("_suffix").isNotNull()).groupBy(F.col("_suffix").alias("_k")).agg(F.array(*per).alias("_s"))
    suffixes = cut(smoothed(suffixes, "_s", literal(share), SUFFIX_WEIGHT, "_up"), n_docs)
    hosts = counted.where(F.col("_host").isNotNull()).groupBy("_host", "_suffix").agg(F.array(*per).alias("_c"))
    hosts = hosts.join(broadcast_if_small(suffixes), F.col("_suffix") == F.col("_k"), "left")
    hosts = smoothed(hosts, "_c", F.coalesce("_up", literal(share)), HOST_WEIGHT, "_p")
    hosts = cut(hosts.select(F.col("_host").alias("_h"), logs("_p").alias("_prior")), n_docs)
    # log p(declaration | language), a share of declarations being simply wrong; a row for each language
    all_said = [sum(c[i] for c in said.values()) for i in range(n)]
    right = lambda d, i: 0.9 if i == d - 1 else 0.1 / max(1, n - 1)
    channel = [[float(np.log((said.get(d, [0.0] * n)[i] + CHANNEL_WEIGHT * right(d, i)) / (all_said[i] + CHANNEL_WEIGHT))) for i in range(n)] for d in range(1, n + 1)]
    # from Arrow: a list of rows would go through Python workers of their own
    channel = pa.table({"_d": pa.array(range(1, n + 1), pa.int32()), "_channel": pa.array(channel, pa.list_(pa.float64()))})
    channel = F.broadcast(docs.sparkSession.createDataFrame(channel, "_d int, _channel array<double>"))
    rows = seen.join(broadcast_if_small(hosts, None, BROADCAST_ROWS), F.col("_host") == F.col("_h"), "left").join(channel, F.col("_said") == F.col("_d"), "left")
    rows = rows.join(broadcast_if_small(suffixes.withColumnRenamed("_k", "_x")), F.col("_suffix") == F.col("_x"), "left")
    prior = F.coalesce("_prior", logs("_up"), literal(np.log(share)))
    parts = F.zip_with(F.zip_with(F.col("_text"), prior, lambda a, b: a + b), F.coalesce("_channel", literal([0.0] * n)), lambda a, b: a + b)
    evidence = _best(F.col("_text")).isNotNull() | F.col("_said").isNotNull()
    rows = rows.withColumns({"_all": parts, "_known": evidence})
    top = F.array_max("_all")
    posterior = 1.0 / F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    rows = rows.withColumn("posterior", F.when(F.col("_known"), posterior).otherwise(0.0))
    sure = F.col("_known") & (F.col("posterior") >= least)
    lang = F.when(sure, F.element_at(codes, F.array_position("_all", top).cast("int"))).otherwise("und")
    accepted = sure if targets is None else sure & F.element_at(codes, F.array_position("_all", top).cast("int")).isin(targets)
    return rows.select(*kept, lang.alias("lang_id"), "posterior", accepted.alias("accepted"))
