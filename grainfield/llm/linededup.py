"""Line dedup by distinct-site spread.

A line (without the white space at its ends, known by 128 bits of hash) is boilerplate if it stands in documents of at least
`min_sites` distinct sources. HyperLogLog sketches of the sources, one for each line hash and merged by
aggregation, decide lines whose estimate is far from that number; lines near it get exact distinct counts.
A boilerplate line stays in the document of the smallest doc_id that has it and goes from all others.

Native: DataFrame functions only. A line found everywhere costs one sketch for each task.

Defined results: one row for each input row, in any order, with all its columns. Lines without a word are
never boilerplate and stay. Null texts stay null. A null source is a site of its own. A null doc_id counts as
larger than all others; rows that repeat a doc_id are treated as one document. A text whose lines all go
becomes empty. Columns of the input are kept whatever their names; `n_removed` replaces one of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfield.llm.common import BROADCAST_ROWS, DOCS_PER_FILE, broadcast_if_small, cut

#: Least number of sites, sketch size (2^n registers), and the half-width of the band of estimates that are
#: counted exactly: a share of min_sites, some nine standard errors of such a sketch.
MIN_SITES = 8
LG_K = 10
BAND = 0.3

SPACES = " \t\n\x0b\x0c\r"


def _hash(line: Column) -> Column:
    """128 bits of hash of a line without the white space at its ends; null if nothing is left."""
    body = F.btrim(line, F.lit(SPACES))
    return F.when(body != "", F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit("second"), body).alias("b")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(h, h2, first_doc, sites) of the boilerplate lines; and their places (doc_id, t, pos, h, h2), t the hash of the text.

    Two halves of 128 bits name a line: among 10^12 different lines two that agree are not to be expected.
    """
    site = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    places = docs.where(F.col("text").isNotNull()).select(
        "doc_id", site.alias("site"), F.xxhash64("text").alias("t"), F.posexplode(F.transform(_lines(F.col("text")), _hash)).alias("pos", "line")
    )
    places = places.where(F.col("line").isNotNull()).select("doc_id", "site", "t", "pos", F.col("line.a").alias("h"), F.col("line.b").alias("h2"))
    line = ["h", "h2"]
    spread = places.groupBy(*line).agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("doc_id").alias("first_doc"))
    sized = spread.select(*line, "first_doc", F.hll_sketch_estimate("sketch").alias("estimate"))
    # lines on several sites are fewer than documents: that many files hold them
    n_docs = docs.count()
    found = cut(sized.where(F.col("estimate") >= min_sites * (1 - band)), n_docs)
    n = found.count()
    hits = cut(places.join(broadcast_if_small(found.select(*line, "estimate"), n, broadcast_rows), line), n_docs, DOCS_PER_FILE)
    near = F.col("estimate") <= min_sites * (1 + band)
    exact = hits.where(near).select(*line, "site").distinct().groupBy(*line).agg(F.count(F.lit(1)).alias("exact"))
    lines = found.join(exact, line, "left").select(*line, "first_doc", F.coalesce("exact", "estimate").alias("sites")).where(F.col("sites") >= min_sites)
    return cut(lines, n), hits.select("doc_id", "t", "pos", *line)


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, band: float = BAND, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents without boilerplate lines, and n_removed."""
    lines, hits = boilerplate(docs, min_sites, lg_k, band, broadcast_rows)
    gone = hits.join(broadcast_if_small(lines.select("h", "h2", "first_doc"), None, broadcast_rows), ["h", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
    gone = gone.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.collect_set("pos").alias("_gone"))
    kept = [c for c in docs.columns if c != "n_removed"]
    # the input's columns travel as one, so that none of their names meets one of ours
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), "doc_id", "text")
    joined = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t")), "left")
    all_ = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("_gone"))
    # bind the split text once; the lambda reads it by position
    rebuilt = F.get(F.transform(F.array(F.struct(all_.alias("l"), left.alias("k"))), lambda x: F.array_join(F.transform(x["k"], lambda i: F.get(x["l"], i)), "\n")), F.lit(0))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(rebuilt)
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in kept], F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))


def sql(min_sites: int = MIN_SITES) -> str:
    """The same over the view documents, in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, * FROM documents),
places AS (
  SELECT rid, doc_id, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM d WHERE text IS NOT NULL),
bodies AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body FROM places),
boiler AS (SELECT body, min(doc_id) AS first_doc FROM bodies WHERE body <> '' GROUP BY body HAVING count(DISTINCT site) >= {min_sites}),
marked AS (SELECT b.rid, b.line, b.pos, x.body IS NOT NULL AND b.doc_id IS DISTINCT FROM x.first_doc AS gone FROM bodies b LEFT JOIN boiler x ON b.body = x.body),
texts AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*) FILTER (WHERE gone) AS n_removed FROM marked GROUP BY rid)
SELECT d.doc_id, t.text, d.lang, d.source, length(t.text) AS n_chars, coalesce(t.n_removed, 0) AS n_removed
FROM d LEFT JOIN texts t ON d.rid = t.rid
"""
