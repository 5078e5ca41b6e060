"""Training-data pipeline over documents: language ID, line dedup, near dedup, mixing of sources, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. No SQL states the whole (language models, tokens), so ORACLE_SQL is None: the tests hold run() and each
stage against a plain version of what the stage does with its operator's verdicts, the operators themselves against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfield.llm.common import DOCS_PER_FILE, broadcast_if_small, cut, few_files, new_folder, removed, table
from grainfield.llm.langid import language_id
from grainfield.llm.linededup import line_dedup
from grainfield.llm.mix import solve, word_count
from grainfield.llm.neardup import near_dedup
from grainfield.llm.packing import pack

#: Pieces that the encoder of a worker remembers: few, since a worker also keeps what the other stages need.
MEMO = 60_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars following the text."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter or a sure language go."""
    return _columns(language_id(docs.select(*COLUMNS)).where("accepted"))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that many sources share stay in one of them."""
    return _columns(line_dedup(docs))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least doc_id; rows that repeat its doc_id and text stay once.

    Rows of one doc_id with several texts are one document with several parts: they stay or go together.
    """
    found, n_docs = near_dedup(docs), docs.count()
    gone = cut(found.where(~F.col("kept")).select("doc_id").distinct(), n_docs)
    left = docs.join(broadcast_if_small(gone), "doc_id", "left_anti")
    twice = cut(found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where(F.col("count") > 1).select("doc_id"), n_docs)
    if twice.isEmpty():
        return _columns(left)
    again = left.join(broadcast_if_small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return _columns(left.join(broadcast_if_small(twice), "doc_id", "left_anti").unionByName(again))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    The documents are written once with a row number and their size; the mix is solved on the narrow columns of that table
    and applied to it row by row, so no text is shuffled and rows that repeat one another keep their own copies.
    """
    path = new_folder(spark, "mix")
    numbered = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_rid"), word_count(F.col("text")).alias("size"))
    few_files(numbered, docs.count(), DOCS_PER_FILE).write.parquet(path)
    rows = spark.read.parquet(path)
    taken = solve(rows.select("doc_id", "source", "size", "_rid")).applied(rows).where(F.col("copies") > 0)
    return _columns(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. The workers also serve the other stages, so the encoder remembers less."""
    return pack(docs, memo=MEMO)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_boilerplate),
    ("near_dedup", remove_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next; a folder goes when the next stage's is there."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            removed(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
