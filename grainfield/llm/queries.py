"""The registered queries opN_<name> of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm import ann, langid, linededup, tokenbin
from grainfield.llm.common import cut, new_folder, table
from grainfield.llm.langid import language_id
from grainfield.llm.linededup import line_dedup
from grainfield.llm.mix import mix
from grainfield.llm.neardup import near_dedup
from grainfield.llm.packing import pack
from grainfield.llm.quality import quality
from grainfield.llm.secrets import secrets
from grainfield.llm.toxicity import toxicity


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "lang_id", F.round("posterior", 6).alias("posterior"), "accepted")


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op4 over pages, where all its evidence is at hand: hosts, address suffixes, declared markup languages."""
    pages = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), "<[^>]*>", " ")
    rows = pages.select("page_id", "url", "html", bare.alias("text"))
    found = language_id(rows, langid.host_of(F.col("url")), F.col("html"), fitted=langid.fit_text(table(spark, sf_dir, "documents")))
    return found.select("page_id", "lang_id", F.round("posterior", 6).alias("posterior"), "accepted")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), "n_removed")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-ids")
    rows = cut(tokenbin.write_and_read_back(table(spark, sf_dir, "documents"), folder))
    tokenbin.remove(folder)
    return rows


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def conversations_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op10 over instruction data: turns of conversations, of which the assistant's bear loss; all three limits bind.

    doc_id is conv_id * 2^20 + turn.
    """
    turns = table(spark, sf_dir, "conversations").select((F.shiftleft(F.col("conv_id").cast("long"), 20) + F.col("turn")).alias("doc_id"), "text", (F.col("role") == "assistant").alias("learned"))
    return pack(turns, max_segments=6, max_loss=768, loss="learned")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_secrets, op2_nearest, op3_mix, op4_language_id, pages_language_id, op5_near_dedup, op6_line_dedup, op7_token_ids, op8_toxicity, op9_quality, op10_packing, conversations_packing]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": linededup.sql()}
