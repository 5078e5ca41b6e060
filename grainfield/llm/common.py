"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.session import checkpointed, shared_folder, ship

__all__ = ["arrow_rows", "broadcast_if_small", "cut", "few_files", "held", "let", "lower_ascii", "new_folder", "removed", "ship", "table", "trim", "words"]

#: White space of the word rule of every operator: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Tables of at most so many (narrow) rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Rows in one file of a materialised table: narrow ones, and documents (or what takes as much work to make).
ROWS_PER_FILE, DOCS_PER_FILE = 20_000, 4_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> bool:
    """Take away a folder of the shared place, whatever file system it is on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, rows: int | None = None, per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Materialise in the shared folder and forget the lineage; a lost executor costs nothing of it.

    rows: about how many rows there are at most, if known: they come in as few tasks and files as that asks for, `per_file` each.
    """
    return checkpointed(df if rows is None else few_files(df, rows, per_file))


def few_files(df: DataFrame, rows: int, per_file: int) -> DataFrame:
    return df.coalesce(max(8, -(-rows // per_file)))


def held(df: DataFrame, rows: int) -> DataFrame:
    """A narrow table of `rows` rows at most: kept by the driver where that is few, else materialised in the shared folder."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema) if rows <= BROADCAST_ROWS else cut(df, rows)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a count (df should be materialised already)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, although body names it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of non-white-space of a text; null: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows, for what is materialised inside: bounds a Python worker's memory for wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def trim() -> None:
    """Give what a Python worker has freed back to the system: workers are kept and would hold the most they ever used."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)
