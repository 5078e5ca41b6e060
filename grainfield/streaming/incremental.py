"""Count entries that arrive as a stream: library sizes and gene moments as mergeable sums, and columns appended to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.sources import store


def library_size(entries: DataFrame) -> DataFrame:
    """cell_id, size_factor so far (complete or update mode)."""
    return entries.groupBy("cell_id").agg(F.sum("value").alias("size_factor"))


def gene_sums(entries: DataFrame) -> DataFrame:
    """gene_id, n, s, ss so far: what moments with implicit zeros need."""
    return entries.groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))


def moments(sums: DataFrame, n_cells: int) -> DataFrame:
    """gene_id, mean, variance from gene_sums over n_cells cells."""
    c = float(n_cells)
    mean = F.col("s") / c
    return sums.select("gene_id", mean.alias("mean"), F.greatest(F.lit(0.0), (F.col("ss") - c * mean * mean) / max(1.0, c - 1)).alias("variance"))


def append_columns(entries: DataFrame, cells: DataFrame, features: DataFrame, path: str, assay: str, batch: int, layer: str = "counts") -> None:
    """Add a batch of whole columns (cells and their entries) to a stored assay; the first one makes it.

    For foreachBatch: each batch is a folder of its own, written over if the batch is run again, so a repeated batch adds nothing.
    """
    spark, top = entries.sparkSession, store.root(path, assay)
    if not store.exists(spark, f"{top}/features"):
        store.write_table(features, f"{top}/features")
    store.write_table(entries, f"{top}/layers/{layer}/batch={int(batch)}", sort=["cell_id", "gene_id"])
    store.write_table(cells, f"{top}/cells/batch={int(batch)}")
