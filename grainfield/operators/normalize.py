"""Per-cell normalisation of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.assay import Assay, explode_ids

METHODS = ("LogNormalize", "RC", "CLR")


def library_size(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, size_factor: the sum of a cell; 0 for an empty one."""
    sums = counts.groupBy("cell_id").agg(F.sum("value").alias("s"))
    return cells.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.coalesce("s", F.lit(0.0)).alias("size_factor"))


def geo_mean(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, geo_mean over the positive entries; 1 for a cell without any."""
    means = counts.where(F.col("value") > 0).groupBy("cell_id").agg(F.exp(F.avg(F.log("value"))).alias("g"))
    return cells.select("cell_id").join(means, "cell_id", "left").select("cell_id", F.coalesce("g", F.lit(1.0)).alias("geo_mean"))


def _factor(scale_factor: float):
    return F.when(F.col("size_factor") > 0, F.lit(float(scale_factor)) / F.col("size_factor")).otherwise(F.lit(1.0))


def relative_counts(counts: DataFrame, cells: DataFrame, scale_factor: float = 10_000) -> DataFrame:
    return counts.join(library_size(counts, cells), "cell_id").select("cell_id", "gene_id", (F.col("value") * _factor(scale_factor)).alias("value"))


def log_normalize(counts: DataFrame, cells: DataFrame, scale_factor: float = 10_000) -> DataFrame:
    """log1p of the share of a cell times scale_factor, on stored entries."""
    return relative_counts(counts, cells, scale_factor).withColumn("value", F.log1p("value"))


def clr(counts: DataFrame, cells: DataFrame, n_genes: int) -> DataFrame:
    """ln((v + 1) / geometric mean) for every gene of every cell, zeros included; entries that come out 0 are dropped."""
    every = explode_ids(geo_mean(counts, cells), "gene_id", n_genes)
    v = F.log((F.coalesce("value", F.lit(0.0)) + 1) / F.col("geo_mean"))
    return every.join(counts, ["cell_id", "gene_id"], "left").select("cell_id", F.col("gene_id").cast("int"), v.alias("value")).where(F.col("value") != 0)


def normalize_data(assay: Assay, method: str = "LogNormalize", scale_factor: float = 10_000) -> Assay:
    """Layer data and table size_factors from layer counts."""
    counts = assay.layer("counts")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    if method == "CLR":
        assay.layers["data"] = clr(counts, assay.cells, assay.n_genes)
        assay.tables["size_factors"] = geo_mean(counts, assay.cells).withColumnRenamed("geo_mean", "size_factor")
    else:
        assay.layers["data"] = (log_normalize if method == "LogNormalize" else relative_counts)(counts, assay.cells, scale_factor)
        assay.tables["size_factors"] = library_size(counts, assay.cells)
    return assay
