"""Batch correction by mutual nearest neighbours and Gaussian smoothing of their differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.assay import Assay
from grainfield.operators import blocks
from grainfield.operators.cluster import _cut


def reference_batch(cells: DataFrame) -> DataFrame:
    """batch, n of the largest batch (ties: least name)."""
    return cells.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "batch").limit(1)


def mnn_pairs(reference: DataFrame, query: DataFrame, k: int = 20) -> DataFrame:
    """ref_id, query_id of cells (id, vec) that are among each other's k nearest across the two sets."""
    to = blocks.nearest(query, reference, k, skip_self=False).select(F.col("id").alias("query_id"), F.col("nbr_id").alias("ref_id"))
    back = blocks.nearest(reference, query, k, skip_self=False).select(F.col("id").alias("ref_id"), F.col("nbr_id").alias("query_id"))
    return to.join(back, ["query_id", "ref_id"]).select("ref_id", "query_id")


def raw_correction(pairs: DataFrame, reference: DataFrame, query: DataFrame) -> DataFrame:
    """id, vec: mean of reference - query over a query cell's pairs; cells without pairs are absent (zero)."""
    r = reference.select(F.col("id").alias("ref_id"), F.col("vec").alias("rv"))
    q = query.select(F.col("id").alias("query_id"), F.col("vec").alias("qv"))
    diff = pairs.join(r, "ref_id").join(q, "query_id").select("query_id", F.posexplode(F.zip_with("rv", "qv", lambda a, b: a - b)).alias("pos", "d"))
    mean = diff.groupBy("query_id", "pos").agg(F.avg("d").alias("d"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", "d"))), lambda x: x["d"])
    return mean.groupBy(F.col("query_id").alias("id")).agg(vec.alias("vec"))


def smoothed_correction(query: DataFrame, raw: DataFrame, sigma: float = 0.1) -> DataFrame:
    """id, vec: kernel-weighted mean of the raw corrections; bandwidth sigma times the norm of the least-id query cell."""
    first = query.orderBy("id").first()
    if first is None:
        return query
    dim = len(first["vec"])
    width = sigma * sum(float(v) ** 2 for v in first["vec"]) ** 0.5
    width = width if width >= 1e-6 else 1.0
    source = query.join(raw.select("id", F.col("vec").alias("c")), "id").where(F.exists("c", lambda x: x != 0)).select("id", F.concat(F.col("vec").cast("array<double>"), "c").alias("vec"))
    source = _cut(source)  # else the pairs are found again to count it
    sums = blocks.gaussian_mean(query.select("id", F.col("vec").cast("array<double>").alias("vec")), source, width, dim)
    vec = F.transform("sums", lambda s: F.when(F.col("weight") > 1e-10, s / F.greatest(F.col("weight"), F.lit(1e-300))).otherwise(0.0))
    return sums.select("id", vec.alias("vec"))


def integrate(embeddings: DataFrame, cells: DataFrame, n_ccs: int = 30, n_mnn: int = 20, sigma: float = 0.1, max_iter: int = 2) -> DataFrame:
    """cell_id, vec: the first n_ccs coordinates, all but the largest batch moved towards it."""
    if min(n_ccs, n_mnn, max_iter) < 1 or sigma <= 0:
        raise ValueError("n_ccs, n_mnn, sigma and max_iter must be positive")
    if "batch" not in cells.columns:
        raise ValueError("cells have no column batch")
    rows = embeddings.join(cells.select("cell_id", "batch"), "cell_id").select(F.col("cell_id").alias("id"), F.slice("vec", 1, n_ccs).cast("array<double>").alias("vec"), "batch")
    if cells.select("batch").distinct().limit(2).count() <= 1:
        return rows.select(F.col("id").alias("cell_id"), "vec")
    ref = reference_batch(cells).first()["batch"]
    reference = rows.where(F.col("batch").eqNullSafe(F.lit(ref))).select("id", "vec")
    query = rows.where(~F.col("batch").eqNullSafe(F.lit(ref))).select("id", "vec")
    for _ in range(max_iter):
        move = smoothed_correction(query, raw_correction(mnn_pairs(reference, query, n_mnn), reference, query), sigma)
        query = _cut(query.join(move.select("id", F.col("vec").alias("c")), "id", "left").select("id", F.when(F.col("c").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "c", lambda a, b: a + b)).alias("vec")))
    return reference.unionByName(query).select(F.col("id").alias("cell_id"), "vec")


def integrate_assay(assay: Assay, batch: str = "batch", **options) -> Assay:
    """Tables mnn and (the same) harmony from table embeddings."""
    cells = assay.cells.select("cell_id", F.col(batch).alias("batch"))
    assay.tables["mnn"] = assay.tables["harmony"] = integrate(assay.table("embeddings"), cells, **options)
    return assay
