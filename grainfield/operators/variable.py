"""Gene moments, variable features by a binned mean-variance trend, and scaling statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfield.assay import Assay, explode_ids
from grainfield.operators.matrix import scaled_value

N_FEATURES, N_BINS = 2000, 20


def gene_moments(coo: DataFrame, features: DataFrame, n_cells: int, nonzero_only: bool = False) -> DataFrame:
    """gene_id, mean, variance (unbiased) over all cells, absent entries being zeros; nonzero_only: over stored entries."""
    stats = coo.groupBy("gene_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("value").alias("mu"), F.var_pop("value").alias("vp"))
    c = float(n_cells)
    n, mu = F.coalesce("n", F.lit(0.0)), F.coalesce("mu", F.lit(0.0))
    if nonzero_only:
        mean, var = mu, F.when(n > 1, F.col("vp") * n / (n - 1)).otherwise(0.0)
    elif n_cells <= 1:
        mean, var = mu, F.lit(0.0)
    else:
        # the stored block merged with one of c - n zeros
        mean, var = n * mu / c, F.greatest(F.lit(0.0), (F.coalesce("vp", F.lit(0.0)) * n + n * (c - n) / c * mu * mu) / (c - 1))
    return features.select("gene_id").join(stats, "gene_id", "left").select("gene_id", mean.alias("mean"), var.alias("variance"))


def vst_bins(moments: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """bin, center (mean log mean), level (upper median of log variance): one row for each bin of equally many genes."""
    valid = moments.where((F.col("mean") > 0) & (F.col("variance") > 0)).select("gene_id", F.log10("mean").alias("lm"), F.log10("variance").alias("lv"))
    # one row for each gene, ranked in one place
    ranked = valid.withColumns({"rn": F.row_number().over(Window.orderBy("lm", "gene_id")), "nv": F.count(F.lit(1)).over(Window.partitionBy())})
    size = F.greatest(F.lit(1), F.floor(F.col("nv") / n_bins)).cast("long")
    binned = ranked.withColumn("bin", F.floor((F.col("rn") - 1) / size).cast("int")).where(F.col("bin") < n_bins)
    inside = binned.withColumns({"k": F.row_number().over(Window.partitionBy("bin").orderBy("lv", "gene_id")), "sz": F.count(F.lit(1)).over(Window.partitionBy("bin"))})
    return inside.groupBy("bin").agg(F.avg("lm").alias("center"), F.max(F.when(F.col("k") == F.floor(F.col("sz") / 2) + 1, F.col("lv"))).alias("level"))


def vst_trend(moments: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """gene_id, mean, variance, fit: the trend of log variance at each gene, linear between bin centres, flat outside."""
    bins = vst_bins(moments, n_bins)
    w = Window.orderBy("center", "bin")
    spans = bins.withColumns({"center2": F.lead("center").over(w), "level2": F.lead("level").over(w)})
    edge = bins.agg(F.min(F.struct("center", "level")).alias("first"), F.max(F.struct("center", "level")).alias("last"))
    lm = F.when(F.col("mean") > 0, F.log10("mean"))
    g = moments.withColumn("lm", lm)
    # at most n_bins spans
    inside = F.col("lm").between(F.col("center"), F.col("center2"))
    at = F.when(F.col("center2") > F.col("center"), F.col("level") + (F.col("level2") - F.col("level")) * (F.col("lm") - F.col("center")) / (F.col("center2") - F.col("center"))).otherwise(F.col("level"))
    found = g.join(F.broadcast(spans.where("center2 is not null")), inside).groupBy("gene_id").agg(F.min_by(at, "bin").alias("mid"))
    first, last = edge.select("first").scalar(), edge.select("last").scalar()
    wide = g.join(found, "gene_id", "left").withColumns({"_f": first, "_l": last})
    fit = F.when(F.col("lm").isNull() | F.col("_f").isNull(), 0.0).when(F.col("lm") <= F.col("_f.center"), F.col("_f.level")).when(F.col("lm") >= F.col("_l.center"), F.col("_l.level")).otherwise(F.coalesce("mid", F.lit(0.0)))
    return wide.select("gene_id", "mean", "variance", fit.alias("fit"))


def vst_scores(moments: DataFrame, n_bins: int = N_BINS) -> DataFrame:
    """gene_id, mean, variance, vst_variance."""
    score = F.when(F.col("fit") > 0, (F.col("variance") - F.pow(F.lit(10.0), "fit")) / F.pow(F.lit(10.0), F.col("fit") / 2)).otherwise(0.0)
    return vst_trend(moments, n_bins).select("gene_id", "mean", "variance", score.alias("vst_variance"))


def top_features(scores: DataFrame, n: int = N_FEATURES) -> DataFrame:
    """The n genes of largest score (ties: larger gene_id); none for n <= 0."""
    fine = scores.where(~F.isnan("vst_variance") & (F.abs("vst_variance") < float("inf")))
    return fine.orderBy(F.desc("vst_variance"), F.desc("gene_id")).limit(max(0, n)).select("gene_id", "vst_variance")


def find_variable_features(assay: Assay, n: int = N_FEATURES, n_bins: int = N_BINS, nonzero_only: bool = False) -> Assay:
    scores = vst_scores(gene_moments(assay.layer("counts"), assay.features, assay.n_cells, nonzero_only), n_bins)
    flags = scores.select("gene_id") if n >= assay.n_genes else top_features(scores, n).select("gene_id")
    assay.tables["gene_stats"] = scores.join(flags.withColumn("variable", F.lit(True)), "gene_id", "left").withColumn("variable", F.coalesce("variable", F.lit(False)))
    return assay


def scale_stats(data: DataFrame, features: DataFrame, n_cells: int) -> DataFrame:
    """gene_id, residual_mean, residual_sd."""
    return gene_moments(data, features, n_cells).select("gene_id", F.col("mean").alias("residual_mean"), F.sqrt("variance").alias("residual_sd"))


def scaled_matrix(data: DataFrame, features: DataFrame, cells: DataFrame, n_genes: int, n_cells: int, do_center: bool = True, do_scale: bool = True) -> DataFrame:
    """Every entry centred and scaled, zeros included; genes without spread are 0."""
    stats = scale_stats(data, features, n_cells)
    every = explode_ids(cells.select("cell_id"), "gene_id", n_genes).join(data, ["cell_id", "gene_id"], "left").join(stats, "gene_id")
    mean = F.col("residual_mean") if do_center else F.lit(0.0)
    v = F.coalesce("value", F.lit(0.0))
    return every.select("cell_id", F.col("gene_id").cast("int"), (scaled_value(v, mean, F.col("residual_sd")) if do_scale else v - mean).alias("value"))


def scale_data(assay: Assay) -> Assay:
    stats = scale_stats(assay.layer("data"), assay.features, assay.n_cells)
    old = assay.tables.get("gene_stats")
    if old is not None:
        stats = old.drop("residual_mean", "residual_sd").join(stats, "gene_id")
    assay.tables["gene_stats"] = stats
    return assay
