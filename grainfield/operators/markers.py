"""Marker tests between groups of cells, on sparse data: implicit zeros are one weighted block, never rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.functions.mathx import erfc

TESTS = ("wilcox", "t", "LR")
PSEUDO = 1e-9


def group_sizes(idents: DataFrame, pairs: DataFrame) -> DataFrame:
    """ident_1, ident_2, n1, n2; ident_2 null: all other cells."""
    n = idents.groupBy("ident").agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = n.agg(F.sum("n")).scalar()
    a = n.select(F.col("ident").alias("ident_1"), F.col("n").alias("n1"))
    b = n.select(F.col("ident").alias("ident_2"), F.col("n").alias("m"))
    p = pairs.join(a, "ident_1", "left").join(b, "ident_2", "left").withColumn("all", total)
    return p.select("ident_1", "ident_2", F.coalesce("n1", F.lit(0.0)).alias("n1"), F.when(F.col("ident_2").isNull(), F.col("all") - F.coalesce("n1", F.lit(0.0))).otherwise(F.coalesce("m", F.lit(0.0))).alias("n2"))


def _counted(data: DataFrame, idents: DataFrame) -> DataFrame:
    """gene_id, value, ident, c: cells of each ident with that stored value; no comparison touches single cells again."""
    return data.join(idents, "cell_id").groupBy("gene_id", "value", "ident").agg(F.count(F.lit(1)).cast("double").alias("c"))


def _by_value(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """ident_1, ident_2, gene_id, value, c1, c2: cells of each of two named groups with that stored value."""
    both = pairs.select("ident_1", "ident_2", F.explode(F.array(F.struct(F.col("ident_1").alias("ident"), F.lit(True).alias("first")), F.struct(F.col("ident_2").alias("ident"), F.lit(False).alias("first")))).alias("x"))
    rows = counts.join(both.select("ident_1", "ident_2", "x.ident", "x.first"), "ident")
    part = lambda first: F.sum(F.when(F.col("first") == first, F.col("c")).otherwise(0.0))
    return rows.groupBy("ident_1", "ident_2", "gene_id", "value").agg(part(True).alias("c1"), part(False).alias("c2"))


_SUMS = ["r1", "tie", "p1", "p2", "x1", "x2", "xx1", "xx2"]


def _of_two(counts: DataFrame, sizes: DataFrame, every: DataFrame) -> DataFrame:
    """The sums of comparisons of two named groups."""
    stored = _by_value(counts, sizes.select("ident_1", "ident_2"))
    held = stored.groupBy(*_key()).agg(F.sum("c1").alias("s1"), F.sum("c2").alias("s2"))
    zeros = every.join(held, _key(), "left").select(*_key(), F.lit(0.0).alias("value"), (F.col("n1") - F.coalesce("s1", F.lit(0.0))).alias("c1"), (F.col("n2") - F.coalesce("s2", F.lit(0.0))).alias("c2"))
    values = stored.unionByName(zeros).groupBy(*_key(), "value").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2")).where(F.col("c1") + F.col("c2") > 0)
    t, v, c1, c2 = F.col("c1") + F.col("c2"), F.col("value"), F.col("c1"), F.col("c2")
    ranked = values.withColumn("mid", _mid(t, *_key()))
    positive = lambda c: F.sum(F.when(v > 0, c).otherwise(0.0))
    return ranked.groupBy(*_key()).agg(
        F.sum(c1 * F.col("mid")).alias("r1"), F.sum(t * (t * t - 1)).alias("tie"), positive(c1).alias("p1"), positive(c2).alias("p2"),
        F.sum(c1 * v).alias("x1"), F.sum(c2 * v).alias("x2"), F.sum(c1 * v * v).alias("xx1"), F.sum(c2 * v * v).alias("xx2"),
    )


def _of_rest(counts: DataFrame, every: DataFrame, n_cells: Column) -> DataFrame:
    """The sums of comparisons with all other cells: ranks and ties are those of all cells, the other side is all minus one's own.

    Work and rows are those of the counts, however many idents there are.
    """
    all_ = counts.groupBy("gene_id", "value").agg(F.sum("c").alias("t"))
    t, v, c = F.col("t"), F.col("value"), F.col("c")
    # the block of zeros joins the zeros that are stored
    rest = all_.groupBy("gene_id").agg(F.sum("t").alias("s")).select("gene_id", F.lit(0.0).alias("value"), (n_cells - F.col("s")).alias("t"))
    ranked = all_.unionByName(rest).groupBy("gene_id", "value").agg(F.sum("t").alias("t")).where(t > 0).withColumn("mid", _mid(t, "gene_id"))
    total = ranked.groupBy("gene_id").agg(
        F.sum(t * (t * t - 1)).alias("tie"), F.sum(F.when(v > 0, t).otherwise(0.0)).alias("p"), F.sum(t * v).alias("x"), F.sum(t * v * v).alias("xx"), F.coalesce(F.max(F.when(v == 0, F.col("mid"))), F.lit(0.0)).alias("mid0")
    )
    own = counts.join(ranked.select("gene_id", "value", "mid"), ["gene_id", "value"]).groupBy(F.col("ident").alias("ident_1"), "gene_id").agg(
        F.sum(c).alias("s1"), F.sum(c * F.col("mid")).alias("r1"), F.sum(F.when(v > 0, c).otherwise(0.0)).alias("p1"), F.sum(c * v).alias("x1"), F.sum(c * v * v).alias("xx1")
    )
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    # a gene that no cell has is one block of zeros
    n = F.col("n1") + F.col("n2")
    mid0, tie = F.coalesce("mid0", (n + 1) / 2), F.coalesce("tie", n * (n * n - 1))
    wide = every.join(own, ["ident_1", "gene_id"], "left").join(total, "gene_id", "left")
    return wide.select(
        *_key(), (zero("r1") + (F.col("n1") - zero("s1")) * mid0).alias("r1"), tie.alias("tie"), zero("p1").alias("p1"), (zero("p") - zero("p1")).alias("p2"),
        zero("x1").alias("x1"), (zero("x") - zero("x1")).alias("x2"), zero("xx1").alias("xx1"), F.greatest(F.lit(0.0), zero("xx") - zero("xx1")).alias("xx2"),
    )


def _mid(t: Column, *by: str) -> Column:
    """The mean rank of the t cells that share a value."""
    return F.coalesce(F.sum(t).over(Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + (t + 1) / 2


def _key() -> list:
    return ["ident_1", "ident_2", "gene_id"]


def marker_stats(data: DataFrame, idents: DataFrame, pairs: DataFrame, features: DataFrame, tests: tuple[str, ...] = TESTS) -> DataFrame:
    """One row for each comparison and gene: n1, n2, pct_1, pct_2, avg_log2FC, the statistics, and p of the tests asked for, unfiltered."""
    idents, pairs = idents.select("cell_id", "ident"), pairs.select("ident_1", "ident_2")
    sizes = group_sizes(idents, pairs)
    counts = _counted(data, idents)
    # one row for each gene and comparison: the result's own size
    every = features.select("gene_id").join(sizes)
    rest, named = F.col("ident_2").isNull(), F.col("ident_2").isNotNull()
    parts = []
    if not pairs.where(rest).isEmpty():
        n_cells = idents.where(F.col("ident").isNotNull()).select(F.count(F.lit(1)).cast("double")).scalar()
        parts.append(every.where(rest).join(_of_rest(counts, every.where(rest), n_cells).drop("ident_2"), ["ident_1", "gene_id"], "left"))
    if not parts or not pairs.where(named).isEmpty():
        parts.append(every.where(named).join(_of_two(counts, sizes.where(named), every.where(named)), _key(), "left"))
    s = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    s = s.na.fill(0.0, _SUMS)
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    some = (n1 > 0) & (n2 > 0)
    safe1, safe2, safe = F.greatest(n1, F.lit(1.0)), F.greatest(n2, F.lit(1.0)), F.greatest(n, F.lit(2.0))
    mean1, mean2 = F.col("x1") / safe1, F.col("x2") / safe2
    fold = (mean1 + PSEUDO) / F.when(mean2 + PSEUDO != 0, mean2 + PSEUDO).otherwise(1.0)
    s = s.withColumns({
        "pct_1": F.col("p1") / safe1, "pct_2": F.col("p2") / safe2, "mean_1": mean1, "mean_2": mean2,
        "avg_log2FC": F.when(some & (fold > 0), F.log2(F.when(fold > 0, fold).otherwise(1.0))).otherwise(0.0),
    })
    # rank sum, tie-corrected, without continuity correction
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.least(u1, n1 * n2 - u1)
    var_u = F.greatest(F.lit(1e-12), n1 * n2 / 12 * (n + 1 - F.col("tie") / (safe * (safe - 1))))
    s = s.withColumn("wilcox_z", F.when(some, (u - n1 * n2 / 2) / F.sqrt(var_u)).otherwise(0.0))
    # Welch's t with a normal tail
    var1 = F.greatest(F.lit(0.0), (F.col("xx1") - safe1 * F.col("mean_1") * F.col("mean_1")) / F.greatest(n1 - 1, F.lit(1.0)))
    var2 = F.greatest(F.lit(0.0), (F.col("xx2") - safe2 * F.col("mean_2") * F.col("mean_2")) / F.greatest(n2 - 1, F.lit(1.0)))
    se = F.sqrt(var1 / safe1 + var2 / safe2)
    s = s.withColumn("t_z", F.when((n1 >= 2) & (n2 >= 2) & (se >= 1e-12), (F.col("mean_1") - F.col("mean_2")) / F.greatest(se, F.lit(1e-12))).otherwise(0.0))
    # regression of the group on expression
    sx, sxx, sy = F.col("x1") + F.col("x2"), F.col("xx1") + F.col("xx2"), n1
    cxx = sxx - sx * sx / safe
    cxy = F.col("x1") - sx * sy / safe
    cyy = sy - sy * sy / safe
    slope = cxy / F.greatest(cxx, F.lit(1e-12))
    resid = F.greatest(F.lit(0.0), cyy - slope * cxy) / F.greatest(n - 2, F.lit(1.0))
    se_b = F.sqrt(resid / F.greatest(cxx, F.lit(1e-12)))
    s = s.withColumn("lr_z", F.when(some & (n >= 10) & (cxx >= 1e-12) & (se_b >= 1e-12), slope / F.greatest(se_b, F.lit(1e-12))).otherwise(0.0))
    for test in map(str.lower, tests):
        s = s.withColumn(f"{test}_p", F.least(F.lit(1.0), erfc(f"abs({test}_z) / sqrt(2.0D)")))
    return s


def benjamini_hochberg(rows: DataFrame, by: list[str], p: str = "p_val", tie: str = "gene_id") -> DataFrame:
    """p_val_adj within each group of `by`."""
    w = Window.partitionBy(*by).orderBy(p, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rows = rows.withColumn("_raw", F.least(F.lit(1.0), F.col(p) * n / F.row_number().over(w)))
    return rows.withColumn("p_val_adj", F.min("_raw").over(w.rowsBetween(0, Window.unboundedFollowing))).drop("_raw")


def markers(data: DataFrame, idents: DataFrame, pairs: DataFrame, features: DataFrame, test: str = "wilcox", logfc_threshold: float = 0.25, min_pct: float = 0.1) -> DataFrame:
    """ident_1, ident_2, gene_id, gene, p_val, avg_log2FC, pct_1, pct_2, p_val_adj: all genes; filtered ones have p 1."""
    if test not in TESTS:
        raise ValueError(f"unknown test {test!r}; one of {TESTS}")
    s = marker_stats(data, idents, pairs, features, (test,))
    rare = (F.col("pct_1") < min_pct) & (F.col("pct_2") < min_pct)
    fold = F.when(rare, 0.0).otherwise(F.col("avg_log2FC"))
    p = F.when(rare | (F.abs("avg_log2FC") < logfc_threshold), 1.0).otherwise(F.col(f"{test.lower()}_p"))
    rows = s.select("ident_1", "ident_2", "gene_id", p.alias("p_val"), fold.alias("avg_log2FC"), "pct_1", "pct_2")
    rows = benjamini_hochberg(rows, ["ident_1", "ident_2"])
    return rows.join(features.select("gene_id", "gene"), "gene_id").orderBy("ident_1", "p_val_adj", "gene_id")


def _known(idents: DataFrame, *names: str) -> None:
    for name in names:
        if not idents.where(F.col("ident") == name).limit(1).count():
            raise ValueError(f"unknown ident {name!r}")


def find_markers(data: DataFrame, idents: DataFrame, features: DataFrame, ident_1: str, ident_2: str | None = None, **options) -> DataFrame:
    _known(idents, *[x for x in (ident_1, ident_2) if x is not None])
    pairs = idents.sparkSession.createDataFrame([(ident_1, ident_2)], "ident_1 string, ident_2 string")
    return markers(data, idents, pairs, features, **options)


def find_all_markers(data: DataFrame, idents: DataFrame, features: DataFrame, **options) -> DataFrame:
    """Each ident against all other cells, in one job."""
    pairs = idents.select(F.col("ident").alias("ident_1")).distinct().withColumn("ident_2", F.lit(None).cast("string"))
    return markers(data, idents, pairs, features, **options)
