"""The test tables as matrices: F1 part x supplier, F2 brand and type x customer, F4 embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.assay import Assay


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def f1(spark: SparkSession, sf_dir: str) -> Assay:
    """Quantities by part (gene) and supplier (cell); ident and batch are the supplier's region."""
    counts = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").cast("int").alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    features = _t(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("gene_id"), F.col("p_name").alias("gene"))
    nation = F.broadcast(_t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))  # 25 rows by definition
    region = F.broadcast(_t(spark, sf_dir, "region").select("r_regionkey", "r_name"))  # 5 rows by definition
    cells = _t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    cells = cells.select(F.col("s_suppkey").alias("cell_id"), F.col("s_name").alias("cell"), F.col("r_name").alias("batch"), F.col("r_name").alias("ident"))
    return Assay(features, cells, {"counts": counts}, name="F1")


def f2(spark: SparkSession, sf_dir: str) -> Assay:
    """Quantities by brand and type (gene) and customer (cell); ident and batch are the market segment."""
    part = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", "p_type").alias("gene"))
    names = part.select("gene").distinct()
    features = names.select((F.row_number().over(_order("gene")) - 1).cast("int").alias("gene_id"), "gene")
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    coo = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey", "gene").agg(F.sum("l_quantity").alias("value")).join(features, "gene")
    cells = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_name").alias("cell"), F.col("c_mktsegment").alias("batch"), F.col("c_mktsegment").alias("ident"))
    return Assay(features, cells, {"counts": coo.select(F.col("o_custkey").alias("cell_id"), "gene_id", "value")}, name="F2")


def _order(*columns: str):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


def f4(spark: SparkSession, sf_dir: str) -> Assay:
    """The embeddings as a reduction; batch is the parity of the label, ident the label."""
    e = _t(spark, sf_dir, "embeddings")
    cells = e.select(F.col("vec_id").alias("cell_id"), F.col("vec_id").cast("string").alias("cell"), (F.col("label") % 2).cast("string").alias("batch"), F.col("label").cast("int").alias("cluster"))
    vec = e.select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return Assay(spark.createDataFrame([], "gene_id int, gene string"), cells, {}, {"embeddings": vec}, name="F4")


#: The same as common table expressions of DuckDB.
SQL_F1 = """f AS (SELECT CAST(p_partkey AS INTEGER) AS gene_id, p_name AS gene FROM part),
c AS (SELECT s_suppkey AS cell_id, r_name AS ident FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT l_suppkey AS cell_id, CAST(l_partkey AS INTEGER) AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
sf AS (SELECT c.cell_id, coalesce(sum(value), 0) AS size_factor FROM c LEFT JOIN x USING (cell_id) GROUP BY ALL),
gm AS (SELECT c.cell_id, coalesce(exp(avg(ln(value)) FILTER (WHERE value > 0)), 1) AS geo_mean FROM c LEFT JOIN x USING (cell_id) GROUP BY ALL),
ln_ AS (SELECT x.cell_id, x.gene_id, ln(1 + value * CASE WHEN size_factor > 0 THEN 10000.0 / size_factor ELSE 1 END) AS value FROM x JOIN sf USING (cell_id)),
nc AS (SELECT count(*) AS n_cells FROM c)"""
SQL_F2 = """f AS (SELECT CAST(row_number() OVER (ORDER BY gene) - 1 AS INTEGER) AS gene_id, gene FROM (SELECT DISTINCT p_brand || '|' || p_type AS gene FROM part)),
c AS (SELECT c_custkey AS cell_id, c_mktsegment AS ident FROM customer),
x AS (SELECT o_custkey AS cell_id, gene_id, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
      JOIN f ON f.gene = p_brand || '|' || p_type GROUP BY ALL),
sf AS (SELECT c.cell_id, coalesce(sum(value), 0) AS size_factor FROM c LEFT JOIN x USING (cell_id) GROUP BY ALL),
gm AS (SELECT c.cell_id, coalesce(exp(avg(ln(value)) FILTER (WHERE value > 0)), 1) AS geo_mean FROM c LEFT JOIN x USING (cell_id) GROUP BY ALL),
ln_ AS (SELECT x.cell_id, x.gene_id, ln(1 + value * CASE WHEN size_factor > 0 THEN 10000.0 / size_factor ELSE 1 END) AS value FROM x JOIN sf USING (cell_id)),
nc AS (SELECT count(*) AS n_cells FROM c)"""


def sql_moments(source: str) -> str:
    """gene_id, mean, variance over all cells of table source."""
    return f"""SELECT f.gene_id, coalesce(sum(value), 0) / any_value(n_cells) AS mean,
  greatest(0, (coalesce(var_pop(value), 0) * count(value) + count(value) * (any_value(n_cells) - count(value))::DOUBLE / any_value(n_cells) * power(coalesce(avg(value), 0), 2)) / (any_value(n_cells) - 1)) AS variance
  FROM f CROSS JOIN nc LEFT JOIN {source} v USING (gene_id) GROUP BY f.gene_id"""


SQL_VST = f"""m AS ({sql_moments("x")}),
valid AS (SELECT gene_id, log10(mean) AS lm, log10(variance) AS lv FROM m WHERE mean > 0 AND variance > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY lm, gene_id) AS rn, count(*) OVER () AS nv FROM valid),
binned AS (SELECT *, CAST((rn - 1) // greatest(1, nv // 20) AS INTEGER) AS bin FROM ranked),
inside AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY lv, gene_id) AS k, count(*) OVER (PARTITION BY bin) AS sz FROM binned WHERE bin < 20),
bins AS (SELECT bin, avg(lm) AS center, max(CASE WHEN k = sz // 2 + 1 THEN lv END) AS level FROM inside GROUP BY bin),
spans AS (SELECT *, lead(center) OVER (ORDER BY center, bin) AS center2, lead(level) OVER (ORDER BY center, bin) AS level2 FROM bins),
edge AS (SELECT min(center) AS c0, arg_min(level, center) AS l0, max(center) AS c1, arg_max(level, center) AS l1 FROM bins),
lmean AS (SELECT *, CASE WHEN mean > 0 THEN log10(mean) END AS lm FROM m),
mid AS (SELECT gene_id, arg_min(CASE WHEN center2 > center THEN level + (level2 - level) * (lm - center) / (center2 - center) ELSE level END, bin) AS mid
        FROM lmean JOIN spans ON lm BETWEEN center AND center2 GROUP BY gene_id),
trend AS (SELECT l.gene_id, mean, variance, CASE WHEN lm IS NULL OR c0 IS NULL THEN 0 WHEN lm <= c0 THEN l0 WHEN lm >= c1 THEN l1 ELSE coalesce(mid, 0) END AS fit
          FROM lmean l CROSS JOIN edge LEFT JOIN mid USING (gene_id)),
scores AS (SELECT gene_id, mean, variance, fit, CASE WHEN fit > 0 THEN (variance - power(10, fit)) / power(10, fit / 2) ELSE 0 END AS vst_variance FROM trend)"""
