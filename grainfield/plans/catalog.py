"""Named queries over the test tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.functions.mathx import erfc_sql, portable
from grainfield.operators import cluster, graph, integrate, markers, matrix, normalize, pca, variable
from grainfield.plans.fixtures import SQL_F1, SQL_F2, SQL_VST, f1, f2, f4, sql_moments
from grainfield.session import shared_folder
from grainfield.sources import export, readers, store
from grainfield.sources.readers import unique_names
from grainfield.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            # a rounded -0 as 0, as in the queries
            ORACLES[f.__name__] = re.sub(r", (\d)\) AS ", r", \1) + 0 AS ", sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounded, with -0 as 0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def _f1(sql: str) -> str:
    return f"WITH {SQL_F1} {sql}"


def _f2(sql: str) -> str:
    return f"WITH {SQL_F2} {sql}"


# ---- normalisation


@query(_f1("SELECT cell_id, size_factor FROM sf"))
def lib_size(spark, d):
    a = f1(spark, d)
    return normalize.library_size(a.layer("counts"), a.cells)


@query(_f1("SELECT cell_id, gene_id, round(value, 6) AS value FROM ln_"))
def log_normalize(spark, d):
    a = f1(spark, d)
    return rounded(normalize.log_normalize(a.layer("counts"), a.cells), "value")


@query(_f1("SELECT x.cell_id, gene_id, round(value * CASE WHEN size_factor > 0 THEN 10000.0 / size_factor ELSE 1 END, 6) AS value FROM x JOIN sf USING (cell_id)"))
def relative_counts(spark, d):
    a = f1(spark, d)
    return rounded(normalize.relative_counts(a.layer("counts"), a.cells), "value")


@query(_f1("SELECT cell_id, round(geo_mean, 6) AS geo_mean FROM gm"))
def geo_mean(spark, d):
    a = f1(spark, d)
    return rounded(normalize.geo_mean(a.layer("counts"), a.cells), "geo_mean")


@query(_f2("SELECT gm.cell_id, f.gene_id, round(ln((coalesce(value, 0) + 1) / geo_mean), 6) AS value FROM gm CROSS JOIN f LEFT JOIN x ON x.cell_id = gm.cell_id AND x.gene_id = f.gene_id WHERE ln((coalesce(value, 0) + 1) / geo_mean) <> 0"))
def clr(spark, d):
    a = f2(spark, d)
    return rounded(normalize.clr(a.layer("counts"), a.cells, a.n_genes), "value")


# ---- moments, variable features, scaling


@query(_f1(f"SELECT gene_id, round(mean, 6) AS mean, round(variance, 6) AS variance FROM ({sql_moments('x')})"))
def gene_moments_dense(spark, d):
    a = f1(spark, d)
    return rounded(variable.gene_moments(a.layer("counts"), a.features, a.n_cells), "mean", "variance")


@query(_f1("SELECT f.gene_id, round(coalesce(avg(value), 0), 6) AS mean, round(coalesce(var_samp(value), 0), 6) AS variance FROM f LEFT JOIN x USING (gene_id) GROUP BY f.gene_id"))
def gene_moments_nonzero(spark, d):
    a = f1(spark, d)
    return rounded(variable.gene_moments(a.layer("counts"), a.features, a.n_cells, nonzero_only=True), "mean", "variance")


def _moments(spark, d):
    a = f1(spark, d)
    return variable.gene_moments(a.layer("counts"), a.features, a.n_cells)


@query(_f1(f", {SQL_VST} SELECT bin, round(center, 6) AS center, round(level, 6) AS level FROM bins"))
def vst_bins(spark, d):
    return rounded(variable.vst_bins(_moments(spark, d)), "center", "level")


@query(_f1(f", {SQL_VST} SELECT gene_id, round(fit, 6) AS fit FROM trend"))
def vst_trend(spark, d):
    return rounded(variable.vst_trend(_moments(spark, d)).select("gene_id", "fit"), "fit")


@query(_f1(f", {SQL_VST} SELECT gene_id, round(vst_variance, 5) AS vst_variance FROM scores"))
def vst_scores(spark, d):
    return rounded(variable.vst_scores(_moments(spark, d)).select("gene_id", "vst_variance"), "vst_variance", digits=5)


@query(_f1(f", {SQL_VST} SELECT gene_id, round(vst_variance, 5) AS vst_variance FROM scores ORDER BY scores.vst_variance DESC, gene_id DESC LIMIT 500"))
def top_variable_features(spark, d):
    return rounded(variable.top_features(variable.vst_scores(_moments(spark, d)), 500), "vst_variance", digits=5)


def _data(a):
    return normalize.log_normalize(a.layer("counts"), a.cells)


@query(_f1(f"SELECT gene_id, round(mean, 6) AS residual_mean, round(sqrt(variance), 6) AS residual_sd FROM ({sql_moments('ln_')})"))
def scale_stats(spark, d):
    a = f1(spark, d)
    return rounded(variable.scale_stats(_data(a), a.features, a.n_cells), "residual_mean", "residual_sd")


@query(_f2(f", s AS ({sql_moments('ln_')}) SELECT c.cell_id, s.gene_id, round(CASE WHEN variance > 0 THEN (coalesce(value, 0) - mean) / sqrt(variance) ELSE 0 END, 5) AS value FROM c CROSS JOIN s LEFT JOIN ln_ ON ln_.cell_id = c.cell_id AND ln_.gene_id = s.gene_id"))
def scaled_matrix(spark, d):
    a = f2(spark, d)
    return rounded(variable.scaled_matrix(_data(a), a.features, a.cells, a.n_genes, a.n_cells), "value", digits=5)


# ---- matrix verbs


@query(_f1("SELECT (SELECT count(*) FROM f) AS n_genes, (SELECT count(*) FROM c) AS n_cells"))
def dims(spark, d):
    a = f1(spark, d)
    return matrix.dims(a.features, a.cells)


@query(_f1("SELECT * FROM x WHERE gene_id BETWEEN 10 AND 59"))
def slice_rows(spark, d):
    return matrix.slice_rows(f1(spark, d).layer("counts"), 10, 50)


@query(_f1("SELECT * FROM x WHERE cell_id BETWEEN 2 AND 6"))
def slice_cols(spark, d):
    return matrix.slice_cols(f1(spark, d).layer("counts"), 2, 5)


@query(_f1("SELECT * FROM x WHERE gene_id IN (1, 7, 8, 150) AND cell_id IN (0, 3, 9)"))
def slice_ids(spark, d):
    return matrix.slice_ids(f1(spark, d).layer("counts"), [1, 7, 8, 150], [0, 3, 9])


@query(_f1("SELECT c.cell_id, f.gene_id, coalesce(value, 0) AS value FROM c CROSS JOIN f LEFT JOIN x ON x.cell_id = c.cell_id AND x.gene_id = f.gene_id WHERE c.cell_id BETWEEN 0 AND 9 AND f.gene_id BETWEEN 20 AND 79"))
def dense_slice(spark, d):
    return matrix.dense_slice(f1(spark, d).layer("counts"), 20, 60, 0, 10)


@query(_f1("SELECT CAST(gene_id AS BIGINT) AS cell_id, CAST(cell_id AS INTEGER) AS gene_id, value FROM x"))
def transpose(spark, d):
    return matrix.transpose(f1(spark, d).layer("counts"))


@query(_f1("SELECT gene_id, sum(value * (cell_id % 7 + 1)) AS y FROM x GROUP BY gene_id"))
def matvec(spark, d):
    a = f1(spark, d)
    return matrix.matvec(a.layer("counts"), a.cells.select("cell_id", (F.col("cell_id") % 7 + 1).cast("double").alias("x")))


@query(_f1("SELECT cell_id, sum(value * (gene_id % 5 + 1)) AS y FROM x GROUP BY cell_id"))
def rmatvec(spark, d):
    a = f1(spark, d)
    return matrix.rmatvec(a.layer("counts"), a.features.select("gene_id", (F.col("gene_id") % 5 + 1).cast("double").alias("x")))


@query(_f1(", b AS (SELECT cell_id, CAST(k AS INTEGER) AS k, CAST((cell_id * (k + 1)) % 11 AS DOUBLE) AS w FROM c, range(4) r(k)) SELECT gene_id, k, sum(value * w) AS value FROM x JOIN b USING (cell_id) GROUP BY gene_id, k"))
def matmul(spark, d):
    a = f1(spark, d)
    b = a.cells.select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).withColumn("value", ((F.col("cell_id") * (F.col("k") + 1)) % 11).cast("double"))
    return matrix.matmul(a.layer("counts"), b)


@query("SELECT vec_id AS id, round(list_dot_product(embedding::DOUBLE[], list_transform(range(len(embedding)), lambda i: (i % 3 + 1)::DOUBLE)), 6) AS y FROM embeddings")
def dense_matvec(spark, d):
    e = f4(spark, d).table("embeddings").select(F.col("cell_id").alias("id"), "vec")
    dim = len(e.first()["vec"])
    return rounded(matrix.dense_matvec(e, [i % 3 + 1 for i in range(dim)]), "y")


@query("SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding)::DOUBLE * (vec_id % 4) AS v FROM embeddings".join(("SELECT pos, round(sum(v), 6) AS y FROM (", ") GROUP BY pos")))
def dense_rmatvec(spark, d):
    e = f4(spark, d).table("embeddings").select(F.col("cell_id").alias("id"), "vec")
    return rounded(matrix.dense_rmatvec(e, e.select("id", (F.col("id") % 4).cast("double").alias("x"))), "y")


@query(_f1(", n AS (SELECT f.gene_id, count(value) AS nnz FROM f LEFT JOIN x USING (gene_id) GROUP BY f.gene_id) SELECT gene_id, nnz, CAST(coalesce(sum(nnz) OVER (ORDER BY gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_ptr FROM n"))
def row_nnz_prefix(spark, d):
    a = f1(spark, d)
    return matrix.row_nnz_prefix(a.layer("counts"), a.features)


@query(_f1("SELECT cell_id, count(*) AS nnz FROM x GROUP BY cell_id"))
def col_nnz(spark, d):
    return matrix.col_nnz(f1(spark, d).layer("counts"))


@query("SELECT CAST(p_partkey AS INTEGER) AS gene_id, CASE WHEN k = 1 THEN p_name ELSE p_name || '.' || (k - 1) END AS gene FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def unique_gene_names(spark, d):
    return unique_names(f1(spark, d).features)


# ---- markers

_FIRST = "'BUILDING'"


def _markers_sql(final: str, first: str | None = _FIRST) -> str:
    """All comparisons of ident against the rest, from (gene, value) counts with one block of zeros."""
    z = lambda name: portable(erfc_sql(f"(abs({name}) / sqrt(2.0))"))
    return _f2(f""",
i1 AS (SELECT ident AS ident_1, count(*)::DOUBLE AS n1, (SELECT count(*) FROM c)::DOUBLE - count(*) AS n2 FROM c {f"WHERE ident = {first}" if first else ""} GROUP BY ident),
raw AS (SELECT gene_id, round(value, 9) AS value, ident, count(*)::DOUBLE AS k FROM ln_ JOIN c USING (cell_id) GROUP BY ALL),
st AS (SELECT ident_1, gene_id, value, sum(CASE WHEN ident = ident_1 THEN k ELSE 0 END) AS c1, sum(CASE WHEN ident <> ident_1 THEN k ELSE 0 END) AS c2 FROM raw CROSS JOIN i1 GROUP BY ALL),
every_ AS (SELECT ident_1, n1, n2, gene_id FROM i1 CROSS JOIN f),
zero AS (SELECT e.ident_1, e.gene_id, 0.0::DOUBLE AS value, any_value(n1) - coalesce(sum(c1), 0) AS c1, any_value(n2) - coalesce(sum(c2), 0) AS c2 FROM every_ e LEFT JOIN st USING (ident_1, gene_id) GROUP BY ALL),
vals AS (SELECT ident_1, gene_id, value, sum(c1) AS c1, sum(c2) AS c2 FROM (SELECT * FROM st UNION ALL SELECT * FROM zero) GROUP BY ALL HAVING sum(c1) + sum(c2) > 0),
mids AS (SELECT *, coalesce(sum(c1 + c2) OVER (PARTITION BY ident_1, gene_id ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c1 + c2 + 1) / 2 AS mid FROM vals),
agg AS (SELECT ident_1, gene_id, sum(c1 * mid) AS r1, sum((c1 + c2) * ((c1 + c2) * (c1 + c2) - 1)) AS tie, sum(CASE WHEN value > 0 THEN c1 ELSE 0 END) AS p1, sum(CASE WHEN value > 0 THEN c2 ELSE 0 END) AS p2,
  sum(c1 * value) AS x1, sum(c2 * value) AS x2, sum(c1 * value * value) AS xx1, sum(c2 * value * value) AS xx2 FROM mids GROUP BY ALL),
s0 AS (SELECT e.*, a.* EXCLUDE (ident_1, gene_id), n1 + n2 AS n, p1 / n1 AS pct_1, p2 / n2 AS pct_2, x1 / n1 AS m1, x2 / n2 AS m2 FROM every_ e JOIN agg a USING (ident_1, gene_id)),
s1 AS (SELECT *, log2((m1 + 1e-9) / (m2 + 1e-9)) AS fc, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u,
  greatest(0, (xx1 - n1 * m1 * m1) / (n1 - 1)) AS v1, greatest(0, (xx2 - n2 * m2 * m2) / (n2 - 1)) AS v2,
  xx1 + xx2 - (x1 + x2) * (x1 + x2) / n AS cxx, x1 - (x1 + x2) * n1 / n AS cxy, n1 - n1 * n1 / n AS cyy FROM s0),
s2 AS (SELECT *, (u - n1 * n2 / 2) / sqrt(greatest(1e-12, n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1))))) AS wilcox_z,
  CASE WHEN sqrt(v1 / n1 + v2 / n2) >= 1e-12 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) ELSE 0 END AS t_z,
  CASE WHEN cxx >= 1e-12 AND sqrt(greatest(0, cyy - cxy / cxx * cxy) / (n - 2) / cxx) >= 1e-12 THEN cxy / cxx / sqrt(greatest(0, cyy - cxy / cxx * cxy) / (n - 2) / cxx) ELSE 0 END AS lr_z FROM s1),
s3 AS (SELECT *, least(1, {z("wilcox_z")}) AS wilcox_p, least(1, {z("t_z")}) AS t_p, least(1, {z("lr_z")}) AS lr_p FROM s2),
res AS (SELECT ident_1, gene_id, CASE WHEN (pct_1 < 0.1 AND pct_2 < 0.1) OR abs(fc) < 0.25 THEN 1 ELSE wilcox_p END AS p_val, CASE WHEN pct_1 < 0.1 AND pct_2 < 0.1 THEN 0 ELSE fc END AS avg_log2FC, pct_1, pct_2 FROM s3),
adj AS (SELECT *, min(least(1, p_val * cnt / rn)) OVER (PARTITION BY ident_1 ORDER BY p_val, gene_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p_val_adj
  FROM (SELECT *, count(*) OVER (PARTITION BY ident_1) AS cnt, row_number() OVER (PARTITION BY ident_1 ORDER BY p_val, gene_id) AS rn FROM res))
{final}""")


def _steady(a):
    """Log-normalised values to 9 digits: equal shares are ties in any engine, whatever the last bit of its logarithm."""
    return _data(a).withColumn("value", F.round("value", 9))


def _stats(spark, d):
    a = f2(spark, d)
    pairs = spark.createDataFrame([("BUILDING", None)], "ident_1 string, ident_2 string")
    return markers.marker_stats(_steady(a), a.cells, pairs, a.features)


@query(_markers_sql("SELECT gene_id, round(pct_1, 6) AS pct_1, round(pct_2, 6) AS pct_2, round(fc, 6) AS avg_log2FC FROM s3"))
def marker_pct_fc(spark, d):
    return rounded(_stats(spark, d).select("gene_id", "pct_1", "pct_2", "avg_log2FC"), "pct_1", "pct_2", "avg_log2FC")


@query(_markers_sql("SELECT gene_id, r1, tie, round(wilcox_z, 6) AS wilcox_z, round(wilcox_p, 6) AS wilcox_p FROM s3"))
def marker_wilcoxon(spark, d):
    return rounded(_stats(spark, d).select("gene_id", "r1", "tie", "wilcox_z", "wilcox_p"), "wilcox_z", "wilcox_p")


@query(_markers_sql("SELECT gene_id, round(t_z, 6) AS t_z, round(t_p, 6) AS t_p FROM s3"))
def marker_ttest(spark, d):
    return rounded(_stats(spark, d).select("gene_id", "t_z", "t_p"), "t_z", "t_p")


@query(_markers_sql("SELECT gene_id, round(lr_z, 6) AS lr_z, round(lr_p, 6) AS lr_p FROM s3"))
def marker_lr(spark, d):
    return rounded(_stats(spark, d).select("gene_id", "lr_z", "lr_p"), "lr_z", "lr_p")


@query(_markers_sql("SELECT gene_id, round(min(least(1, wilcox_p * cnt / rn)) OVER (ORDER BY wilcox_p, gene_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS p_val_adj FROM (SELECT *, count(*) OVER () AS cnt, row_number() OVER (ORDER BY wilcox_p, gene_id) AS rn FROM s3)"))
def marker_bh(spark, d):
    rows = _stats(spark, d).select("ident_1", "gene_id", F.col("wilcox_p").alias("p_val"))
    return rounded(markers.benjamini_hochberg(rows, ["ident_1"]).select("gene_id", "p_val_adj"), "p_val_adj")


_MARKER_COLUMNS = "ident_1, gene, round(p_val, 6) AS p_val, round(avg_log2FC, 6) AS avg_log2FC, round(pct_1, 6) AS pct_1, round(pct_2, 6) AS pct_2, round(p_val_adj, 6) AS p_val_adj FROM adj JOIN f USING (gene_id)"


def _marker_rows(df: DataFrame) -> DataFrame:
    return rounded(df.select("ident_1", "gene", "p_val", "avg_log2FC", "pct_1", "pct_2", "p_val_adj"), "p_val", "avg_log2FC", "pct_1", "pct_2", "p_val_adj")


@query(_markers_sql(f"SELECT {_MARKER_COLUMNS}"))
def find_markers(spark, d):
    a = f2(spark, d)
    return _marker_rows(markers.find_markers(_steady(a), a.cells, a.features, "BUILDING"))


@query(_markers_sql(f"SELECT {_MARKER_COLUMNS}", None))
def find_all_markers(spark, d):
    a = f2(spark, d)
    return _marker_rows(markers.find_all_markers(_steady(a), a.cells, a.features))


# ---- neighbours, clusters

_KNN = """d AS (SELECT a.vec_id AS cell_id, b.vec_id AS nbr_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: power(p[1]::DOUBLE - p[2]::DOUBLE, 2)))) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY dist, nbr_id) AS INTEGER) AS rank FROM d) WHERE rank < 20),
knn AS (SELECT cell_id, rank, nbr_id, dist FROM k UNION ALL SELECT vec_id, 0, vec_id, 0 FROM embeddings),
half AS (SELECT a.cell_id AS src, b.cell_id AS dst, count(*) / (40.0::DOUBLE - count(*)) AS weight FROM knn a JOIN knn b ON a.nbr_id = b.nbr_id AND a.cell_id < b.cell_id GROUP BY ALL HAVING count(*) / (40.0::DOUBLE - count(*)) > 1.0::DOUBLE / 15),
snn AS (SELECT * FROM half UNION ALL SELECT dst, src, weight FROM half)"""


@query(f"WITH {_KNN} SELECT cell_id, rank, nbr_id, round(dist, 6) AS dist FROM k")
def knn_exact(spark, d):
    return rounded(graph.knn(f4(spark, d).table("embeddings")).where(F.col("rank") > 0), "dist")


@query(f"WITH {_KNN} SELECT cell_id, rank, nbr_id, round(dist, 6) AS dist FROM knn")
def knn_self(spark, d):
    return rounded(graph.knn(f4(spark, d).table("embeddings")), "dist")


@query()
def knn_approx(spark, d):
    return rounded(graph.approximate_knn(f4(spark, d).table("embeddings")), "dist")


def _snn(a):
    return graph.snn(graph.knn(a.table("embeddings")))


@query(f"WITH {_KNN} SELECT src, dst, round(weight, 6) AS weight FROM snn")
def snn_edges(spark, d):
    return rounded(_snn(f4(spark, d)), "weight")


@query(f"""WITH {_KNN}, e AS (SELECT a.label AS cs, b.label AS cd, weight FROM snn JOIN embeddings a ON src = a.vec_id JOIN embeddings b ON dst = b.vec_id),
per AS (SELECT cs, sum(CASE WHEN cs = cd THEN weight ELSE 0 END) AS inside, sum(weight) AS tot FROM e GROUP BY cs), m AS (SELECT sum(tot) AS m FROM per)
SELECT round(sum(inside / (2 * m) - power(tot / (2 * m), 2)), 6) AS modularity, round(sum(inside / m - power(tot / m, 2)), 6) AS standard_modularity FROM per CROSS JOIN m""")
def modularity(spark, d):
    a = f4(spark, d)
    return rounded(cluster.modularity(_snn(a), a.cells), "modularity", "standard_modularity")


@query("SELECT vec_id AS cell_id, CAST(rank AS INTEGER) AS cluster FROM embeddings JOIN (SELECT label, row_number() OVER (ORDER BY count(*) DESC, min(vec_id)) - 1 AS rank FROM embeddings GROUP BY label) USING (label)")
def cluster_renumber(spark, d):
    return cluster.renumber(f4(spark, d).cells.select("cell_id", "cluster"))


@query()
def louvain(spark, d):
    a = f4(spark, d)
    return cluster.find_clusters(cluster._cut(_snn(a)), a.cells, "louvain")


@query()
def leiden(spark, d):
    a = f4(spark, d)
    return cluster.find_clusters(cluster._cut(_snn(a)), a.cells, "leiden")


# ---- principal components


def _gram_sql(scale: bool) -> str:
    cov = "(coalesce(s, 0) - n_cells * a.mean * b.mean) / (n_cells - 1)"
    value = f"CASE WHEN a.variance > 0 AND b.variance > 0 THEN {cov} / sqrt(a.variance) / sqrt(b.variance) ELSE 0 END" if scale else cov
    return _f2(f""", m AS ({sql_moments("ln_")}), p AS (SELECT a.gene_id AS i, b.gene_id AS j, sum(a.value * b.value) AS s FROM ln_ a JOIN ln_ b ON a.cell_id = b.cell_id AND a.gene_id <= b.gene_id GROUP BY ALL)
SELECT a.gene_id AS i, b.gene_id AS j, round({value}, 5) AS value FROM m a JOIN m b ON a.gene_id <= b.gene_id CROSS JOIN nc LEFT JOIN p ON p.i = a.gene_id AND p.j = b.gene_id""")


@query(_gram_sql(False))
def gram_centered(spark, d):
    a = f2(spark, d)
    return rounded(pca.gram(_data(a), a.features, a.n_cells), "value", digits=5)


@query(_gram_sql(True))
def gram_scaled(spark, d):
    a = f2(spark, d)
    return rounded(pca.gram(_data(a), a.features, a.n_cells, scale=True), "value", digits=5)


@query()
def pca_stdev(spark, d):
    a = f2(spark, d)
    return rounded(pca.run_pca(_data(a), a.features, a.cells, 20)["stdev"], "stdev")


@query()
def pca_embeddings(spark, d):
    a = f2(spark, d)
    return pca.run_pca(_data(a), a.features, a.cells, 20)["embeddings"]


@query(_f2(""", m AS (%s), k AS (SELECT gene_id, row_number() OVER (ORDER BY gene_id) AS r FROM f), n AS (SELECT least((SELECT count(*) FROM f), (SELECT n_cells FROM nc)) AS n)
SELECT CAST(a.r - 1 AS INTEGER) AS a, CAST(b.r - 1 AS INTEGER) AS b, CASE WHEN a.r = b.r THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dot FROM k a JOIN k b ON a.r <= b.r CROSS JOIN n WHERE b.r <= n""" % sql_moments("ln_")))
def pca_loadings_orthonormal(spark, d):
    """Products of all pairs of loading vectors."""
    a = f2(spark, d)
    rows = _full_pca(a)["loadings"].select("gene_id", F.posexplode("vec").alias("a", "x"))
    other = rows.select("gene_id", F.col("a").alias("b"), F.col("x").alias("y"))
    return rounded(rows.join(other, "gene_id").where(F.col("a") <= F.col("b")).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot")), "dot")


@query(_gram_sql(False))
def pca_covariance(spark, d):
    """The covariance put together again from all loadings and standard deviations."""
    found = _full_pca(f2(spark, d))
    rows = found["loadings"].select("gene_id", F.posexplode("vec").alias("k", "x")).join(found["stdev"].select((F.col("pc") - 1).alias("k"), "stdev"), "k")
    other = rows.select(F.col("gene_id").alias("j"), "k", F.col("x").alias("y"))
    pairs = rows.select(F.col("gene_id").alias("i"), "k", "x", "stdev").join(other, "k").where(F.col("i") <= F.col("j"))
    return rounded(pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y") * F.col("stdev") * F.col("stdev")).alias("value")), "value", digits=5)


@query(_f2(f", m AS ({sql_moments('ln_')}) SELECT c.cell_id, round(sum(power(coalesce(value, 0) - mean, 2)), 5) AS norm2 FROM c CROSS JOIN m LEFT JOIN ln_ ON ln_.cell_id = c.cell_id AND ln_.gene_id = m.gene_id GROUP BY ALL"))
def pca_cell_norms(spark, d):
    """Squared lengths of all scores: those of the centred cells, if the scores lose nothing."""
    found = _full_pca(f2(spark, d))["embeddings"]
    return rounded(found.select("cell_id", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x).alias("norm2")), "norm2", digits=5)


def _full_pca(a) -> dict[str, DataFrame]:
    return pca.run_pca(_data(a), a.features, a.cells, a.n_genes)


# ---- integration


def _batches(a):
    rows = a.table("embeddings").join(a.cells.select("cell_id", "batch"), "cell_id").select(F.col("cell_id").alias("id"), F.slice("vec", 1, 30).alias("vec"), "batch")
    ref = integrate.reference_batch(a.cells).first()["batch"]
    return rows.where(F.col("batch") == ref).select("id", "vec"), rows.where(F.col("batch") != ref).select("id", "vec")


_REF = "ref AS (SELECT label % 2 AS b FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, CAST(label % 2 AS VARCHAR) LIMIT 1)"
_MNN = f"""{_REF}, v AS (SELECT vec_id AS id, list_transform(embedding[1:30], lambda x: x::DOUBLE) AS vec, label % 2 = b AS is_ref FROM embeddings CROSS JOIN ref),
dd AS (SELECT r.id AS ref_id, q.id AS query_id, sqrt(list_sum(list_transform(list_zip(r.vec, q.vec), lambda p: power(p[1] - p[2], 2)))) AS dist FROM v r JOIN v q ON r.is_ref AND NOT q.is_ref),
pairs AS (SELECT ref_id, query_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS a, row_number() OVER (PARTITION BY ref_id ORDER BY dist, query_id) AS b FROM dd) WHERE a <= 20 AND b <= 20)"""


@query("SELECT CAST(label % 2 AS VARCHAR) AS batch, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY n DESC, batch LIMIT 1")
def reference_batch(spark, d):
    return integrate.reference_batch(f4(spark, d).cells)


@query(f"WITH {_MNN} SELECT ref_id, query_id FROM pairs")
def mnn_pairs(spark, d):
    return integrate.mnn_pairs(*_batches(f4(spark, d)))


@query(f"""WITH {_MNN}, u AS (SELECT query_id AS id, unnest(list_zip(r.vec, q.vec)) AS z, generate_subscripts(r.vec, 1) - 1 AS pos FROM pairs JOIN v r ON r.id = ref_id JOIN v q ON q.id = query_id)
SELECT id, CAST(pos AS INTEGER) AS pos, round(avg(z[1] - z[2]), 6) AS correction FROM u GROUP BY ALL""")
def mnn_raw_correction(spark, d):
    ref, query_ = _batches(f4(spark, d))
    raw = integrate.raw_correction(integrate.mnn_pairs(ref, query_), ref, query_)
    return rounded(raw.select("id", F.posexplode("vec").alias("pos", "correction")), "correction")


def _round_sql(i: int) -> str:
    """One round of correction: pairs, raw corrections, kernel-weighted means and the moved vectors v<i>, from v<i - 1>."""
    apart = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: power(p[1] - p[2], 2)))"
    return f"""
dd{i} AS (SELECT a.id AS ref_id, b.id AS query_id, sqrt({apart}) AS dist FROM v{i - 1} a JOIN v{i - 1} b ON a.is_ref AND NOT b.is_ref),
pairs{i} AS (SELECT ref_id, query_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, ref_id) AS x, row_number() OVER (PARTITION BY ref_id ORDER BY dist, query_id) AS y FROM dd{i}) WHERE x <= 20 AND y <= 20),
u{i} AS (SELECT query_id AS id, unnest(list_zip(r.vec, q.vec)) AS z, generate_subscripts(r.vec, 1) AS pos FROM pairs{i} JOIN v{i - 1} r ON r.id = ref_id JOIN v{i - 1} q ON q.id = query_id),
c{i} AS (SELECT id, list(c ORDER BY pos) AS c FROM (SELECT id, pos, avg(z[1] - z[2]) AS c FROM u{i} GROUP BY ALL) GROUP BY id HAVING max(abs(c)) > 0),
n{i} AS (SELECT 0.1::DOUBLE * sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n FROM v{i - 1} WHERE NOT is_ref ORDER BY id LIMIT 1),
k{i} AS (SELECT a.id, c.c, exp(-{apart} / (2 * power(CASE WHEN n >= 1e-6 THEN n ELSE 1 END, 2))) AS k FROM v{i - 1} a JOIN c{i} c ON NOT a.is_ref JOIN v{i - 1} b ON b.id = c.id CROSS JOIN n{i}),
w{i} AS (SELECT id, sum(k) AS w FROM k{i} GROUP BY id),
x{i} AS (SELECT id, generate_subscripts(c, 1) AS pos, unnest(c) * k AS t FROM k{i}),
m{i} AS (SELECT id, pos, CASE WHEN any_value(w) > 1e-10 THEN sum(t) / any_value(w) ELSE 0 END AS m FROM x{i} JOIN w{i} USING (id) GROUP BY id, pos),
l{i} AS (SELECT id, list(m ORDER BY pos) AS m FROM m{i} GROUP BY id),
v{i} AS (SELECT v.id, CASE WHEN m IS NULL THEN vec ELSE list_transform(list_zip(vec, m), lambda p: p[1] + p[2]) END AS vec, is_ref FROM v{i - 1} v LEFT JOIN l{i} USING (id))"""


_V0 = f"{_REF}, v0 AS (SELECT vec_id AS id, list_transform(embedding[1:30], lambda x: x::DOUBLE) AS vec, label % 2 = b AS is_ref FROM embeddings CROSS JOIN ref)"


@query(f"WITH {_V0}, {_round_sql(1)} SELECT id, CAST(pos - 1 AS INTEGER) AS pos, round(m, 6) AS correction FROM m1")
def mnn_smoothed(spark, d):
    ref, query_ = _batches(f4(spark, d))
    raw = integrate.raw_correction(integrate.mnn_pairs(ref, query_), ref, query_)
    return rounded(integrate.smoothed_correction(query_, raw).select("id", F.posexplode("vec").alias("pos", "correction")), "correction")


@query(f"WITH {_V0}, {_round_sql(1)}, {_round_sql(2)} SELECT cell_id, pos, round(v, 5) AS v FROM (SELECT id AS cell_id, CAST(generate_subscripts(vec, 1) - 1 AS INTEGER) AS pos, unnest(vec) AS v FROM v2)")
def integrated(spark, d):
    a = f4(spark, d)
    return rounded(integrate.integrate(a.table("embeddings"), a.cells).select("cell_id", F.posexplode("vec").alias("pos", "v")), "v", digits=5)


# ---- sources and the store: written to the shared folder, read again, compared with the source


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(_f1("SELECT cell_id, gene_id, value FROM x"))
def mtx_directory(spark, d):
    """F1 as a MatrixMarket directory (1-based), loaded."""
    a, at = f1(spark, d), _folder(spark, "mtx")
    size = a.layer("counts").agg(F.max("gene_id").alias("g"), F.max("cell_id").alias("c"), F.count(F.lit(1)).alias("n")).first()
    export.write_mtx(a.layer("counts"), at, size["g"] + 1, size["c"] + 1, size["n"])
    return rounded(readers.load(spark, at).layer("counts"), "value")


@query("SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS gene_id, CASE WHEN k = 1 THEN p_name ELSE p_name || '.' || (k - 1) END AS gene FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)")
def mtx_features(spark, d):
    """The feature names of a MatrixMarket directory, made unique."""
    a, at = f1(spark, d), _folder(spark, "mtx")
    export.write_mtx(a.layer("counts").limit(0), at, a.n_genes, a.n_cells)
    export.write_names(a.features.select("gene_id", F.col("gene").alias("name")), f"{at}/features.tsv", "gene_id")
    return readers.load(spark, at).features


@query(_f1("SELECT cell_id, gene_id, round(value, 6) AS value FROM ln_"))
def store_layers(spark, d):
    """Counts stored, opened, normalised, stored as a layer and opened again."""
    at = _folder(spark, "store")
    store.write_assay(f1(spark, d), at)
    a = normalize.normalize_data(store.read_assay(spark, at, "F1"))
    store.write_table(a.layer("data"), f"{store.root(at, 'F1')}/layers/data", sort=["cell_id", "gene_id"])
    return rounded(readers.load(spark, store.read_assay(spark, at, "F1")).layer("data"), "value")


@query("SELECT vec_id AS cell_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings")
def store_tables(spark, d):
    """A dense table of vectors stored and opened."""
    at = _folder(spark, "store")
    a = f4(spark, d)
    a.layers["counts"] = spark.createDataFrame([(0, 0, 1.0)], "cell_id long, gene_id int, value double")
    store.write_assay(a, at)
    return store.read_assay(spark, at, "F4").table("embeddings").select("cell_id", F.posexplode("vec").alias("pos", "v"))


@query(_f1("SELECT c.cell_id, coalesce(s, 0) AS size_factor FROM c LEFT JOIN (SELECT cell_id, sum(value) AS s FROM x GROUP BY 1) USING (cell_id)"))
def appended_columns(spark, d):
    """Columns that arrive in two batches, appended to a stored layer: the library sizes of all."""
    at = _folder(spark, "store")
    a = f1(spark, d)
    for part in (0, 1):
        cells = a.cells.where(F.col("cell_id") % 2 == part)
        incremental.append_columns(a.layer("counts").join(cells.select("cell_id"), "cell_id", "left_semi"), cells, a.features, at, "F1", part)
    found = store.read_assay(spark, at, "F1")
    return normalize.library_size(found.layer("counts"), found.cells)
