"""Slicing, transposition and products of coordinate-form matrices (cell_id, gene_id, value)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.assay import explode_ids


def dims(features: DataFrame, cells: DataFrame) -> DataFrame:
    n = features.agg(F.count(F.lit(1)).alias("n_genes"))
    return n.withColumn("n_cells", cells.select(F.count(F.lit(1))).scalar())


def slice_rows(coo: DataFrame, start: int, count: int) -> DataFrame:
    """Genes start..start+count-1; the bounds reach the scan."""
    return coo.where(F.col("gene_id").between(start, start + count - 1))


def slice_cols(coo: DataFrame, start: int, count: int) -> DataFrame:
    return coo.where(F.col("cell_id").between(start, start + count - 1))


def slice_ids(coo: DataFrame, genes: Iterable[int] | DataFrame | None = None, cells: Iterable[int] | DataFrame | None = None) -> DataFrame:
    """Any set of ids, contiguous or not; id lists given as DataFrames are semi-joined."""
    for column, ids in (("gene_id", genes), ("cell_id", cells)):
        if isinstance(ids, DataFrame):
            coo = coo.join(ids.select(column).distinct(), column, "left_semi")
        elif ids is not None:
            coo = coo.where(F.col(column).isin([int(i) for i in ids]))
    return coo


def dense_slice(coo: DataFrame, row_start: int, row_count: int, col_start: int, col_count: int) -> DataFrame:
    """Every entry of a rectangle, zeros included."""
    spark = coo.sparkSession
    cells = spark.range(col_start, col_start + col_count).select(F.col("id").alias("cell_id"))
    full = explode_ids(cells, "k", row_count).select("cell_id", (F.col("k") + row_start).cast("int").alias("gene_id"))
    part = slice_rows(slice_cols(coo, col_start, col_count), row_start, row_count)
    return full.join(part, ["cell_id", "gene_id"], "left").select("cell_id", "gene_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def transpose(coo: DataFrame) -> DataFrame:
    """Rows become columns: ids are swapped, lazily."""
    return coo.select(F.col("gene_id").cast("long").alias("cell_id"), F.col("cell_id").cast("int").alias("gene_id"), "value")


def matvec(coo: DataFrame, x: DataFrame) -> DataFrame:
    """A x for x(cell_id, x): gene_id, y."""
    return coo.join(x, "cell_id").groupBy("gene_id").agg(F.sum(F.col("value") * F.col("x")).alias("y"))


def rmatvec(coo: DataFrame, x: DataFrame) -> DataFrame:
    """A' x for x(gene_id, x): cell_id, y."""
    return coo.join(x, "gene_id").groupBy("cell_id").agg(F.sum(F.col("value") * F.col("x")).alias("y"))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """(genes x cells) times (cells x k) given as b(cell_id, k, value): gene_id, k, value.

    Entries go to their gene before they are multiplied out: a task that meets cells holds no sums, one that adds has whole genes.
    """
    rows = b.groupBy("cell_id").agg(F.collect_list(F.struct("k", F.col("value").alias("w"))).alias("row"))
    met = a.join(rows, "cell_id").select("gene_id", "value", "row").repartition("gene_id")
    pairs = met.select("gene_id", "value", F.inline("row"))
    return pairs.groupBy("gene_id", "k").agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def scaled_value(value: Column, mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, (value - mean) / sd).otherwise(F.lit(0.0))


def row_nnz_prefix(coo: DataFrame, features: DataFrame) -> DataFrame:
    """gene_id, nnz, row_ptr: entries of each row and of all rows before it (one row for each gene is ranked in one place)."""
    n = features.select("gene_id").join(coo.groupBy("gene_id").agg(F.count(F.lit(1)).alias("nnz")), "gene_id", "left").select("gene_id", F.coalesce("nnz", F.lit(0)).alias("nnz"))
    before = Window.orderBy("gene_id").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("row_ptr", F.coalesce(F.sum("nnz").over(before), F.lit(0)))


def col_nnz(coo: DataFrame, start: int | None = None, count: int | None = None) -> DataFrame:
    if start is not None:
        coo = slice_cols(coo, start, count or 0)
    return coo.groupBy("cell_id").agg(F.count(F.lit(1)).alias("nnz"))


def memory_estimate(coo: DataFrame, n_genes: int, n_cells: int, rows: int = 0, cols: int = 0) -> dict[str, float]:
    """Bytes of a chunk of `rows` genes or `cols` cells at the average fill (a value and an index for each entry)."""
    nnz = coo.count()
    return {"nnz": nnz, "row_chunk": 12.0 * nnz * rows / max(1, n_genes), "col_chunk": 12.0 * nnz * cols / max(1, n_cells)}


def to_dense(coo: DataFrame, n_genes: int, n_cells: int):
    """The whole matrix as numpy (genes x cells), for small ones."""
    import numpy as np

    out = np.zeros((n_genes, n_cells))
    t = coo.select("gene_id", "cell_id", "value").toArrow()
    np.add.at(out, (t["gene_id"].to_numpy(), t["cell_id"].to_numpy()), t["value"].to_numpy())
    return out


def from_dense(spark, matrix) -> DataFrame:
    """The non-zero entries of a numpy array (genes x cells)."""
    import numpy as np
    import pandas as pd

    g, c = np.nonzero(matrix)
    return spark.createDataFrame(pd.DataFrame({"cell_id": c.astype("int64"), "gene_id": g.astype("int32"), "value": np.asarray(matrix, float)[g, c]}), "cell_id long, gene_id int, value double")


def dense_matvec(rows: DataFrame, x: list[float]) -> DataFrame:
    """id, y for rows(id, vec): dot products with a vector."""
    other = F.array(*[F.lit(float(v)) for v in x])
    return rows.select("id", F.aggregate(F.zip_with("vec", other, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v).alias("y"))


def dense_rmatvec(rows: DataFrame, x: DataFrame) -> DataFrame:
    """pos, y for rows(id, vec) and x(id, x): sums of rows by weight."""
    return rows.join(x, "id").select("x", F.posexplode("vec").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("x") * F.col("v")).alias("y"))
