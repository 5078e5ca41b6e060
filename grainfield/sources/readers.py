"""Readers: MatrixMarket directories, DataFrames, in-memory arrays, named layers, stored assays."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainfield.assay import Assay
from grainfield.functions.rank import positions
from grainfield.sources import store

LAYER_PREFIXES = ("counts", "data", "scale.data")


def unique_names(features: DataFrame) -> DataFrame:
    """gene_id, gene: the first of equal names keeps it, later ones get .1, .2, ...; names that exist already are skipped."""
    numbered = features.withColumn("_k", F.row_number().over(Window.partitionBy("gene").orderBy("gene_id")) - 1)
    taken = features.select(F.col("gene").alias("_taken")).distinct()
    # what a name's suffixes may not be: `name.<number>` that occurs as a name of its own
    stem = F.regexp_extract("_taken", r"^(.*)\.([1-9]\d*)$", 1)
    used = taken.select(stem.alias("gene"), F.regexp_extract("_taken", r"^(.*)\.([1-9]\d*)$", 2).alias("_n")).where(F.length("_n").between(1, 9))
    used = used.groupBy("gene").agg(F.sort_array(F.collect_set(F.col("_n").cast("int"))).alias("_used"))
    joined = numbered.join(used, "gene", "left")
    # the k-th free number: raised by one for each used number at or below it, in rising order
    free = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), F.col("_k").cast("int"), lambda a, u: F.when(u <= a, a + 1).otherwise(a))
    name = F.when(F.col("_k") == 0, F.col("gene")).otherwise(F.concat("gene", F.lit("."), free.cast("string")))
    return joined.select("gene_id", name.alias("gene"))


def _present(spark: SparkSession, path: str) -> str | None:
    """path or path.gz, whichever there is."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for p in (path, f"{path}.gz"):
        at = hadoop(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return p
    return None


def mtx_header(spark: SparkSession, path: str) -> dict:
    """pattern, integer, rows, cols, nnz of a MatrixMarket file; blank lines and comments before the size line are skipped."""
    lines = spark.read.text(path)
    text = F.trim(F.regexp_replace("value", r"\s+", " "))
    banner = [r["value"].lower() for r in lines.limit(1).collect() if r["value"].lower().startswith("%%matrixmarket")]
    kind = {k: bool(banner) and k in banner[0] for k in ("pattern", "integer")}
    # the first line, in the file's order, that is no comment: however many stand before it
    found = lines.select(text.alias("s")).where((F.col("s") != "") & ~F.col("s").startswith("%")).limit(1).collect()
    if not found:
        raise ValueError(f"no size line in {path}")
    parts = found[0]["s"].split()
    if len(parts) != 3 or not all(re.fullmatch(r"\d+", p) for p in parts):
        raise ValueError(f"bad size line in {path}: {found[0]['s']!r}")
    return kind | dict(zip(("rows", "cols", "nnz"), map(int, parts), strict=True))


def read_mtx(spark: SparkSession, path: str, validate: bool = True) -> tuple[DataFrame, dict]:
    """Entries (0-based, repeated ones summed) and header. Order of entries does not matter."""
    header = mtx_header(spark, path)
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\s+", " ")).alias("s")).where((F.col("s") != "") & ~F.col("s").startswith("%"))
    size = f"{header['rows']} {header['cols']} {header['nnz']}"
    parts = F.split("s", " ")
    number = lambda i, kind: F.try_element_at(parts, F.lit(i)).try_cast(kind)
    value = F.lit(1.0) if header["pattern"] else F.coalesce(number(3, "double"), F.lit(0.0))
    rows = lines.select("s", number(1, "long").alias("r"), number(2, "long").alias("c"), value.alias("value"))
    # the size line is the first: its text may come again as an entry, so one row of that text is taken off by count
    outside = F.col("r").isNull() | F.col("c").isNull() | (F.col("r") < 1) | (F.col("c") < 1) | (F.col("r") > header["rows"]) | (F.col("c") > header["cols"])
    bad = F.min(F.when((F.col("s") != size) & outside, F.col("s"))) if validate else F.lit(None)
    # one pass: to look for the first bad line would read a good file a few parts at a time
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("s") == size).alias("same"), bad.alias("bad")).first()
    n, same = seen["n"] - 1, seen["same"]
    if seen["bad"] is not None:
        raise ValueError(f"bad entry in {path}: {seen['bad']!r}")
    if validate and n != header["nnz"]:
        raise ValueError(f"{path} has {n} entries; its size line says {header['nnz']}")
    entries = rows.where(F.col("s") != size)
    if same > 1 and min(header["rows"], header["cols"]) >= 1:
        extra = spark.createDataFrame([(header["rows"], header["cols"], float(header["nnz"]) if not header["pattern"] else 1.0)] * (same - 1), "r long, c long, value double")
        entries = entries.select("r", "c", "value").unionByName(extra)
    coo = entries.select((F.col("c") - 1).alias("cell_id"), (F.col("r") - 1).cast("int").alias("gene_id"), "value")
    return coo.groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value")), header


def read_names(spark: SparkSession, path: str | None, id_column: str, name_column: str, prefer_second: bool = False) -> DataFrame:
    """Ids 0.. in line order and the names of one TSV column; blank lines are dropped; no file: no rows."""
    kind = "int" if id_column == "gene_id" else "long"
    if path is None:
        return spark.createDataFrame([], f"{id_column} {kind}, {name_column} string")
    parts = F.split(F.rtrim("value"), "\t")
    first, second = F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))
    name = F.coalesce(F.nullif(F.trim(second), F.lit("")), first) if prefer_second else first
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("_o"), F.rtrim(name).alias(name_column))
    return positions(lines, F.col("_o"), name="_at").select(F.col("_at").cast(kind).alias(id_column), name_column)


def import_10x(spark: SparkSession, folder: str, assay: str = "RNA") -> Assay:
    mtx = _present(spark, f"{folder}/matrix.mtx")
    if mtx is None:
        raise FileNotFoundError(f"no matrix.mtx in {folder}")
    counts, header = read_mtx(spark, mtx)
    genes = read_names(spark, _present(spark, f"{folder}/features.tsv") or _present(spark, f"{folder}/genes.tsv"), "gene_id", "gene", True)
    cells = read_names(spark, _present(spark, f"{folder}/barcodes.tsv"), "cell_id", "cell")
    return from_dataframe(counts, genes if genes.limit(1).count() else None, cells if cells.limit(1).count() else None, header["rows"], header["cols"], assay)


def default_names(spark: SparkSession, n: int, id_column: str, name_column: str, prefix: str) -> DataFrame:
    """<prefix>1, <prefix>2, ..."""
    kind = "int" if id_column == "gene_id" else "long"
    return spark.range(n).select(F.col("id").cast(kind).alias(id_column), F.concat(F.lit(prefix), F.col("id") + 1).alias(name_column))


def from_dataframe(counts: DataFrame, features: DataFrame | None = None, cells: DataFrame | None = None, n_genes: int | None = None, n_cells: int | None = None, assay: str = "RNA", validate: bool = False) -> Assay:
    """An assay of a (cell_id, gene_id, value) table; repeated entries are summed; missing names are gene<i>, cell<i>."""
    spark = counts.sparkSession
    counts = counts.groupBy("cell_id", "gene_id").agg(F.sum(F.col("value").cast("double")).alias("value")).select(F.col("cell_id").cast("long"), F.col("gene_id").cast("int"), "value")
    if validate and counts.where(F.col("value") < 0).limit(1).count():
        raise ValueError("counts have negative values")
    if n_genes is None and features is None:
        n_genes = counts.agg(F.coalesce(F.max("gene_id") + 1, F.lit(0))).first()[0]
    if n_cells is None and cells is None:
        n_cells = counts.agg(F.coalesce(F.max("cell_id") + 1, F.lit(0))).first()[0]
    features = default_names(spark, n_genes, "gene_id", "gene", "gene") if features is None else unique_names(features)
    cells = default_names(spark, n_cells, "cell_id", "cell", "cell") if cells is None else cells
    return Assay(features, cells, {"counts": counts}, name=assay)


def fold_layers(names: list[str]) -> dict[str, str]:
    """Layer name -> source name: prefixes counts, data and scale.data are folded, the first of each wins; others pass through."""
    found: dict[str, str] = {}
    for name in names:
        folded = next((p for p in sorted(LAYER_PREFIXES, key=len, reverse=True) if name.startswith(p)), name)
        found.setdefault(folded, name)
    return found


def from_layers(layers: dict[str, DataFrame], features: DataFrame, cells: DataFrame, assay: str = "RNA", only: list[str] | None = None) -> Assay:
    picked = fold_layers([n for n in layers if only is None or n in only])
    if not picked:
        raise ValueError("no layer to take")
    return Assay(unique_names(features), cells, {k: layers[v] for k, v in picked.items()}, name=assay)


def load(spark: SparkSession, source, assay: str = "RNA") -> Assay:
    """From a 10X directory, a stored assay, a (cell_id, gene_id, value) DataFrame, or a numpy array (genes x cells)."""
    if isinstance(source, Assay):
        return source
    if isinstance(source, DataFrame):
        return from_dataframe(source, assay=assay)
    if hasattr(source, "shape") and len(source.shape) == 2:
        from grainfield.operators.matrix import from_dense

        return from_dataframe(from_dense(spark, source), n_genes=source.shape[0], n_cells=source.shape[1], assay=assay)
    if isinstance(source, str | os.PathLike):
        path = os.fspath(source)
        if path.endswith((".h5", ".hdf5")):
            raise ValueError("HDF5 files need h5py, which is not a dependency; convert to a MatrixMarket directory or Parquet")
        if _present(spark, f"{path}/matrix.mtx"):
            return import_10x(spark, path, assay)
        return store.read_assay(spark, path, assay)
    raise TypeError(f"cannot load {type(source).__name__}")
