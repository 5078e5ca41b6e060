"""MatrixMarket directories: parts written by tasks, then joined into the single files that the format asks for."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.functions.rank import positions


def _joined(lines: DataFrame, path: str, head: str = "") -> None:
    """One text file of the lines (column value), partition by partition, behind a head; copied as streams of bytes."""
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    lines.select("value").write.text(parts)
    folder, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    out = fs.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        # part files are named by partition
        for at in sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(at))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            part.close()
    finally:
        out.close()
    fs.delete(folder, True)


def write_mtx(counts: DataFrame, folder: str, n_genes: int, n_cells: int, entries: int | None = None) -> None:
    """folder/matrix.mtx of a (cell_id, gene_id, value) table with unique entries (0-based; written 1-based), column by column.

    entries: how many there are, if known.
    """
    line = F.concat_ws(" ", (F.col("gene_id") + 1).cast("string"), (F.col("cell_id") + 1).cast("string"), F.col("value").cast("string"))
    rows = counts.repartitionByRange("cell_id", "gene_id").sortWithinPartitions("cell_id", "gene_id").select(line.alias("value"))
    _joined(rows, f"{folder}/matrix.mtx", f"%%MatrixMarket matrix coordinate real general\n{n_genes} {n_cells} {counts.count() if entries is None else entries}\n")


def write_names(names: DataFrame, path: str, order: str) -> None:
    """A list of names (column name), one a line, in the order of a column."""
    ranked = positions(names, F.col(order), name="_at")
    _joined(ranked.repartitionByRange(F.col("_at")).sortWithinPartitions("_at").select(F.col("name").alias("value")), path)
