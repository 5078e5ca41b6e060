"""What a session needs so that Python workers anywhere can run this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let the Python workers of any cluster import this package (once for each context)."""
    sc = spark.sparkContext
    if getattr(sc, "_grainfield_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="grainfield-")) / "grainfield.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent).as_posix())
    sc.addPyFile(str(target))
    sc._grainfield_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local session (driver and executors are one process) gets a folder of its own; a cluster is refused,
    since its executors would not see the driver's folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="grainfield-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder, its lineage forgotten: a lost executor costs nothing of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def without_statistics(df: DataFrame) -> DataFrame:
    """A checkpointed table without the size estimate it was made with.

    Estimates of joins multiply; in a loop they would grow with each round until planning itself takes longest.
    """
    spark = df.sparkSession
    rows = df._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), spark)
