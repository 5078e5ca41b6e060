"""Stored assays: one folder of Parquet tables for each assay, attributes in a JSON sidecar."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from grainfield.assay import Assay


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def list_groups(spark: SparkSession, path: str) -> list[str]:
    """Names below a path; none if it is absent."""
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.delete(at, True)


def root(path: str, assay: str) -> str:
    return f"{path.rstrip('/')}/assays/{assay}"


def write_table(df: DataFrame, path: str, mode: str = "overwrite", sort: list[str] | None = None) -> None:
    """Replace a table; sorted within files, so that row-group statistics prune slices."""
    (df.sortWithinPartitions(*sort) if sort else df).write.mode(mode).parquet(path)


def write_assay(assay: Assay, path: str, mode: str = "overwrite") -> None:
    """All tables of an assay. mode errorifexists refuses an existing one."""
    spark, top = assay.cells.sparkSession, root(path, assay.name)
    if mode == "errorifexists" and exists(spark, top):
        raise FileExistsError(top)
    write_table(assay.features, f"{top}/features")
    write_table(assay.cells, f"{top}/cells")
    for kind, tables in (("layers", assay.layers), ("tables", assay.tables)):
        for name, df in tables.items():
            write_table(df, f"{top}/{kind}/{name}", sort=[c for c in ("cell_id", "gene_id") if c in df.columns])
    write_attributes(spark, top, assay.attributes)


def write_attributes(spark: SparkSession, top: str, attributes: dict) -> None:
    for k, v in attributes.items():
        if not isinstance(v, int | float | str):
            raise TypeError(f"attribute {k} must be a number or a string")
    spark.createDataFrame([(json.dumps(attributes),)], "json string").coalesce(1).write.mode("overwrite").json(f"{top}/attributes")


def read_attributes(spark: SparkSession, top: str) -> dict:
    return json.loads(spark.read.json(f"{top}/attributes").first()["json"]) if exists(spark, f"{top}/attributes") else {}


def read_assay(spark: SparkSession, path: str, assay: str = "RNA") -> Assay:
    top = root(path, assay)
    layers = list_groups(spark, f"{top}/layers")
    if not exists(spark, top):
        raise FileNotFoundError(f"no assay {assay} in {path}")
    if not layers:
        raise ValueError(f"assay {assay} in {path} has no layers")
    read = spark.read.parquet
    return Assay(
        read(f"{top}/features"), read(f"{top}/cells"), {n: read(f"{top}/layers/{n}") for n in layers},
        {n: read(f"{top}/tables/{n}") for n in list_groups(spark, f"{top}/tables")}, read_attributes(spark, top), assay,
    )


def read_vector(spark: SparkSession, path: str, column: str, order: str) -> list:
    return [r[0] for r in spark.read.parquet(path).orderBy(order).select(column).collect()]


def export(assay: Assay, layers: list[str] | None = None) -> dict:
    """Arrow tables of chosen layers (the first doubling as counts), features and cells: the way back to memory."""
    names = layers or sorted(assay.layers)
    have = [n for n in names if n in assay.layers]
    if not have:
        raise ValueError("no such layer")
    out = {n: assay.layers[n].toArrow() for n in have}
    return {"counts": out[have[0]], **out, "features": assay.features.orderBy("gene_id").toArrow(), "cells": assay.cells.orderBy("cell_id").toArrow()}
