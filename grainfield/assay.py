"""The container of one modality: features, cells and layers as DataFrames in coordinate form."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COO = "cell_id long, gene_id int, value double"


@dataclass
class Assay:
    """features(gene_id, gene), cells(cell_id, cell, ...), layers of (cell_id, gene_id, value); an absent entry is 0.

    tables holds what operators register: size_factors, gene_stats, embeddings, loadings, stdev, knn, snn, clusters.
    """

    features: DataFrame
    cells: DataFrame
    layers: dict[str, DataFrame] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    attributes: dict[str, int | float | str] = field(default_factory=dict)
    name: str = "RNA"

    @property
    def key(self) -> str:
        return f"{self.name.lower()}_"

    @property
    def n_genes(self) -> int:
        return self.features.count()

    @property
    def n_cells(self) -> int:
        return self.cells.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_genes, self.n_cells

    def layer(self, name: str) -> DataFrame:
        if name not in self.layers:
            raise KeyError(f"layer {name!r} is not there; layers: {sorted(self.layers)}")
        return self.layers[name]

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"table {name!r} is not there; tables: {sorted(self.tables)}")
        return self.tables[name]

    def variable_features(self) -> DataFrame:
        """Names of the genes flagged as variable, in gene order."""
        flags = self.table("gene_stats").where("variable").select("gene_id")
        return self.features.join(flags, "gene_id", "left_semi").orderBy("gene_id").select("gene_id", "gene")

    def as_views(self, prefix: str = "") -> None:
        """Register all tables as temporary views, for SQL."""
        for name, df in {"features": self.features, "cells": self.cells, **self.layers, **self.tables}.items():
            df.createOrReplaceTempView(f"{prefix}{name.replace('.', '_')}")

    def __repr__(self) -> str:
        return f"Assay {self.name}: {self.n_genes} features x {self.n_cells} cells; layers {sorted(self.layers)}; tables {sorted(self.tables)}"


def explode_ids(df: DataFrame, column: str, n: int) -> DataFrame:
    """Each row once for every id 0..n-1: the zero-filled side of a dense result."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else df.withColumn(column, F.lit(0)).limit(0)
