"""Principal components from distributed cross products of coordinate-form data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.assay import Assay
from grainfield.operators.variable import gene_moments
from grainfield.session import checkpointed, ship

#: Cross products of all pairs of genes up to so many; beyond that, subspace iteration by matrix products.
GRAM_GENES = 2_000
SMALL_GENES, SMALL_CELLS = 2_000, 5_000


def cross_products(coo: DataFrame, features: DataFrame, limit: int = GRAM_GENES) -> DataFrame:
    """i, j, s (i <= j): sums over cells of the products of two genes, for pairs that some cell has both of.

    Up to `limit` genes each task adds up one square block over its cells, and only rows of blocks are shuffled; beyond that, pairs
    of genes meet in a join by cell.
    """
    x = coo.join(features.select("gene_id"), "gene_id", "left_semi")
    ids = np.array(sorted(r[0] for r in features.select("gene_id").distinct().limit(limit + 1).collect()))
    if len(ids) > limit:
        a = x.select("cell_id", F.col("gene_id").alias("i"), F.col("value").alias("a"))
        b = x.select("cell_id", F.col("gene_id").alias("j"), F.col("value").alias("b"))
        return a.join(b, "cell_id").where(F.col("i") <= F.col("j")).groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    g = len(ids)

    def block(batches):
        total, rest = np.zeros((g, g)), None
        for batch in batches:
            cell, gene, value = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if rest is not None:
                cell, gene, value = (np.concatenate(p) for p in zip(rest, (cell, gene, value), strict=True))
            # the last cell may go on in the next batch
            whole = np.searchsorted(cell, cell[-1]) if len(cell) else 0
            rest = (cell[whole:], gene[whole:], value[whole:])
            _add(total, cell[:whole], np.searchsorted(ids, gene[:whole]), value[:whole])
        if rest is not None:
            _add(total, rest[0], np.searchsorted(ids, rest[1]), rest[2])
            at = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(list(total[at]), pa.list_(pa.float64()))], ["i", "v"])

    def added(pdf):
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    ship(coo.sparkSession)
    dealt = x.select("cell_id", "gene_id", F.col("value").cast("double")).repartition("cell_id").sortWithinPartitions("cell_id")
    rows = dealt.mapInArrow(block, "i int, v array<double>").groupBy("i").applyInPandas(added, "i int, v array<double>")
    named = F.array(*[F.lit(int(i)) for i in ids])
    pairs = rows.select(F.col("i"), F.posexplode("v").alias("j", "s")).where((F.col("j") >= F.col("i")) & (F.col("s") != 0))
    return pairs.select(F.get(named, F.col("i")).alias("i"), F.get(named, F.col("j")).alias("j"), "s")


def _add(total: np.ndarray, cell: np.ndarray, place: np.ndarray, value: np.ndarray, width: int = 2_048) -> None:
    """Add the products of whole cells (ascending), some cells at a time as a dense block."""
    row = np.cumsum(np.concatenate([[0], np.diff(cell) != 0])) if len(cell) else np.zeros(0, int)
    for first in range(0, int(row[-1]) + 1 if len(row) else 0, width):
        lo, hi = np.searchsorted(row, [first, first + width])
        x = np.zeros((width, len(total)))
        np.add.at(x, (row[lo:hi] - first, place[lo:hi]), value[lo:hi])
        total += x.T @ x


def gram(coo: DataFrame, features: DataFrame, n_cells: int, scale: bool = False) -> DataFrame:
    """i, j, value (i <= j) of the covariance (scale: correlation-like, per-gene sd 1) of the genes in features."""
    s = cross_products(coo, features)
    m = gene_moments(coo.join(features.select("gene_id"), "gene_id", "left_semi"), features, n_cells).select("gene_id", "mean", F.sqrt("variance").alias("sd"))
    mi = m.select(F.col("gene_id").alias("i"), F.col("mean").alias("mi"), F.col("sd").alias("si"))
    mj = m.select(F.col("gene_id").alias("j"), F.col("mean").alias("mj"), F.col("sd").alias("sj"))
    # pairs that never meet in a cell still have the product of their means: every pair comes from the gene list
    every = mi.join(mj, F.col("i") <= F.col("j")).join(s, ["i", "j"], "left")
    cov = (F.coalesce("s", F.lit(0.0)) - n_cells * F.col("mi") * F.col("mj")) / max(1, n_cells - 1)
    if scale:
        cov = F.when((F.col("si") > 0) & (F.col("sj") > 0), cov / (F.col("si") * F.col("sj"))).otherwise(0.0)
    return every.select("i", "j", cov.alias("value"))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry (first on ties) positive."""
    top = np.abs(vectors).argmax(axis=0)
    sign = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def _columns(rows: np.ndarray, ids: np.ndarray, spark) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame({"gene_id": ids.astype("int32"), "vec": [r.tolist() for r in rows]}), "gene_id int, vec array<double>")


def _product(coo: DataFrame, weights: DataFrame, on: str, by: str, k: int) -> DataFrame:
    """by, vec: sums over `on` of value * vec, coordinate by coordinate."""
    joined = coo.join(weights, on)
    sums = joined.groupBy(by).agg(*[F.sum(F.col("value") * F.get("vec", F.lit(i))).alias(f"v{i}") for i in range(k)])
    return sums.select(by, F.array(*[F.col(f"v{i}") for i in range(k)]).alias("vec"))


def run_pca(coo: DataFrame, features: DataFrame, cells: DataFrame, npcs: int = 50, scale: bool = False, gram_genes: int = GRAM_GENES, power_steps: int = 6, seed: int = 42) -> dict[str, DataFrame]:
    """embeddings(cell_id, vec), loadings(gene_id, vec), stdev(pc, stdev), summary(total_variance) of the genes in features.

    Up to gram_genes the covariance is decomposed on the driver (at most gram_genes squared numbers); beyond that, a
    block of npcs + 10 directions is iterated by distributed products, and only blocks of that width are on the driver.
    """
    spark = coo.sparkSession
    ids = np.array(sorted(r[0] for r in features.select("gene_id").collect()))
    n_cells, g = cells.count(), len(ids)
    # read several times below
    coo = checkpointed(coo.join(features.select("gene_id"), "gene_id", "left_semi"))
    stats = {r["gene_id"]: (r["mean"], r["variance"]) for r in gene_moments(coo, features, n_cells).collect()}
    mean = np.array([stats[i][0] for i in ids])
    sd = np.sqrt(np.array([stats[i][1] for i in ids]))
    unit = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0) if scale else np.ones(g)
    total = float(((sd * unit) ** 2).sum())
    k = max(0, min(npcs, g, n_cells))
    place = {int(i): p for p, i in enumerate(ids)}
    if g <= gram_genes:
        cov = np.zeros((g, g))
        got = gram(coo, features, n_cells, scale).toPandas()
        i, j = got["i"].map(place).to_numpy(int), got["j"].map(place).to_numpy(int)
        cov[i, j] = got["value"]
        cov[j, i] = got["value"]
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    else:
        width = min(k + 10, g, n_cells)
        q = np.linalg.qr(np.random.default_rng(seed).standard_normal((g, width)))[0]
        for _ in range(power_steps):
            w = q * unit[:, None]
            y = _product(coo, _columns(w, ids, spark), "gene_id", "cell_id", width)
            shift = mean @ w
            # cells without entries contribute the shift alone
            back = _product(coo, y.select("cell_id", F.zip_with("vec", F.array(*[F.lit(float(s)) for s in shift]), lambda a, b: a - b).alias("vec")), "cell_id", "gene_id", width)
            # the sum over cells of centred scores is 0, so centring the left side changes nothing
            z = np.zeros((g, width))
            for r in back.collect():
                z[place[r["gene_id"]]] = r["vec"]
            z *= unit[:, None]
            q, s = np.linalg.qr(z)
            values = np.abs(np.diag(s))
        u, values, _ = np.linalg.svd(s)
        q, values = (q @ u)[:, :k], values[:k] / max(1, n_cells - 1)
        vectors = q
    vectors = _signed(vectors)
    if not np.isfinite(vectors).all():
        vectors, values = np.zeros_like(vectors), np.zeros_like(values)
    loadings = _columns(vectors, ids, spark)
    w = vectors * unit[:, None]
    shift = F.array(*[F.lit(float(s)) for s in mean @ w])
    scores = _product(coo, _columns(w, ids, spark), "gene_id", "cell_id", k)
    zero = F.array(*[F.lit(0.0)] * k)
    embeddings = cells.select("cell_id").join(scores, "cell_id", "left").select("cell_id", F.zip_with(F.coalesce("vec", zero), shift, lambda a, b: a - b).alias("vec"))
    stdev = spark.createDataFrame([(i + 1, float(np.sqrt(max(0.0, v)))) for i, v in enumerate(values)], "pc int, stdev double")
    return {"embeddings": embeddings, "loadings": loadings, "stdev": stdev, "summary": spark.createDataFrame([(total,)], "total_variance double")}


def pca(assay: Assay, npcs: int = 50, features: list[str] | None = None, scale: bool | None = None) -> Assay:
    """Features: the given names, else the variable ones, else all. scale None: centre only where all fits, else scale too."""
    chosen = assay.features
    if features is not None:
        chosen = chosen.where(F.col("gene").isin(list(features)))
    elif "gene_stats" in assay.tables and "variable" in assay.tables["gene_stats"].columns:
        chosen = chosen.join(assay.tables["gene_stats"].where("variable").select("gene_id"), "gene_id", "left_semi")
    if scale is None:
        n, all_, c = chosen.count(), assay.n_genes, assay.n_cells
        small = n <= SMALL_GENES if n < all_ else all_ <= SMALL_GENES and c <= SMALL_CELLS
        scale = not small and "gene_stats" in assay.tables and "residual_sd" in assay.tables["gene_stats"].columns
    found = run_pca(assay.layer("data") if "data" in assay.layers else assay.layer("counts"), chosen, assay.cells, npcs, scale)
    zero = F.array(*[F.lit(0.0)] * found["stdev"].count())
    found["loadings"] = assay.features.select("gene_id").join(found["loadings"], "gene_id", "left").select("gene_id", F.coalesce("vec", zero).alias("vec"))
    assay.tables |= {"embeddings": found["embeddings"], "loadings": found["loadings"], "stdev": found["stdev"], "pca_summary": found["summary"]}
    return assay
