"""Neighbour graphs: exact k nearest neighbours (self first) and shared-neighbour (Jaccard) edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfield.assay import Assay
from grainfield.operators import blocks
from grainfield.session import checkpointed, ship

K, PRUNE = 20, 1.0 / 15.0
#: Approximate neighbours: cells that the probes are measured on, and the share of their neighbours to be reached.
MEASURED, WANTED = 128, 0.95
#: Probes are worth their copies where they leave out so much: all rows over those visited, at least.
SAVING = 4
#: Rows of a leaf and queries of it that one task holds; leaves that may be broadcast.
PIECE, BLOCK, LEAVES = 8_192, 8_192, 100_000
#: Cells of a block of those that share a neighbour.
HUB = 1_024


def knn(embeddings: DataFrame, k: int = K, dims: int | None = None) -> DataFrame:
    """cell_id, rank (0 = the cell itself), nbr_id, dist: k rows for each cell, fewer if there are fewer cells."""
    vec = F.slice("vec", 1, dims) if dims else F.col("vec")
    rows = embeddings.select(F.col("cell_id").alias("id"), vec.alias("vec"))
    own = rows.select(F.col("id").alias("cell_id"), F.lit(0).alias("rank"), F.col("id").alias("nbr_id"), F.lit(0.0).alias("dist"))
    if k <= 1:
        return own
    return own.unionByName(blocks.nearest(rows, rows, k - 1).withColumnRenamed("id", "cell_id"))


def _best_of_piece(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """id, nbr_id, dist: for each query the k rows nearest by (distance, id) of one piece of a leaf."""
    pdf = pdf.sort_values("id")
    q, c = pdf[pdf["asks"]], pdf[~pdf["asks"]]
    own, ids = q["id"].to_numpy(), c["id"].to_numpy()
    r, at, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if len(q) and len(c):
        x, y = (np.stack(t["vec"].to_numpy()).astype(float) for t in (q, c))
        r, at, d = blocks.nearest_rows(x, own, y, ids, k)
    return pd.DataFrame({"id": own[r], "nbr_id": ids[at], "dist": d})


def _in_leaves(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """id, rank (from 1), nbr_id, dist of the k best in all leaves that an id asks; both: leaf, id, vec, pieces, blocks.

    A leaf is dealt in pieces and those that ask it in blocks, so that none outgrows a task.
    """
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = asked.select("leaf", "id", "vec", every("pieces").alias("piece"), deal("blocks").alias("block"), F.lit(True).alias("asks"))
    b = held.select("leaf", "id", "vec", deal("pieces").alias("piece"), every("blocks").alias("block"), F.lit(False).alias("asks"))
    found = a.unionByName(b).groupBy("leaf", "piece", "block").applyInPandas(lambda pdf: _best_of_piece(pdf, k), "id long, nbr_id long, dist double")
    w = Window.partitionBy("id").orderBy("dist", "nbr_id")
    return found.distinct().select("id", F.row_number().over(w).alias("rank"), "nbr_id", "dist").where(F.col("rank") <= k)


def _probes(z: np.ndarray, bound: float) -> list[int] | None:
    """Leaves (table, then bits) whose flipped projections, squared, add up to at most bound; None: as many as all rows have."""
    tables, width = z.shape
    out = []
    for t in range(tables):
        cost = z[t] ** 2
        order = np.argsort(cost, kind="stable").tolist()
        todo = [(0, int(((z[t] > 0) * (1 << np.arange(width))).sum()), 0.0)]
        while todo:
            start, leaf, spent = todo.pop()
            out.append(t << width | leaf)
            if len(out) >= 1 << width:
                return None
            for i in range(start, width):
                if spent + cost[order[i]] > bound:
                    break
                todo.append((i + 1, leaf ^ (1 << order[i]), spent + cost[order[i]]))
    return out


def approximate_knn(embeddings: DataFrame, k: int = K, tables: int = 8, bits: int | None = None, seed: int = 42, wanted: float = WANTED) -> DataFrame:
    """As knn, from random-projection tables: candidates are in leaves of sign bits near the cell's own.

    How near is measured: for a bounded sample of cells the true neighbours are found among all rows, and the bound on
    flipped projections is the one within which the wanted share of them has a leaf. Where so many leaves hold a large share
    of the rows, the search is exact, as it is for cells that need as many as there are or that come out short.
    """
    ship(embeddings.sparkSession)
    own = embeddings.select("cell_id", F.lit(0).alias("rank"), F.col("cell_id").alias("nbr_id"), F.lit(0.0).alias("dist"))
    n = embeddings.count()
    if k <= 1 or not n:
        return own
    rows = embeddings.select(F.col("cell_id").alias("id"), "vec")
    dim = len(embeddings.first()["vec"])
    rng = np.random.default_rng(seed)
    width = bits or max(1, int(np.ceil(np.log2(max(2, n / 1024)))))
    planes = rng.standard_normal((tables, width, dim))
    mean = embeddings.select(F.posexplode("vec")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()
    centre = np.array([float(r["m"]) for r in mean])
    projected = lambda x: np.einsum("nd,twd->ntw", np.asarray(x, float) - centre, planes)

    def result(found: DataFrame) -> DataFrame:
        return own.unionByName(found.withColumnRenamed("id", "cell_id"))

    def bound() -> float | None:
        """None: an exact search is cheaper."""
        if tables >= 1 << width:
            return None
        sample = checkpointed(rows.orderBy(F.xxhash64("id"), "id").limit(MEASURED))
        true = F.broadcast(blocks.nearest(sample, rows, k - 1).select(F.col("id").alias("q"), F.col("nbr_id").alias("id")))  # at most MEASURED * k
        pairs = rows.join(true, "id").join(F.broadcast(sample.select(F.col("id").alias("q"), F.col("vec").alias("at"))), "q").select("at", "vec").collect()
        if not pairs:
            return None
        a, b = projected([r["at"] for r in pairs]), projected([r["vec"] for r in pairs])
        need = np.where((a > 0) != (b > 0), a * a, 0.0).sum(axis=2).min(axis=1)
        found = float(np.quantile(need, wanted)) * (1 + 1e-9)
        visits = [_probes(z, found) for z in projected([r["vec"] for r in sample.collect()])]
        return found if np.mean([1 << width if v is None else len(v) for v in visits]) * SAVING < 1 << width else None

    most = bound()
    if most is None:
        return result(blocks.nearest(rows, rows, k - 1))

    def coded(limit: float):
        @F.pandas_udf("array<long>")
        def leaves(vec: pd.Series) -> pd.Series:
            return pd.Series([_probes(z, limit) for z in projected(np.stack(vec.to_numpy()))])

        return rows.select("id", "vec", F.explode(leaves("vec")).alias("leaf"))

    held, asked = coded(-1.0), coded(most)
    pieces = held.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    sizes = checkpointed(asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).join(pieces, "leaf"))
    sizes = F.broadcast(sizes) if sizes.count() <= LEAVES else sizes
    found = checkpointed(_in_leaves(asked.join(sizes, "leaf"), held.join(sizes, "leaf"), k - 1))
    full = found.where(F.col("rank") == min(k - 1, n - 1)).select("id")
    short = checkpointed(rows.join(full, "id", "left_anti"))
    n_short = short.count()
    if n_short:
        found = found.join(short.select("id").distinct(), "id", "left_anti").unionByName(blocks.nearest(short, rows, k - 1))
    return result(found)


def snn(neighbours: DataFrame, k: int = K, prune: float = PRUNE) -> DataFrame:
    """src, dst, weight in both directions: shared neighbours (self counts) over 2k - shared, above prune."""
    # a cell that very many have as a neighbour meets them in blocks
    hubs = neighbours.groupBy("nbr_id").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("blocks")).where(F.col("blocks") > 1)
    rows = neighbours.select("cell_id", "nbr_id").join(hubs, "nbr_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    a = rows.select(F.col("cell_id").alias("src"), "nbr_id", F.pmod(F.xxhash64("cell_id"), F.col("blocks")).cast("int").alias("block"))
    b = rows.select(F.col("cell_id").alias("dst"), "nbr_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    shared = a.join(b, ["nbr_id", "block"]).where(F.col("src") < F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("c"))
    half = shared.withColumn("weight", F.col("c") / (2.0 * k - F.col("c"))).where(F.col("weight") > prune).select("src", "dst", "weight")
    return half.unionByName(half.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def find_neighbors(assay: Assay, reduction: str = "embeddings", dims: int | None = 30, k: int = K, approximate: bool = False) -> Assay:
    """Tables knn and snn from the first `dims` coordinates of a reduction."""
    table = assay.table(reduction)
    if dims:
        table = table.select("cell_id", F.slice("vec", 1, dims).alias("vec"))
    found = checkpointed(approximate_knn(table, k) if approximate else knn(table, k))
    assay.tables |= {"knn": found, "snn": checkpointed(snn(found, k))}
    return assay
