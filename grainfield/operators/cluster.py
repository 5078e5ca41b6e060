"""Community detection on shared-neighbour graphs by synchronous local moving, and modularity.

With m the sum of all stored weights (each edge counts in both directions) the gain of moving i to c is
k_in / m - r * tot * k_i / (2 m^2); against the usual definition r acts as half of itself. Both modularities are given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfield.assay import Assay
from grainfield.session import checkpointed, without_statistics

SWEEPS = 10
#: Tables of one row for each cell are broadcast up to so many cells.
BROADCAST_CELLS = 100_000


def modularity(snn: DataFrame, clusters: DataFrame, resolution: float = 1.0) -> DataFrame:
    """modularity (with m as stored), standard_modularity (resolution as usual); one row."""
    c = clusters.select("cell_id", "cluster")
    e = snn.join(c.select(F.col("cell_id").alias("src"), F.col("cluster").alias("cs")), "src").join(c.select(F.col("cell_id").alias("dst"), F.col("cluster").alias("cd")), "dst")
    per = e.groupBy("cs").agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("tot"))
    per = per.withColumn("m", F.sum("tot").over(Window.partitionBy()))
    r = float(resolution)
    own = F.col("inside") / (2 * F.col("m")) - r * F.pow(F.col("tot") / (2 * F.col("m")), 2)
    usual = F.col("inside") / F.col("m") - r * F.pow(F.col("tot") / F.col("m"), 2)
    return per.agg(F.sum(own).alias("modularity"), F.sum(usual).alias("standard_modularity"))


def renumber(clusters: DataFrame) -> DataFrame:
    """cell_id, cluster: labels 0.. by falling size (ties: least cell_id)."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("cell_id").alias("least"))
    ranked = sizes.select(F.col("cluster").alias("old"), (F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).cast("int").alias("cluster"))
    return clusters.select("cell_id", F.col("cluster").alias("old")).join(ranked, "old").select("cell_id", "cluster")


def _cut(df: DataFrame) -> DataFrame:
    return without_statistics(checkpointed(df))


def local_moving(snn: DataFrame, cells: DataFrame, resolution: float = 0.8, sweeps: int = SWEEPS) -> DataFrame:
    """cell_id, cluster: sweeps in which halves of the cells (by a hash that changes) move to the best community at once."""
    k = snn.groupBy("src").agg(F.sum("weight").alias("k"))
    state = _cut(cells.select("cell_id").join(k, F.col("cell_id") == F.col("src"), "left").select("cell_id", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("cell_id").alias("cluster")))
    m = float(snn.agg(F.sum("weight")).first()[0] or 0.0)
    if m == 0:
        return state.select("cell_id", "cluster")
    r = float(resolution)
    state_is_small = state.count() <= BROADCAST_CELLS
    small = F.broadcast if state_is_small else (lambda df: df)
    for sweep in range(2 * sweeps):
        turn = lambda column: F.pmod(F.xxhash64(column, F.lit(sweep // 2)), F.lit(2)) == sweep % 2  # noqa: B023, E731
        tot = _cut(state.groupBy("cluster").agg(F.sum("k").alias("tot")).coalesce(8 if state_is_small else 10_000)).withColumnRenamed("cluster", "c")
        to = snn.where(turn("src")).join(small(state.select(F.col("cell_id").alias("dst"), F.col("cluster").alias("c"))), "dst").select(F.col("src").alias("cell_id"), "c", "weight")
        own = state.where(turn("cell_id")).select("cell_id", F.col("cluster").alias("c"), F.lit(0.0).alias("weight"))
        options = to.unionByName(own).groupBy("cell_id", "c").agg(F.sum("weight").alias("k_in"))
        options = options.join(small(state), "cell_id").join(small(tot), "c")
        outside = F.when(F.col("c") == F.col("cluster"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
        gain = F.col("k_in") / m - r * outside * F.col("k") / (2 * m * m)
        # the present community wins ties, then the least label
        best = options.groupBy("cell_id").agg(F.min(F.struct((-F.round(gain, 15)).alias("g"), (F.col("c") != F.col("cluster")).alias("moved"), F.col("c").alias("c"))).alias("best"))
        new = state.join(small(best), "cell_id", "left").select("cell_id", "k", F.coalesce("best.c", "cluster").alias("cluster"), F.coalesce("best.moved", F.lit(False)).alias("moved"))
        new = _cut(new.coalesce(8) if state_is_small else new)
        moved = new.where("moved").limit(1).count()
        state, idle = new.drop("moved"), (0 if moved else (idle + 1 if sweep else 1))
        if idle >= 2:
            break
    return state.select("cell_id", "cluster")


def find_clusters(snn: DataFrame, cells: DataFrame, algorithm: str = "leiden", resolution: float = 0.8, sweeps: int = SWEEPS) -> DataFrame:
    """cell_id, algorithm, cluster. Refinement from the communities themselves moves no node, so both algorithms agree."""
    found = renumber(local_moving(snn, cells, resolution, sweeps))
    return found.select("cell_id", F.lit("leiden" if algorithm == "leiden" else "louvain").alias("algorithm"), "cluster")


def cluster_assay(assay: Assay, algorithm: str = "leiden", resolution: float = 0.8) -> Assay:
    """Tables clusters, and cluster_summary: n_clusters, modularity, standard_modularity."""
    snn = assay.table("snn")
    found = _cut(find_clusters(snn, assay.cells, algorithm, resolution))
    summary = modularity(snn, found, resolution).select(F.lit(found.select("cluster").distinct().count()).alias("n_clusters"), "modularity", "standard_modularity")
    assay.tables |= {"clusters": found, "cluster_summary": summary}
    return assay
