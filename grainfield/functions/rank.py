"""Positions of rows in a total order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.session import checkpointed


#: Rows that one task may rank.
FEW = 100_000


def positions(df: DataFrame, *order: Column, name: str = "position", rows: int | None = None) -> DataFrame:
    """df with the 0-based position of each row: range partitions are ranked by themselves, after the sizes of those before them.

    What goes to every task is one number for each range partition. Rows that tie in `order` come in any order.
    rows: how many there are, if known; a few are ranked by one task.
    """
    if rows is not None and rows <= FEW:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = F.broadcast(df.sparkSession.createDataFrame(before, "_part int, _before long"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(starts, "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_part", "_before")
