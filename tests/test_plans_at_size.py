"""What must not grow with the tables: sums held while cells meet, passes over a file of entries."""

import uuid

import pytest
from pyspark.sql import functions as F

from grainfield.operators.matrix import matmul
from grainfield.sources import readers


def test_products_are_added_where_their_gene_is(spark):
    a = spark.range(200).select((F.col("id") % 20).alias("cell_id"), (F.col("id") % 7).cast("int").alias("gene_id"), F.col("id").cast("double").alias("value"))
    b = spark.range(60).select((F.col("id") % 20).alias("cell_id"), (F.col("id") % 3).cast("int").alias("k"), (F.col("id") % 5).cast("double").alias("value"))
    b = b.unionByName(b.limit(5))  # a place that comes twice counts twice
    product = matmul(a, b)
    plan = product._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Join")[0]  # what is done with pairs after the join
    assert above.rindex("HashAggregate") < above.index("Exchange") and "gene_id" in above[above.index("Exchange") :].split("\n")[0]
    want = a.join(b.withColumnRenamed("value", "w"), "cell_id").groupBy("gene_id", "k").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    key = lambda df: {(r["gene_id"], r["k"]): r["value"] for r in df.collect()}
    assert key(product) == key(want) and product.dtypes == want.dtypes


def jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_good_file_is_looked_through_in_one_pass(spark, tmp_path):
    # jobs with a limit look at a part, then at more of them: one at a time on a large file
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n40 50 2000\n" + "".join(f"{g} {c} 1.5\n" for g in range(1, 41) for c in range(1, 51)))
    at = f"file://{tmp_path}/m.mtx"
    header = jobs(spark, lambda: readers.mtx_header(spark, at))
    assert jobs(spark, lambda: readers.read_mtx(spark, at)) - header <= 2
    assert readers.read_mtx(spark, at)[0].count() == 2000


@pytest.mark.parametrize(("lines", "says"), [("3 2 2\n1 1 5\n4 1 5\n", "bad entry .*'4 1 5'"), ("3 2 2\n1 1 5\nx\n", "bad entry .*'x'"), ("3 2 3\n1 1 5\n", "1 entries"), ("3 2 1\n", "0 entries")])
def test_bad_files_are_refused(spark, tmp_path, lines, says):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n" + lines)
    with pytest.raises(ValueError, match=says):
        readers.read_mtx(spark, f"file://{tmp_path}/m.mtx")


def test_an_entry_that_reads_like_the_size_line(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 2 2\n3 2 2\n1 1 5\n")
    assert {tuple(r) for r in readers.read_mtx(spark, f"file://{tmp_path}/m.mtx")[0].collect()} == {(1, 2, 2.0), (0, 0, 5.0)}
