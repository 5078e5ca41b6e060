"""Packing of instruction data: each of the three limits binds, and the tokens are those of the turns."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grainfield.llm import queries, tokens
from grainfield.llm.packing import pack


def test_conversations(spark):
    d = "/root/testdata/sf0.01"
    t = Tokenizer.from_file(tokens.default_path())
    want = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want[(r["conv_id"] << 20) + r["turn"]] = (ids, r["role"] == "assistant")
    got = queries.conversations_packing(spark, d).collect()
    bins, docs = defaultdict(list), defaultdict(int)
    for r in got:
        ids, learned = want[r["doc_id"]]
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids)
        assert r["loss_tokens"] == (r["length"] if learned else 0)
        bins[r["sequence_id"]].append(r)
        docs[r["doc_id"]] += r["length"]
    assert docs == {k: len(v[0]) for k, v in want.items()}
    sums = [(sum(r["length"] for r in b), len(b), sum(r["loss_tokens"] for r in b)) for b in bins.values()]
    assert all(a <= 1024 and b <= 6 and c <= 768 for a, b, c in sums)
    # full by tokens; by segments with tokens to spare; by loss with both to spare
    assert any(a == 1024 for a, _, _ in sums) and any(b == 6 and a < 1024 for a, b, _ in sums) and any(c == 768 for _, _, c in sums)


@pytest.mark.parametrize("limits, full", [((100, 50, 100), 0), ((1000, 2, 1000), 1), ((1000, 50, 60), 2)])
def test_each_limit_binds(spark, limits, full):
    rng = np.random.default_rng(full)
    rows = [(i, "word " * int(rng.integers(1, 40)), i % 2 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learned boolean").coalesce(1)
    got = pack(df, max_tokens=limits[0], max_segments=limits[1], max_loss=limits[2], loss="learned").groupBy("sequence_id").agg(F.sum("length").alias("a"), F.count("*").alias("b"), F.sum("loss_tokens").alias("c")).collect()
    sums = np.array([(r["a"], r["b"], r["c"]) for r in got])
    assert (sums <= np.array(limits)).all()
    assert (sums[:, full] == limits[full]).mean() > 0.4


def test_loss_column_with_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", True), (2, "c d", None), (3, None, True), (None, "", False)], "doc_id long, text string, learned boolean")
    got = {r["doc_id"]: (r["length"], r["loss_tokens"]) for r in pack(df, loss="learned").collect()}
    assert got[2][1] == 0 and got[1][0] == got[1][1] == 3 and got[3] == (1, 1) and got[None] == (1, 0)
    assert pack(df.limit(0), loss="learned").count() == 0
