"""Id files: lookups through several buckets and shards, one block at a time, against the files as a whole."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfield.llm import tokenbin, tokens


class Counted(io.BytesIO):
    got = 0

    def read(self, n=-1):
        out = super().read(n)
        self.got += len(out)
        return out


@pytest.mark.parametrize("n, levels", [(0, 24), (1, 24), (700, 24), (30_000, 24), (3_000, 1), (3_000, 2)])
def test_lookup_by_blocks(n, levels):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    mph = tokenbin.PerfectHash.build(keys, levels=levels)
    data = mph.dump()
    assert sorted(mph.find(keys)) == list(range(len(keys)))
    for k, want in list(zip(keys.tolist(), mph.find(keys).tolist(), strict=True))[:: max(1, n // 500)]:
        f = Counted(data)
        slot, slots = tokenbin.find_in_file(f, k)
        assert slot == want and slots == len(data)
        assert f.got < 16 + 8 * levels + 25 * 72 + 8 * 40
    again = tokenbin.PerfectHash.load(io.BytesIO(data))
    assert (again.find(keys) == mph.find(keys)).all()


def test_many_buckets_and_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenbin, "KEYS_PER_BUCKET", 40)
    rows = [(i * 7 - 900 if i % 9 else None, f"text {i} of some words" * (i % 4)) for i in range(400)] + [(7, "again"), (7, "and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"file://{tmp_path}/ids"
    manifest = tokenbin.write(docs, folder, shards=6)
    assert tokenbin.n_buckets(folder) > 5 and manifest.select("shard").distinct().count() > 3
    # rows without a key come first and are dealt over shards like others
    assert manifest.where(F.col("doc_id").isNull()).count() == sum(i is None for i, _ in rows)
    # the bucket of a key is the same in Python and in Spark
    n = tokenbin.n_buckets(folder)
    for r in manifest.where(F.col("doc_id").isNotNull()).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("b")).collect():
        assert tokenbin.bucket_of(r["doc_id"], n) == r["b"]
    enc = tokens.encoder(tokens.default_path())
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append([*np.frombuffer(enc.encode(t), enc.dtype).tolist(), 0])
    for i in [7, -893, 900, *[k for k in want if k is not None][::11]]:
        assert sorted(x.tolist() for x in tokenbin.get(folder, i)) == sorted(want.get(i, []))
    assert tokenbin.get(folder, 10**12) == []
    back = tokenbin.read_back(tokenbin.locate(manifest.select("doc_id"), folder), folder).collect()
    assert len(back) == sum(i is not None for i, _ in rows)


def test_shards_follow_the_size(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(i, f"{i * 7919} " * 200) for i in range(400)], "doc_id long, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    few = tokenbin._shards(docs)
    monkeypatch.setattr(tokenbin, "SHARD_BYTES", 2_000)
    assert few == 4 < tokenbin._shards(docs)
