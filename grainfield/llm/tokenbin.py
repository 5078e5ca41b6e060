"""Token-ID output: raw id shards with a minimal perfect hash index from document key to place.

A folder holds, for ascending doc_id (null first, then by hash of the text),

* shard-NNNNNN.ids: the ids of its documents one after another, then the table of their offsets (n + 1 unsigned
  64-bit numbers of ids), then the trailer: documents and ids (unsigned 64-bit), bytes of an id (unsigned 64-bit), magic;
* index-NNNNNN.mph: the minimal perfect hash of a bucket of keys (levels of bits, a bit for each key that is alone in
  its place, the rest going to the next level; how many bits are set before each 64 bytes), then one slot for each key:
  fingerprint, shard, ordinal, offset, ids, rows.

A key leads in constant time to its bucket, its slot, and, if the stored fingerprint agrees, its shard and offset: a lookup
reads the head of one index file, 64 bytes and a count for each level that it passes (one or two, on average), one slot,
two offsets and the ids. Shards are as many as the size of the input asks for; rows without a key are dealt over them too.
Files are written under a name of the attempt and then renamed, so lost or repeated tasks leave whole files only.
Both kinds are reached through the URI of the shared folder, as an Arrow file system.

Defined results: a null or empty text is the end id alone. Rows that repeat a doc_id lie side by side; the key leads
to the first and says how many there are. A row with null doc_id is stored but has no key. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainfield.llm import tokens
from grainfield.llm.common import broadcast_if_small, cut, ship, trim

END_ID = 0
MAGIC = b"GFIDS001"
TRAILER = "<QQQ8s"
#: Keys for each index file, on average; bits for each key of a level; levels before the few left are listed.
KEYS_PER_BUCKET = 500_000
GAMMA = 2.0
LEVELS = 24
#: Bytes of bits that one stored count covers; bytes of input for each shard, if that makes more shards than partitions are set.
BLOCK = 64
SHARD_BYTES = 128 << 20
SLOT = np.dtype([("fp", "<u4"), ("shard", "<u4"), ("ordinal", "<u4"), ("rows", "<u4"), ("offset", "<u8"), ("n", "<u8")])


# ---- minimal perfect hash


def _mix(keys: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1_000_003) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys -> 0..n-1, each once."""

    def __init__(self, bits: list[np.ndarray], spare: np.ndarray):
        self.bits, self.spare = bits, spare
        base, self.ranks = 0, []
        for b in bits:
            # ones before each byte
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(b).astype(np.int64))])
            self.ranks.append(base + ones)
            base += int(ones[-1])
        self.placed = base

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA, levels: int = LEVELS) -> PerfectHash:
        left, bits = keys.astype(np.uint64), []
        for level in range(levels):
            if not len(left):
                break
            m = max(64, int(len(left) * gamma) + 7 & ~7)
            at = (_mix(left, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            bits.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(bits, np.sort(left))

    def __len__(self) -> int:
        return self.placed + len(self.spare)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 or any slot for keys that were never put in."""
        keys = keys.astype(np.uint64)
        slot, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, b in enumerate(self.bits):
            if not len(todo):
                break
            at = (_mix(keys[todo], level) % np.uint64(len(b) * 8)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (b[byte] >> bit) & 1 == 1
            below = np.bitwise_count(b[byte] & ((np.uint8(1) << bit) - np.uint8(1)).astype(np.uint8))
            slot[todo[hit]] = self.ranks[level][byte[hit]] + below[hit]
            todo = todo[~hit]
        if len(todo) and len(self.spare):
            i = np.minimum(np.searchsorted(self.spare, keys[todo]), len(self.spare) - 1)
            hit = self.spare[i] == keys[todo]
            slot[todo[hit]] = self.placed + i[hit]
        return slot

    def dump(self) -> bytes:
        """Head (levels, spare keys, bytes of each level), bits, counts before each block, spare keys."""
        head = struct.pack("<QQ", len(self.bits), len(self.spare)) + b"".join(struct.pack("<Q", len(b)) for b in self.bits)
        counts = b"".join(r[:-1:BLOCK].astype("<u8").tobytes() for r in self.ranks)
        return head + b"".join(b.tobytes() for b in self.bits) + counts + self.spare.astype("<u8").tobytes()

    @staticmethod
    def head(f) -> tuple[list[int], int]:
        n_bits, n_spare = struct.unpack("<QQ", f.read(16))
        return list(struct.unpack(f"<{n_bits}Q", f.read(8 * n_bits))), n_spare

    @classmethod
    def load(cls, f) -> PerfectHash:
        sizes, n_spare = cls.head(f)
        bits = [np.frombuffer(f.read(n), np.uint8) for n in sizes]
        f.read(8 * sum(-(-n // BLOCK) for n in sizes))
        return cls(bits, np.frombuffer(f.read(8 * n_spare), "<u8"))


def find_in_file(f, key: int) -> tuple[int, int]:
    """(slot of a key or -1, place of the first slot in the file), reading a block of each level that the key passes."""
    sizes, n_spare = PerfectHash.head(f)
    bits, counts = 16 + 8 * len(sizes), 16 + 8 * len(sizes) + sum(sizes)
    spare = counts + 8 * sum(-(-n // BLOCK) for n in sizes)
    slots, k = spare + 8 * n_spare, np.array([key], np.uint64)
    for level, n in enumerate(sizes):
        at = int(_mix(k, level)[0] % np.uint64(n * 8))
        byte, block = at >> 3, (at >> 3) // BLOCK
        f.seek(bits + block * BLOCK)
        row = f.read(min(BLOCK, n - block * BLOCK))
        here = byte - block * BLOCK
        if row[here] >> (at & 7) & 1:
            f.seek(counts + 8 * block)
            before = struct.unpack("<Q", f.read(8))[0]
            return before + int.from_bytes(row[:here], "little").bit_count() + (row[here] & ((1 << (at & 7)) - 1)).bit_count(), slots
        bits, counts = bits + n, counts + 8 * -(-n // BLOCK)
    lo, hi = 0, n_spare  # the few left after the last level: by halves
    while lo < hi:
        mid = (lo + hi) // 2
        f.seek(spare + 8 * mid)
        value = struct.unpack("<Q", f.read(8))[0]
        if value == key:
            return _placed(f, sizes) + mid, slots
        lo, hi = (mid + 1, hi) if value < key else (lo, mid)
    return -1, slots


def _placed(f, sizes: list[int]) -> int:
    """Keys that have a bit: the last count, and the bits of the last block."""
    if not sizes:
        return 0
    bits, blocks = 16 + 8 * len(sizes), -(-sizes[-1] // BLOCK)
    counts = bits + sum(sizes) + 8 * sum(-(-n // BLOCK) for n in sizes[:-1])
    f.seek(counts + 8 * (blocks - 1))
    before = struct.unpack("<Q", f.read(8))[0]
    f.seek(bits + sum(sizes[:-1]) + (blocks - 1) * BLOCK)
    return before + int.from_bytes(f.read(sizes[-1] - (blocks - 1) * BLOCK), "little").bit_count()


# ---- files


def _open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, write) -> None:
    where, top = _open_folder(uri)
    tmp = f"{top}/_{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(tmp) as f:
        write(f)
    where.move(tmp, f"{top}/{name}")


def bucket_of(doc_id: int, buckets: int) -> int:
    import xxhash

    h = xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
    return (h - (1 << 64) if h >> 63 else h) % buckets


MANIFEST = "doc_id long, shard long, ordinal long, offset long, n_tokens long"


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Write shards and index into a new folder; the (materialised) places of all rows."""
    path = tokenizer or tokens.default_path()
    ship(docs.sparkSession)
    where, top = _open_folder(folder)
    where.create_dir(top, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = F.col("doc_id").asc_nulls_first()
    # rows without a key may lie in several shards, rows that share one lie in one
    apart = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).asc_nulls_first()
    rows = rows.repartitionByRange(shards or _shards(rows), order, apart).sortWithinPartitions(order, F.xxhash64("text"))

    def one_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        out, top = _open_folder(folder)
        tmp = f"{top}/_shard-{shard:06d}.{uuid.uuid4().hex}"
        offsets = array("Q", [0])
        with out.open_output_stream(tmp, buffer_size=1 << 20) as f:
            batch: pa.RecordBatch | None = first
            while batch is not None:
                begun = len(offsets) - 1
                for text in batch.column(1):
                    ids = enc.encode(text.as_py())
                    f.write(ids)
                    f.write(end)
                    offsets.append(offsets[-1] + len(ids) // enc.width + 1)
                o = np.array(offsets[begun:], np.uint64).astype(np.int64)
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(k, shard)), pa.array(np.arange(begun, begun + k)), pa.array(o[:-1]), pa.array(np.diff(o))],
                    ["doc_id", "shard", "ordinal", "offset", "n_tokens"],
                )
                batch = next((b for b in batches if b.num_rows), None)
            f.write(np.frombuffer(offsets, np.uint64).astype("<u8").tobytes())
            f.write(struct.pack(TRAILER, len(offsets) - 1, offsets[-1], enc.width, MAGIC))
        out.move(tmp, f"{top}/shard-{shard:06d}.ids")
        trim()

    manifest = cut(rows.mapInArrow(one_shard, MANIFEST))
    write_index(manifest, folder)
    return manifest


def _shards(rows: DataFrame) -> int:
    """As many as partitions are set, or more where the input is larger than that many shards should hold."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 50:  # no estimate, or a size at which one more look costs little
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def write_index(manifest: DataFrame, folder: str) -> int:
    """Index files of all keys; their number, which is also kept in the folder."""
    keyed = manifest.where(F.col("doc_id").isNotNull())
    buckets = max(1, -(-keyed.count() // KEYS_PER_BUCKET))
    keys = keyed.groupBy("doc_id").agg(F.min(F.struct("shard", "ordinal", "offset", "n_tokens")).alias("at"), F.count(F.lit(1)).alias("rows"))
    keys = keys.select(F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"), "doc_id", "at.*", "rows")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["doc_id"].to_numpy(np.int64).view(np.uint64)
        mph = PerfectHash.build(ids)
        slots = np.zeros(len(ids), SLOT)
        at = mph.find(ids)
        for field, column in (("shard", "shard"), ("ordinal", "ordinal"), ("rows", "rows"), ("offset", "offset"), ("n", "n_tokens")):
            slots[field][at] = pdf[column].to_numpy()
        slots["fp"][at] = fingerprint(ids)
        bucket = int(pdf["bucket"].iloc[0])
        _put(folder, f"index-{bucket:06d}.mph", lambda f: (f.write(mph.dump()), f.write(slots.tobytes())))
        return pd.DataFrame({"bucket": [bucket], "keys": [len(ids)]})

    keys.groupBy("bucket").applyInPandas(build, "bucket long, keys long").agg(F.sum("keys")).collect()
    _put(folder, "buckets", lambda f: f.write(str(buckets).encode()))
    return buckets


def n_buckets(folder: str) -> int:
    where, top = _open_folder(folder)
    with where.open_input_stream(f"{top}/buckets") as f:
        return int(f.read())


def _slots(folder: str, bucket: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, slots) of the keys of one bucket."""
    where, top = _open_folder(folder)
    name = f"{top}/index-{bucket:06d}.mph"
    if where.get_file_info(name).type == fs.FileType.NotFound:
        return np.zeros(len(ids), bool), np.zeros(len(ids), SLOT)
    with where.open_input_stream(name) as f:
        mph = PerfectHash.load(f)
        slots = np.frombuffer(f.read(), SLOT)
    keys = ids.astype(np.int64).view(np.uint64)
    at = mph.find(keys)
    got = slots[np.maximum(at, 0)]
    return (at >= 0) & (got["fp"] == fingerprint(keys)), got


def get(folder: str, doc_id: int) -> list[np.ndarray]:
    """The id arrays of a key: one for each row that had it; none if it is absent."""
    where, top = _open_folder(folder)
    name = f"{top}/index-{bucket_of(doc_id, n_buckets(folder)):06d}.mph"
    if where.get_file_info(name).type == fs.FileType.NotFound:
        return []
    key = np.array([doc_id], np.int64).view(np.uint64)
    with where.open_input_file(name) as f:
        slot, slots = find_in_file(f, int(key[0]))
        if slot < 0:
            return []
        f.seek(slots + slot * SLOT.itemsize)
        s = np.frombuffer(f.read(SLOT.itemsize), SLOT)[0]
    if s["fp"] != fingerprint(key)[0]:
        return []
    with where.open_input_file(f"{top}/shard-{int(s['shard']):06d}.ids") as f:
        n_docs, n_ids, width = _trailer(f)
        f.seek(n_ids * width + int(s["ordinal"]) * 8)
        o = np.frombuffer(f.read((int(s["rows"]) + 1) * 8), "<u8").astype(np.int64)
        f.seek(int(s["offset"]) * width)
        ids = np.frombuffer(f.read(int(o[-1] - o[0]) * width), "<u2" if width == 2 else "<u4")
        return [ids[a - o[0] : b - o[0]].astype(np.uint32) for a, b in zip(o[:-1], o[1:], strict=True)]


def _trailer(f) -> tuple[int, int, int]:
    f.seek(f.size() - struct.calcsize(TRAILER))
    n_docs, n_ids, width, magic = struct.unpack(TRAILER, f.read(struct.calcsize(TRAILER)))
    if magic != MAGIC:
        raise ValueError("not an id shard")
    return n_docs, n_ids, width


def locate(keys: DataFrame, folder: str) -> DataFrame:
    """doc_id, shard, ordinal of every stored row of the (distinct) keys, through the index."""
    buckets = n_buckets(folder)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        found, s = _slots(folder, int(pdf["bucket"].iloc[0]), pdf["doc_id"].to_numpy(np.int64))
        ids, s = pdf["doc_id"].to_numpy(np.int64)[found], s[found]
        times = s["rows"].astype(np.int64)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        return pd.DataFrame({"doc_id": np.repeat(ids, times), "shard": np.repeat(s["shard"].astype(np.int64), times), "ordinal": np.repeat(s["ordinal"].astype(np.int64), times) + step})

    keyed = keys.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).distinct()
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    # chunks of a bucket: each opens the index file, none holds more than its share
    keyed = keyed.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit("chunk")), F.lit(16)))
    return keyed.groupBy("bucket", "chunk").applyInPandas(find, "doc_id long, shard long, ordinal long")


def shard_starts(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """shard, before: ids of all shards before it, from the trailers; and how many shards there are. One row for each file."""
    where, top = _open_folder(folder)
    names = sorted(x.path for x in where.get_file_info(fs.FileSelector(top)) if x.base_name.startswith("shard-"))

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, _ = _open_folder(folder)
        for pdf in batches:
            n = []
            for name in pdf["name"]:
                with where.open_input_file(name) as f:
                    n.append(_trailer(f)[1])
            yield pd.DataFrame({"name": pdf["name"], "n": np.array(n, np.int64)})

    few = max(1, -(-len(names) // 256))
    listed = spark.createDataFrame([(x,) for x in names], "name string").repartition(few).mapInPandas(sizes, "name string, n long").collect()
    rows, before = [], 0
    for name, n in sorted(tuple(r) for r in listed):
        rows.append((int(name.rsplit("-", 1)[1].split(".")[0]), before))
        before += n
    return spark.createDataFrame(rows, "shard long, before long"), len(rows)


def read_back(places: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows at (shard, ordinal), from the shard files, each read once in order."""

    def one_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ordinal")
        where, top = _open_folder(folder)
        with where.open_input_file(f"{top}/shard-{int(pdf['shard'].iloc[0]):06d}.ids") as f:
            n_docs, n_ids, width = _trailer(f)
            f.seek(n_ids * width)
            offsets = np.frombuffer(f.read((n_docs + 1) * 8), "<u8").astype(np.int64)
            o = pdf["ordinal"].to_numpy()
            lo, hi = offsets[o], offsets[o + 1]
            crcs, at, run, block = [], -1, b"", 1 << 20
            for a, b in zip((lo * width).tolist(), (hi * width).tolist(), strict=True):
                if not (at <= a and b <= at + len(run)):
                    f.seek(a)
                    at, run = a, f.read(max(b - a, block))
                ids = np.frombuffer(run, "<u2" if width == 2 else "<u4", (b - a) // width, a - at)
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        return pd.DataFrame({"doc_id": pdf["doc_id"], "shard": pdf["shard"], "start": lo, "n_tokens": hi - lo, "ids_crc32": np.array(crcs, np.int64)})

    read = places.groupBy("shard").applyInPandas(one_shard, "doc_id long, shard long, start long, n_tokens long, ids_crc32 long")
    starts, n = shard_starts(places.sparkSession, folder)
    return read.join(broadcast_if_small(starts, n), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def remove(folder: str) -> None:
    where, top = _open_folder(folder)
    where.delete_dir(top)


def write_and_read_back(docs: DataFrame, folder: str, tokenizer: str | None = None) -> DataFrame:
    """Write all documents, then find and read all of them again: keyed rows through the index, the others by their place."""
    manifest = write(docs, folder, tokenizer)
    keyed = locate(manifest.select("doc_id"), folder)
    unkeyed = manifest.where(F.col("doc_id").isNull()).select("doc_id", "shard", "ordinal")
    return read_back(keyed.unionByName(unkeyed), folder)
