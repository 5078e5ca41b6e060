"""MinHash near-dedup: circulant MinHash, banding, and confirmation on the full shingle sets.

Words of the text (A-Z lower-cased) make five-word shingles. A first fixed permutation scatters the shingle hashes over
2^32 places; the second, shifted circularly by k, gives coordinate k of the signature as its minimum: two
permutations make all coordinates. Equal sets are one node (their group key is a 128-bit hash of the set). Nodes
that agree in all rows of a band share a bucket; each is compared with the bucket's least id, on full sets. Members of
a bucket that are still in different components are settled in blocks: those outside the bucket's main component against
all others, so no link between different texts is lost and a group of near copies costs its size times its outsiders.
Components come from label propagation with pointer jumping; nothing of it passes through the driver.

Hot keys: a bucket's size and least id come from a partial aggregate and are joined back, which Spark splits where a bucket
is large; a node with many partners meets them in blocks, each of which gets its set once. Blocks are bounded by the shingles
that they hold, and a task takes blocks of as many shingles in all. The one step that a count chooses is how the texts of
documents that share a bucket are picked out: by a broadcast of up to MEMBERS ids, else by a shuffle.

Defined results: one row for each input row. A null or blank text has no shingles and is linked with nothing. Fewer words
than a shingle make one shingle. Rows that repeat a doc_id are one document. A row with null doc_id is linked
with nothing: component_id null, kept. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfield.llm.common import DOCS_PER_FILE, arrow_rows, broadcast_if_small, cut, ship, trim
from grainfield.session import without_statistics

SHINGLE = 5
#: Links: PERCENT * union <= 100 * intersection.
PERCENT = 75
#: A pair at the least similarity meets in no bucket with a chance of (1 - 0.75^4)^36 = 1e-6.
BANDS, ROWS = 36, 4
#: Documents of a block when a bucket is settled: outsiders, and those that they are compared with.
OUTSIDERS, OTHERS = 128, 512
#: Shingles (8 bytes each) of a block, over which a longer set goes alone.
BUDGET = 500_000
#: Documents that share a bucket with others: up to so many ids (8 bytes each) go to every task; beyond that, texts are shuffled.
MEMBERS = 1_000_000

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    # bytes.split() cuts at exactly the white space of the word rule
    words = [digest(w) for w in (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()]
    if not words:
        return np.zeros(0, np.uint64)
    a = np.array(words, np.uint64)
    size = min(size, len(a))
    with np.errstate(over="ignore"):
        h = np.full(len(a) - size + 1, size, np.uint64)
        for j in range(size):
            h = (h ^ a[j : len(a) - size + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(s: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a set of hashes."""
    x = (s * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    step = max(1, 65_536 // max(1, len(x)))
    for part in range(0, len(x), 65_536):
        y0 = x[part : part + 65_536]
        for i in range(0, k, step):
            shift = np.arange(i, min(k, i + step), dtype=np.uint32)
            y = y0[None, :] + shift[:, None]
            y ^= y >> np.uint32(16)
            y *= np.uint32(0x85EBCA6B)
            y ^= y >> np.uint32(13)
            y *= np.uint32(0xC2B2AE35)
            y ^= y >> np.uint32(16)
            np.minimum(out[i : i + step], y.min(axis=1), out=out[i : i + step])
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash for each band of a signature, the band's number being part of it."""
    with np.errstate(over="ignore"):
        h = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for part in sig.reshape(bands, rows).astype(np.uint64).T:
            h = (h ^ part) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, f0, f1 (hash of the set), keys (of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f, keys = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py())
                n.append(len(s))
                f.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                keys.append(band_keys(signature(s)) if len(s) else None)
            f = np.array(f, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "f0", "f1", "keys"])
        trim()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, f0 long, f1 long, keys array<long>")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, s (sorted hashes) of the documents with the given ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["id", "s"])
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.join(broadcast_if_small(ids, limit=MEMBERS), "id", "left_semi").mapInArrow(run, "id long, s binary")


def _common(a: np.ndarray, values: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many elements of the sorted set a each of the sets has that lie side by side in values."""
    at = np.minimum(np.searchsorted(a, values), len(a) - 1)
    hits = np.concatenate([[0], np.cumsum(a[at] == values)])
    return hits[ends] - hits[ends - size]


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b, n of b) that are links, on full sets."""
    sizes = pairs.groupBy("a").agg(F.sum("n").alias("n"))
    tasks = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // BUDGET))
    blocks = sizes.select("a", F.ceil(F.col("n") / BUDGET).cast("int").alias("blocks"))
    # a leader's blocks are dealt over the tasks by themselves
    task = F.pmod(F.xxhash64("a", "block"), F.lit(tasks)).cast("int").alias("task")
    partners = pairs.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    leaders = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = partners.select(task, "a", F.col("b").alias("id"), F.lit(False).alias("leads")).unionByName(leaders.select(task, "a", F.col("a").alias("id"), F.lit(True).alias("leads")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("a", kind="stable")
        leader, ids, leads = pdf["a"].to_numpy(), pdf["id"].to_numpy(), pdf["leads"].to_numpy(bool)
        arrays = [np.frombuffer(s, np.uint64) for s in pdf["s"]]
        out = []
        for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(leader)) + 1):
            first, r = part[leads[part]], part[~leads[part]]
            if not len(r):
                continue
            size = np.array([len(arrays[i]) for i in r])
            values, ends = np.concatenate([arrays[i] for i in r]), np.cumsum(size)
            for a in (arrays[i] for i in first):  # several texts of one id are one document
                common = _common(a, values, ends, size) if len(a) else np.zeros(len(r), int)
                out.append(r[100 * common >= PERCENT * (size + len(a) - common)] if len(a) else r[:0])
        at = np.concatenate(out) if out else np.zeros(0, int)
        found = pd.DataFrame({"a": leader[at], "b": ids[at]})
        del arrays
        trim()
        return found

    return rows.join(sets, "id").groupBy("task").applyInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, rows: int | None = None, most_rounds: int = 50) -> DataFrame:
    """node, label (the least node reachable) of all nodes of a, b pairs; rows: about how many nodes there may be."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.where(F.col("a") != F.col("b")).distinct(), rows)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), rows)
    for _ in range(most_rounds):
        at = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        near = both.join(at, "b").groupBy("a").agg(F.min("lb").alias("near"))
        seen = labels.join(near, F.col("node") == F.col("a"))
        # a root moves under the least label that any of its nodes sees
        hook = seen.groupBy(F.col("label").alias("root")).agg(F.min("near").alias("hook"))
        moved = seen.join(hook, F.col("label") == F.col("root")).select("node", F.col("label").alias("old"), F.least("label", "near", "hook").alias("label"))
        moved = without_statistics(cut(moved, rows))
        jump = moved.select(F.col("node").alias("_n"), F.col("label").alias("_up"))
        new = without_statistics(cut(moved.join(jump, F.col("label") == F.col("_n"), "left").select("node", F.least("label", F.coalesce("_up", "label")).alias("label"), "old"), rows))
        changed = new.where(F.col("label") != F.col("old")).limit(1).count()
        labels = new.drop("old")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels


def _settle(open_: DataFrame, sets: DataFrame, count: int) -> DataFrame:
    """Links between members of different components that share a bucket. open_: bucket, id, n, label of buckets with several."""
    per = open_.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    # the main component of each bucket names the group in which its outsiders are settled
    main = per.groupBy("bucket").agg(F.max("k").alias("top")).join(per, "bucket").where(F.col("k") == F.col("top")).groupBy("bucket").agg(F.min("label").alias("main"))
    rows = open_.join(main, "bucket").select("main", "id", "n", "label").distinct()
    rows = cut(rows.withColumn("outside", F.col("label") != F.col("main")), count)
    out_n = F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0))
    sizes = rows.groupBy("main").agg(F.count(F.lit(1)).alias("all"), F.sum("n").alias("n"), F.sum(F.col("outside").cast("long")).alias("out"), out_n.alias("out_n"))
    parts = lambda k, most, n: F.greatest(F.ceil(F.col(k) / most), F.ceil(F.col(n) / BUDGET)).cast("int")
    sizes = sizes.select("main", F.when(F.col("out") > 0, parts("out", OUTSIDERS, "out_n")).otherwise(0).alias("outs"), parts("all", OTHERS, "n").alias("alls"))
    placed = rows.join(sizes, "main").where(F.col("outs") > 0).withColumns({"o": F.pmod(F.xxhash64("id", F.lit(1)), F.col("outs")).cast("int"), "p": F.pmod(F.xxhash64("id", F.lit(2)), F.col("alls")).cast("int")})
    lefts = placed.where("outside").select("main", "id", "label", F.col("o"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("p"), F.lit(True).alias("left"))
    rights = placed.select("main", "id", "label", F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("o"), "p", F.lit(False).alias("left"))
    blocks = lefts.unionByName(rights).join(sets, "id")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = [np.frombuffer(s, np.uint64) for s in pdf["s"]]
        size = np.array([len(a) for a in arrays])
        ids, label, left = pdf["id"].to_numpy(), pdf["label"].to_numpy(), pdf["left"].to_numpy(bool)
        r = np.flatnonzero(~left)
        out: list[tuple[int, int]] = []
        if len(r):
            values = np.concatenate([arrays[i] for i in r])
            ends = np.cumsum(size[r])
            for i in np.flatnonzero(left):
                a = arrays[i]
                fits = (label[r] != label[i]) & (100 * np.minimum(size[r], size[i]) >= PERCENT * np.maximum(size[r], size[i]))
                if not fits.any() or not len(a):
                    continue
                common = _common(a, values, ends, size[r])
                ok = fits & (100 * common >= PERCENT * (size[r] + size[i] - common))
                out += [(int(ids[i]), int(ids[j])) for j in r[ok]]
        del arrays
        trim()
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return blocks.groupBy("main", "o", "p").applyInPandas(block, "a long, b long").distinct()


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    ship(docs.sparkSession)
    with arrow_rows(docs.sparkSession, 1_000):
        return _near_dedup(docs)


def _near_dedup(docs: DataFrame) -> DataFrame:
    n_docs = docs.count()
    signed = cut(_signed(docs), n_docs, DOCS_PER_FILE)
    # equal sets are one node, named by its least doc_id
    filled = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = cut(filled.groupBy("f0", "f1").agg(F.min("doc_id").alias("rep")), n_docs)
    n_nodes = nodes.count()
    named = nodes.select(F.col("rep").alias("doc_id"), "f0", "f1")
    reps = filled.join(named, ["doc_id", "f0", "f1"], "left_semi").select(F.col("doc_id").alias("id"), "n", "keys")
    reps = cut(reps, n_nodes, DOCS_PER_FILE)
    banded = reps.select("id", "n", F.explode("keys").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("k")).where(F.col("k") >= 2).select("bucket", "lead")
    members = cut(banded.join(shared, "bucket"), BANDS * n_nodes, BANDS * DOCS_PER_FILE)
    sets = cut(_sets(docs, cut(members.select("id").distinct(), n_nodes)), n_nodes, DOCS_PER_FILE)
    pairs = cut(members.where(F.col("id") != F.col("lead")).select(F.col("lead").alias("a"), F.col("id").alias("b"), "n").distinct(), n_nodes)
    links = cut(_compared(pairs, sets), n_nodes)
    first = components(links, n_nodes)
    labelled = members.join(first, F.col("id") == F.col("node"), "left").select("bucket", "id", "n", "lead", F.coalesce("label", "id").alias("label"))
    labelled = cut(labelled, BANDS * n_nodes, BANDS * DOCS_PER_FILE)
    # all but the leader, whose pairs are known, are in one component: nothing is open
    state = labelled.where(F.col("id") != F.col("lead")).groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") != F.col("hi"))
    open_ = labelled.where(F.col("id") != F.col("lead")).join(state.select("bucket"), "bucket", "left_semi").select("bucket", "id", "n", "label")
    more = cut(_settle(cut(open_, n_nodes), sets, n_nodes), n_nodes)
    final = components(links.unionByName(more), n_nodes)
    named = nodes.join(final, F.col("rep") == F.col("node"), "left").select("f0", "f1", F.coalesce("label", "rep").alias("component"))
    rows = signed.select("doc_id", "n", "f0", "f1").join(named, ["f0", "f1"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).cast("long")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
