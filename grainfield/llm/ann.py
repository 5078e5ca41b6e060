"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted by k-means on a bounded sample of the vectors, a list that draws more than its share being split in
two until all are balanced. A proximity graph over the centroids, held in memory, is searched best-first, a batch of vectors
in step. Every vector goes into the list of its nearest centroid and, if it lies near a boundary, into those of further
centroids within `replicate` times that distance whose direction the chosen ones do not cover already. A query visits all
lists whose centroids are within a ratio of its nearest one's distance. That ratio is measured, not guessed: for a bounded
sample of queries the true neighbours are found by going through all vectors, and the ratio is the one that reaches the
wanted share of them. Largest inner product becomes nearest neighbour by one extra coordinate that gives all vectors
the same length.

Lists are dealt in pieces of bounded size, neighbouring lists share a shard, and the queries that ask a shard come in
blocks, so a list that holds a third of all vectors is searched by many tasks and a vector is copied once for each block of
queries that ask its shard; each task returns the k best of a shard for a query, scored in double precision on the
original vectors. Only the centroids, at most `MOST_LISTS` of them, are sent to every task.

Bounds: the fit sees SAMPLE vectors for each list it makes, up to SAMPLE * MOST_LISTS; beyond PER_LIST * MOST_LISTS
vectors the lists grow longer instead of more numerous. Every vector is indexed at every size.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do those of another length than the most frequent one (ties: the shortest). Rows with null vec_id take no part. Of rows that
repeat a vec_id the one with the least vector (by components) takes part. Queries with fewer candidates get all;
a query whose lists hold fewer than k gets them from all lists. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfield.llm.common import cut, ship

#: Fit: vectors of the sample for each list (at least LEAST_SAMPLE in all), vectors for each list of the whole table, most
#: lists, rounds of k-means.
SAMPLE, LEAST_SAMPLE = 8, 20_000
PER_LIST = 256
MOST_LISTS = 16_384
ROUNDS = 12
#: Assignment and search: lists a vector may be in, and within which distance ratio; lists a query visits at least;
#: queries that the pruning ratio is measured on, and the share of their neighbours that it has to reach.
REPLICAS, REPLICATE = 4, 1.10
LEAST_PROBES = 8
MEASURED, WANTED = 128, 0.94
#: Graph: neighbours of a centroid, breadth of the best-first search, centroids that it goes on from at once, vectors in step.
DEGREE, BREADTH, STRIDE, STEP = 16, 96, 8, 512
#: Vectors of a piece of a list, postings of a shard (pieces that one task searches together), queries of a block.
PIECE, SHARD, BLOCK = 2_048, 16_384, 4_096


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the n nearest rows of c for each row of x."""
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)
    n = min(n, len(c))
    i = np.argpartition(d, n - 1, axis=1)[:, :n]
    v = np.take_along_axis(d, i, 1)
    o = np.lexsort((i, v), axis=1)
    return np.take_along_axis(i, o, 1), np.take_along_axis(v, o, 1)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """K-means whose overfull lists are split: no list of the sample has over twice its share, but for equal vectors."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)].astype(np.float64)
    for step in range(rounds):
        own = np.concatenate([_nearest(x[i : i + 4096], c, 1)[0][:, 0] for i in range(0, len(x), 4096)])
        n = np.bincount(own, minlength=len(c))
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(own, x[:, j], len(c)) / np.maximum(n, 1), c[:, j])
        if step + 3 < rounds:
            # the emptiest centroids move into the fullest lists, one to each
            full = [k for k in np.argsort(-n, kind="stable") if n[k] > 2 * len(x) / len(c)]
            spare = [k for k in np.argsort(n, kind="stable") if n[k] < 0.4 * len(x) / len(c)]
            for a, b in zip(full, spare, strict=False):
                rows = np.flatnonzero(own == a)
                c[b] = x[rng.choice(rows)]
    return np.unique(c, axis=0)


def neighbouring(c: np.ndarray) -> np.ndarray:
    """The rows of c in an order that keeps near ones together: halves by the widest coordinate, again and again."""
    out: list[np.ndarray] = []
    todo = [np.arange(len(c))]
    while todo:
        i = todo.pop()
        if len(i) <= 2:
            out.append(i)
            continue
        i = i[np.argsort(c[i, c[i].var(axis=0).argmax()], kind="stable")]
        todo += [i[len(i) // 2 :], i[: len(i) // 2]]
    return np.concatenate(out) if out else np.zeros(0, int)


class Graph:
    """Neighbour graph of centroids, searched best-first for many vectors in step."""

    def __init__(self, c: np.ndarray, degree: int = DEGREE):
        self.c, self.norm, n = c, (c * c).sum(axis=1), len(c)
        near = [_nearest(c[i : i + 1024], c, degree + 1)[0] for i in range(0, n, 1024)]
        near = np.concatenate(near) if n else np.zeros((0, 1), int)
        links: list[list[int]] = [[int(j) for j in row if j != i] for i, row in enumerate(near)]
        # as many links back, those of the nearest first, and a ring through all, so that no part is cut off
        for rank in range(near.shape[1]):
            for i in range(n):
                j = int(near[i, rank])
                if j != i and len(links[j]) < 2 * degree:
                    links[j].append(i)
        for i in range(n if n > 1 else 0):
            links[i].append((i + 1) % n)
            links[(i + 1) % n].append(i)
        width = max([len(set(x)) for x in links], default=0)
        self.links = np.full((n, width), -1, np.int64)
        for i, row in enumerate(links):
            row = sorted(set(row))
            self.links[i, : len(row)] = row
        self.starts = np.unique(np.linspace(0, max(0, n - 1), min(n, 32)).astype(int)) if n else np.zeros(0, int)

    def _search(self, q: np.ndarray, n: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        if breadth >= len(self.c):  # the beam holds every centroid
            return _nearest(q, self.c, n)
        rows, qq = len(q), (q * q).sum(axis=1)
        place = np.full((rows, breadth), -1, np.int64)
        dist = np.full((rows, breadth), np.inf)
        gone = np.zeros((rows, breadth), bool)
        seen = np.zeros((rows, len(self.c)), bool)
        s = self.starts[:breadth]
        first = np.maximum(qq[:, None] - 2 * q @ self.c[s].T + self.norm[s][None], 0)
        o = np.argsort(first, axis=1, kind="stable")
        place[:, : len(s)], dist[:, : len(s)] = s[o], np.take_along_axis(first, o, 1)
        seen[:, s] = True
        open_ = np.arange(rows)
        while len(open_):
            # the nearest that were not gone on from yet
            used = gone[open_] | (place[open_] < 0)
            pick = np.argsort(used, axis=1, kind="stable")[:, :STRIDE]
            free = ~np.take_along_axis(used, pick, 1)
            some = free.any(axis=1)
            open_, pick, free = open_[some], pick[some], free[some]
            if not len(open_):
                break
            at = open_[:, None]
            gone[at, pick] |= free
            new = np.where(free[:, :, None], self.links[place[at, pick]], -1).reshape(len(open_), -1)
            new.sort(axis=1)
            fresh = new >= 0
            fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
            fresh &= ~seen[at, np.maximum(new, 0)]
            r, k = np.nonzero(fresh)
            j = new[r, k]
            seen[open_[r], j] = True
            d = np.full(new.shape, np.inf)
            d[r, k] = np.maximum(qq[open_[r]] - 2 * np.einsum("ij,ij->i", q[open_[r]], self.c[j]) + self.norm[j], 0)
            all_d = np.concatenate([dist[open_], d], axis=1)
            all_p = np.concatenate([place[open_], np.where(fresh, new, -1)], axis=1)
            all_g = np.concatenate([gone[open_], np.zeros(new.shape, bool)], axis=1)
            o = np.argsort(all_d, axis=1, kind="stable")[:, :breadth]
            dist[open_], place[open_], gone[open_] = (np.take_along_axis(x, o, 1) for x in (all_d, all_p, all_g))
        return place[:, :n], dist[:, :n]

    def search(self, q: np.ndarray, n: int, breadth: int = BREADTH) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and squared distances of about the n nearest (or all) of each row, nearest first."""
        n = min(n, len(self.c))
        parts = [self._search(q[i : i + STEP], n, max(breadth, n)) for i in range(0, len(q), STEP)]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros((0, n), int), np.zeros((0, n)))

    def within(self, q: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of all within `ratio` times the least distance, and of `least` at any rate."""
        n, rows, out = max(least, BREADTH), np.arange(len(q)), [(np.zeros(0, int), np.zeros(0, int))]
        while len(rows):
            place, d = self.search(q[rows], n)
            bound = d[:, 0] * ratio * ratio
            settled = (d[:, -1] > bound) | (n >= len(self.c))
            wanted = (np.arange(d.shape[1])[None] < least) | (d <= bound[:, None])
            r, k = np.nonzero(wanted & settled[:, None] & (place >= 0))
            out.append((rows[r], place[r, k]))
            rows, n = rows[~settled], 4 * n
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def lists_of(self, v: np.ndarray, replicate: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of the lists that vectors go into."""
        place, d = self.search(v, 2 * REPLICAS, 32)
        chosen = np.zeros(place.shape, bool)
        for r in range(place.shape[1]):
            fine = (place[:, r] >= 0) & (d[:, r] <= d[:, 0] * replicate * replicate + 1e-12) & (chosen.sum(axis=1) < REPLICAS)
            # not if a chosen centroid lies nearer to this one than the vector does
            for s in range(r):
                apart = ((self.c[place[:, r]] - self.c[place[:, s]]) ** 2).sum(axis=1)
                fine &= ~chosen[:, s] | (apart > d[:, r])
            chosen[:, r] = fine
        at, k = np.nonzero(chosen)
        return at, place[at, k]


def _candidates(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, product) of pairs that hold the k best of each query, ties at the edge by least id."""
    s = q @ c.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    if len(c) > k:
        bar = np.partition(s, len(c) - k, axis=1)[:, len(c) - k]
        # the product of a block may differ in the last digits
        slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(bar), bar, 0.0)))
        sure, edge = s > (bar + slack)[:, None], np.abs(s - bar[:, None]) <= slack[:, None]
        # of candidates as good as the k-th, k of least id are enough
        order = np.argsort(ids, kind="stable")
        edge[:, order] &= np.cumsum(edge[:, order], axis=1) <= 2 * k
        a, b = np.nonzero((sure | edge) & (s > -np.inf))
    else:
        a, b = np.nonzero(s > -np.inf)
    return a, b, s[a, b]


def _ranked(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, by (query, falling score, id)."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def _best(q: np.ndarray, q_ids: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k best distinct ids among candidate pairs, scored pair by pair."""
    a, c, s = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    once = np.lexsort((ids[c], a))
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a[once]) != 0) | (np.diff(ids[c][once]) != 0)
    a, c, s = a[once][new], c[once][new], s[once][new]
    order = np.lexsort((-s, a))
    a, c, s = a[order], c[order], s[order]
    start = np.searchsorted(a, a)
    last = np.minimum(start + k - 1, np.searchsorted(a, a, side="right") - 1)
    keep = s >= s[last] - 1e-9 * np.maximum(1.0, np.abs(s[last])) if len(s) else np.zeros(0, bool)
    a, c = a[keep], c[keep]
    score = np.concatenate([(v[c[i : i + 65_536]] * q[a[i : i + 65_536]]).sum(axis=1) for i in range(0, len(a), 65_536)]) if len(a) else np.zeros(0)
    top = _ranked(a, ids[c], score, k)
    return a[top], ids[c[top]], score[top]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    kind = "array<float>" if dict(vectors.dtypes)[column] == "array<float>" else "array<double>"
    v = F.col(column).cast(kind)
    fine = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(F.col("v"), lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)


@dataclass
class Index:
    """rows: vec_id, v; postings: list, vec_id, v; longest: the largest squared length of a vector."""

    rows: DataFrame
    postings: DataFrame
    centroids: Broadcast
    n: int
    dim: int
    longest: float

    def ratio(self, queries: DataFrame, k: int, wanted: float = WANTED) -> float:
        """The distance ratio within which a measured share of true neighbours have a list."""
        picked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).toArrow()
        if not picked.num_rows:
            return 1.0
        dim = self.dim
        own = picked["vec_id"].to_numpy()
        x = _matrix(picked["v"].combine_chunks(), dim)

        def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
            for b in batches:
                ids, c = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), dim)
                found = _best(x, own, [_candidates(x, own, c, ids, k)], c, ids, k)
                both = [np.concatenate(p) for p in zip(best, found, strict=True)]
                top = _ranked(*both, k)
                best = tuple(p[top] for p in both)
            yield pa.RecordBatch.from_arrays([pa.array(p) for p in best], ["q", "vec_id", "score"])

        w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        found = self.rows.mapInArrow(true, "q long, vec_id long, score double").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
        # at most MEASURED * k rows, times the lists of a vector
        at = self.postings.select("vec_id", "list").join(F.broadcast(found.select("q", "vec_id")), "vec_id").toPandas()
        if not len(at):
            return 1.0
        z, c = np.hstack([x, np.zeros((len(x), 1))]), self.centroids.value
        d = np.sqrt(np.maximum((z * z).sum(1)[:, None] - 2 * z @ c.T + (c * c).sum(1)[None], 0))
        need = pd.Series(d[at["q"], at["list"]] / np.maximum(d.min(axis=1)[at["q"]], 1e-12)).groupby([at["q"], at["vec_id"]]).min()
        return float(np.quantile(need, wanted)) * (1 + 1e-9)

    def asked(self, queries: DataFrame, ratio: float) -> DataFrame:
        """list, vec_id: the lists that each query (vec_id, v) visits."""
        centroids, dim = self.centroids, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = _graph(centroids)
            for b in batches:
                v = _matrix(b.column(1), dim)
                at, to = g.within(np.hstack([v, np.zeros((len(v), 1))]), ratio, LEAST_PROBES)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), b.column(0).take(pa.array(at, pa.int64()))], ["list", "vec_id"])

        return queries.mapInArrow(run, "list long, vec_id long")

    def search(self, asked: DataFrame, k: int) -> DataFrame:
        """query_id, rank, vec_id, score: the k best in the lists that each query asks."""
        spark = self.rows.sparkSession
        # at most MOST_LISTS rows: where each list begins when neighbouring ones lie side by side
        sizes = {r["list"]: r["count"] for r in self.postings.groupBy("list").count().collect()}
        before, at = [], 0
        for j in neighbouring(self.centroids.value).tolist():
            if j in sizes:
                before.append((j, -(-sizes[j] // PIECE), at))
                at += sizes[j]
        lists = F.broadcast(spark.createDataFrame(before, "list long, pieces int, at long"))
        shard = F.floor((F.col("at") + F.col("piece") * PIECE) / SHARD).cast("int").alias("shard")
        unit = F.struct("list", "piece")
        p = self.postings.join(lists, "list").withColumn("piece", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("pieces")).cast("int"))
        p = p.select(shard, F.array(F.xxhash64(unit)).alias("units"), "vec_id", "v")
        q = asked.join(lists, "list").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        q = q.select(shard, "vec_id", F.xxhash64(unit).alias("unit")).groupBy("shard", "vec_id").agg(F.collect_set("unit").alias("units"))  # a shard's pieces at most
        q = cut(q)
        # one row for each shard; joined by a shuffle where there are many
        blocks = q.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        q = q.join(self.rows, "vec_id").join(blocks, "shard").select("shard", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")).cast("int").alias("block"), "units", "vec_id", "v", F.lit(True).alias("q"))
        p = p.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "units", "vec_id", "v", F.lit(False).alias("q"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            is_q = pdf["q"].to_numpy(bool)
            ids = pdf["vec_id"].to_numpy(np.int64)
            v = np.stack(pdf["v"].to_numpy()).astype(np.float64)  # a shard and a block at most
            units = pdf["units"].to_numpy()
            times = np.array([len(u) for u in units])
            row, unit = np.repeat(np.arange(len(ids)), times), np.concatenate(units)
            order = np.argsort(unit, kind="stable")
            parts = []
            for group in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
                r = row[group]
                qs, c = r[is_q[r]], r[~is_q[r]]
                if len(qs) and len(c):
                    a, b, s = _candidates(v[qs], ids[qs], v[c], ids[c], k)
                    parts.append((qs[a], c[b], s))
            a, found, score = _best(v, ids, parts, v, ids, k)
            return pd.DataFrame({"query_id": ids[a], "vec_id": found, "score": score})

        best = p.unionByName(q).groupBy("shard", "block").applyInPandas(run, "query_id long, vec_id long, score double")
        best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.select("query_id", F.row_number().over(w).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


_GRAPHS: dict[int, Graph] = {}


def _graph(centroids: Broadcast) -> Graph:
    """One for each worker and index."""
    key = id(centroids.value)
    if key not in _GRAPHS:
        _GRAPHS.clear()
        _GRAPHS[key] = Graph(centroids.value)
    return _GRAPHS[key]


def index(vectors: DataFrame, column: str = "embedding", per_list: int = PER_LIST, replicate: float = REPLICATE) -> Index | None:
    """The index of all vectors that take part; None without any."""
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(usable(vectors, column))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    n, longest, dim = size["n"], size["m"], size["d"]
    if not n:
        return None
    lists = int(min(MOST_LISTS, max(1, n // per_list)))
    # a bounded sample by the order of a hash
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(LEAST_SAMPLE, SAMPLE * lists)).select("v").toArrow()

    def longer(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]])

    x = longer(_matrix(picked["v"].combine_chunks(), dim))
    centroids = spark.sparkContext.broadcast(balanced_centroids(x, min(lists, max(1, len(x) // SAMPLE))))
    del x, picked

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _graph(centroids)
        for b in batches:
            at, to = g.lists_of(longer(_matrix(b.column(1), dim)), replicate)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), b.column(0).take(take), b.column(1).take(take)], ["list", "vec_id", "v"])

    postings = cut(rows.mapInArrow(posted, f"list long, vec_id long, v {dict(rows.dtypes)['v']}"))
    return Index(rows, postings, centroids, n, dim, longest)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, column: str = "embedding", wanted: float = WANTED, replicate: float = REPLICATE) -> DataFrame:
    """query_id, rank, vec_id, score: the k found for each vector whose vec_id is divisible by `every`."""
    built = index(vectors, column, replicate=replicate)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = built.rows.where(F.col("vec_id") % every == 0)
    asked = cut(built.asked(queries, built.ratio(queries, k, wanted)))
    found = cut(built.search(asked, k))
    # queries that came out short look into every list
    full = found.where(F.col("rank") == min(k, built.n - 1)).select(F.col("query_id").alias("vec_id"))
    short = cut(asked.select("vec_id").distinct().join(full, "vec_id", "left_anti"))
    if built.n > 1 and not short.isEmpty():
        every_list = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(built.centroids.value) - 1).cast("long")))
        again = built.search(short.select(every_list.alias("list"), "vec_id"), k)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found
