"""Mixing sources to target weights by entropy balancing.

Each document gets a rate r = min(3, exp(lambda_s * size)), the rates nearest to 1 (in relative entropy) under
which its source s takes its target of words. The dual is solved by distributed Newton iterations: each is one aggregate by
source (gradient and curvature of all sources at once) over the histogram of sizes, and one table of a row for each source;
bisection takes over where a step leaves its bracket. Rates are then rounded into whole
copies: the whole part always, one more for the documents lowest in hash / fraction up to a cut-off that is found
by histograms of ever finer bins, so that a source's words come out at its target. At most a copy or two of well
chosen size are added or taken away in the end. All steps are aggregates over narrow rows; nothing depends on the order of
rows. What comes out is a plan of one row for each source, which is applied row by row: texts are never shuffled.

Sources by code point (null last) weigh 1, 2, 3, repeating, and share all words of the corpus; a target stops at
`most` times its source's words, the excess being shared again by weight.

Defined results: one row for each input row. Null or blank texts have size 0 and take 0 words. A null source
is a source. Null or repeated doc_ids are rows like any other. A source without words has target 0. Empty tables
give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfield.functions.rank import positions
from grainfield.llm.common import WORD, broadcast_if_small, cut, held

MOST = 3
WEIGHTS = (1, 2, 3)
#: Newton's method ends when every source is within this share of its target, or after so many steps.
TOLERANCE, NEWTON_STEPS = 1e-8, 100
#: Bits of a document's place among its source's fractions: so many in each round.
BIN_BITS = (12, 12, 12)
TOUCHES = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@dataclass
class Plan:
    """sources: source, source_size, target, scale, tilt, edge; touches: _rid, step, the single copies added or taken away."""

    sources: DataFrame
    touches: DataFrame
    n_sources: int
    most: int

    def applied(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, source, size, _rid and others) with source_size, target, rate, copies, taken; all expressions of a row."""
        at = broadcast_if_small(self.sources.withColumnRenamed("source", "_s"), self.n_sources)
        rated = _rated(rows.join(at, F.col("source").eqNullSafe(F.col("_s"))), self.most)
        step = broadcast_if_small(self.touches.withColumnRenamed("_rid", "_p"), TOUCHES * self.n_sources)
        copies = F.col("_whole") + _more("edge") + F.coalesce("step", F.lit(0))
        done = rated.join(step, F.col("_rid") == F.col("_p"), "left").withColumn("copies", copies.cast("long"))
        return done.withColumn("taken", F.col("copies") * F.col("size")).drop("_s", "_p", "step", "scale", "tilt", "edge", "_whole", "_spot")


def targets(totals: DataFrame, n_sources: int, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of (source, source_size, ...) with k, the place of a source, and its target: the level that shares all words under the caps.

    Resharing the excess is Newton's method on sum(min(cap, level * weight)) = all words: it ends after as many
    rounds as there are distinct sets of capped sources, at most one for each source and mostly two or three.
    """
    placed = positions(totals, F.col("source").asc_nulls_last(), name="k", rows=n_sources).withColumn("k", F.col("k").cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    ranked = held(placed.withColumn("weight", weight), n_sources)
    words, level, cap = 0.0, None, F.col("source_size") * float(most)
    while True:
        full = F.lit(False) if level is None else F.lit(level) * F.col("weight") >= cap
        r = ranked.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap).otherwise(0.0)).alias("capped"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        words = float(r["all"] or 0)
        if not words or not r["w"]:
            break
        new = (words - r["capped"]) / r["w"]
        if level is not None and new <= level * (1 + 1e-14):
            break
        level = new
    target = F.least(cap, F.lit(level or 0.0) * F.col("weight")) if words else F.lit(0.0)
    return ranked.withColumn("target", target.cast("double")).drop("weight")


def _tilts(sizes: DataFrame, goals: DataFrame, most: int, n_sources: int) -> DataFrame:
    """k, tilt: the tilt at which a source's sum of n * size * min(most, exp(tilt * size / scale)) is its target.

    sizes: k, size, n. goals: k, target, source_size, scale, pull (mean size / scale of a word). The constraints touch one
    source each, so the Hessian is diagonal and a Newton step of all of them is one aggregate. Sources that take
    all they can (tilt null) or nothing take no part.
    """
    words, ratio = F.col("source_size"), F.col("target") / F.col("source_size")
    infinite = F.lit(float("inf"))
    state = goals.where((words > 0) & (F.col("target") < words * (most - 1e-9)))
    state = held(state.select("k", "target", "scale", (F.log(ratio) / F.col("pull")).alias("tilt"), (-infinite).alias("lo"), infinite.alias("hi"), F.lit(False).alias("done")), n_sources)
    for _ in range(NEWTON_STEPS):
        if state.where(~F.col("done")).isEmpty():
            break
        open_ = state.where(~F.col("done")).select("k", "scale", "tilt")
        x = F.col("size") / F.col("scale")
        e, w = F.col("tilt") * x, F.col("n") * F.col("size")
        rate = F.exp(F.least(e, F.log(F.lit(float(most)))))
        sums = sizes.join(broadcast_if_small(open_, n_sources), "k").groupBy("k").agg(F.sum(w * rate).alias("got"), F.sum(F.when(e < F.log(F.lit(float(most))), w * rate * x).otherwise(0.0)).alias("slope"))
        both = state.join(broadcast_if_small(sums, n_sources), "k", "left").withColumn("off", F.col("target") - F.col("got"))
        low = F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("lo"))
        high = F.when(F.col("off") > 0, F.col("hi")).otherwise(F.col("tilt"))
        both = both.withColumns({"low": low, "high": high, "new": F.when(F.col("slope") > 0, F.col("tilt") + F.col("off") / F.col("slope"))})
        fine = (F.col("new") > F.col("low")) & (F.col("new") < F.col("high")) & (F.abs(F.col("new") - F.col("tilt")) <= F.greatest(F.lit(4.0), F.abs("tilt")))
        # outside the bracket: doubled while one end is open, halved when both are known
        other = F.when(F.col("high") == infinite, F.greatest(F.lit(1.0), 2 * F.col("tilt"))).when(F.col("low") == -infinite, F.least(F.lit(-1.0), 2 * F.col("tilt"))).otherwise((F.col("low") + F.col("high")) / 2)
        met = F.col("done") | (F.abs("off") <= TOLERANCE * F.col("target")) | (F.col("high") - F.col("low") <= 1e-15 * F.abs("tilt"))
        tilt = F.when(met, F.col("tilt")).when(F.coalesce(fine, F.lit(False)), F.col("new")).otherwise(other)
        state = held(both.select("k", "target", "scale", tilt.alias("tilt"), F.coalesce("low", "lo").alias("lo"), F.coalesce("high", "hi").alias("hi"), met.alias("done")), n_sources)
    return state.select("k", "tilt")


def _rated(rows: DataFrame, most: int) -> DataFrame:
    """rows (doc_id, size, scale, tilt) with rate, its whole part, and the place of the rest."""
    e = F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.log(F.lit(float(most))))
    rate = F.when(F.col("size") == 0, 0.0).when(F.col("tilt").isNull(), F.lit(float(most))).otherwise(F.exp(e))
    # uniform by document, the same in every run
    chance = (F.pmod(F.xxhash64("doc_id", "size", F.lit("mix")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rated = rows.withColumn("rate", rate).withColumn("_whole", F.floor(F.col("rate") + 1e-12).cast("long"))
    part = F.col("rate") - F.col("_whole")
    key = F.when(part > 1e-9, chance / part)
    return rated.withColumn("_spot", F.floor(key / (key + 1.0) * float(1 << sum(BIN_BITS))).cast("long"))


def _more(edge: str) -> Column:
    return F.when(F.col("_spot").isNotNull() & (F.col("_spot") <= F.col(edge)), 1).otherwise(0)


def solve(rows: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> Plan:
    """The plan of a materialised table doc_id, source, size, _rid (distinct)."""
    n_rows = rows.count()
    sizes = cut(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), n_rows)
    words = F.col("size") * F.col("n")
    square = F.sum(words.cast("double") * F.col("size"))
    totals = sizes.groupBy("source").agg(F.sum(words).alias("source_size"), F.sum("n").alias("docs"), square.alias("square"))
    totals = cut(totals, 0)
    n_sources = totals.count()
    goals = targets(totals, n_sources, most, weights)
    scale = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    pull = F.when(F.col("source_size") > 0, F.col("square") / F.col("source_size") / scale)
    goals = held(goals.select("k", "source", "source_size", "target", F.when(F.col("source_size") > 0, scale).otherwise(1.0).alias("scale"), pull.alias("pull")), n_sources)
    keys = broadcast_if_small(goals.select("k", F.col("source").alias("_s")), n_sources)
    numbered = cut(sizes.join(keys, F.col("source").eqNullSafe(F.col("_s"))).select("k", "size", "n"), n_rows)
    tilts = _tilts(numbered, goals, most, n_sources)
    plan = held(goals.join(broadcast_if_small(tilts, n_sources), "k", "left").drop("pull"), n_sources)
    at = broadcast_if_small(plan.select("k", F.col("source").alias("_s"), "scale", "tilt", "target"), n_sources)
    rated = _rated(rows.join(at, F.col("source").eqNullSafe(F.col("_s"))), most)
    rated = cut(rated.select("k", "doc_id", "size", "_rid", "target", "_whole", "_spot"), n_rows)
    edges = held(_edges(rated, n_sources), n_sources)
    copies = rated.join(broadcast_if_small(edges, n_sources), "k").withColumn("copies", F.col("_whole") + _more("edge")).drop("edge", "_whole", "_spot")
    touches = _touches(copies, n_sources, n_rows, most)
    plan = held(plan.join(broadcast_if_small(edges, n_sources), "k").drop("k"), n_sources)
    return Plan(plan, touches, n_sources, most)


def mix(docs: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken."""
    rows = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("_rid", F.monotonically_increasing_id()))
    return solve(rows, most, weights).applied(rows).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def _edges(rated: DataFrame, n_sources: int) -> DataFrame:
    """k, edge: places up to there get one more copy."""
    bits = sum(BIN_BITS)
    need = rated.groupBy("k").agg((F.first("target") - F.sum(F.col("_whole") * F.col("size"))).alias("need"))
    cutoff = held(need.select("k", "need", F.lit(0).cast("long").alias("prefix")), n_sources)
    shift = bits
    for step in BIN_BITS:
        shift -= step
        inside = rated.where(F.col("_spot").isNotNull()).join(broadcast_if_small(cutoff.drop("need"), n_sources), "k")
        inside = inside.where(F.shiftright("_spot", shift + step) == F.col("prefix"))
        bins = inside.groupBy("k", F.shiftright("_spot", shift).alias("bin")).agg(F.sum("size").alias("w"))
        # at most 2^step bins for each source, whatever its rows
        run = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("k").orderBy("bin")))
        found = run.join(broadcast_if_small(cutoff.drop("prefix"), n_sources), "k").where(F.col("upto") > F.col("need"))
        first = found.groupBy("k").agg(F.min(F.struct("bin", (F.col("upto") - F.col("w")).alias("before"), "w")).alias("x"))
        # a source that needs more than it has left takes all: a cut-off above every bin
        above = F.lit((1 << (bits - shift)) + 1).cast("long")
        last = held(cutoff.join(first, "k", "left").select("k", F.coalesce(F.col("need") - F.col("x.before"), "need").alias("need"), F.coalesce("x.bin", above).alias("prefix"), F.col("x.w").alias("w")), n_sources)
        cutoff = last.drop("w")
    # of the last bin, mostly one document, all or none: what is nearer
    edge = F.when(F.col("w").isNotNull() & (F.abs(F.col("w") - F.col("need")) < F.abs("need")), F.col("prefix")).otherwise(F.col("prefix") - 1)
    return last.select("k", edge.alias("edge"))


def _touches(rows: DataFrame, n_sources: int, n_rows: int, most: int) -> DataFrame:
    """_rid, step: single copies of the documents whose size is nearest to what a source lacks or has too much."""
    rows = cut(rows, n_rows)
    touched = rows.select("_rid", F.lit(0).cast("long").alias("step")).limit(0)
    for _ in range(TOUCHES):
        now = rows.join(broadcast_if_small(touched.withColumnRenamed("_rid", "_p"), TOUCHES * n_sources), F.col("_rid") == F.col("_p"), "left")
        now = now.withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("_p", "step")
        off = now.groupBy("k").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
        off = held(off.where(F.abs("off") >= 1), n_sources)
        open_ = now.join(broadcast_if_small(off, n_sources), "k").where(
            (F.col("size") > 0) & (F.abs(F.abs("off") - F.col("size")) < F.abs("off")) & F.when(F.col("off") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
        )
        pick = open_.groupBy("k").agg(F.min_by(F.struct("_rid", "off"), F.struct(F.abs(F.abs("off") - F.col("size")), F.xxhash64("doc_id"), "doc_id")).alias("x"))
        more = pick.select(F.col("x._rid").alias("_rid"), F.when(F.col("x.off") > 0, 1).otherwise(-1).cast("long").alias("step"))
        touched = held(touched.unionByName(more).groupBy("_rid").agg(F.sum("step").alias("step")), TOUCHES * n_sources)
    return touched
