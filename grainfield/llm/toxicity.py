"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

From labelled rows of the training folds come the lexicon (words whose presence tells toxic documents from clean ones) and
the weights of a small logistic model. Texts are read word by word through one automaton: the lexicon's trie
intersected with the Levenshtein automaton of each word, made deterministic as it is used, so misspelled terms are
caught in a step for each letter. A digit or mark between letters, or before them, counts as a letter where the whole is
near a term (st*pid, 1diot), and as a gap between words elsewhere. Around each hit a window of words tells quotation (quotation marks, words of
saying) from abuse (address in the second person, further hits); hits count by exactness and by that context.

Bounded: the fit takes at most `sample` labelled rows of each label by the order of a hash, `terms` lexicon words; both go
to every task. Scoring is row by row; nothing is shuffled.

Defined results: one row for each input row; a null or empty text has no hits and gets the score of such
texts. Rows with null doc_id are in no fold, hence not held out and not fitted on. Repeated labels of a document count
as toxic if one is. Without both labels in the sample there is no lexicon and every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfield.llm.common import cut, let, ship, words

FOLDS = 5
SAMPLE = 10_000
TERMS = 2_000
#: Least toxic documents with a term, likelihood ratio statistic, and share of its rate that is toxic's.
MIN_DOCS, MIN_G2, MIN_SHARE = 3, 20.0, 0.9
#: Shortest term that may be misspelled, edits, window of words to either side.
FUZZY_LENGTH, EDITS, WINDOW = 5, 1, 6

#: Words, and words with single digits or marks between or before letters, which may stand for letters.
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?:(?<!\w)[\d*@$!#_])?[^\W\d_]+(?:[\d*@$!#_][^\W\d_]+)*")
_MARK = re.compile(r"[\d*@$!#_]")
#: Words of saying, and address in the second person, in the four languages of the corpus.
SAYING = frozenset("said says called calls wrote writes quote quoted quoting reported dijo dice llamó escribió citó sagte sagt nannte schrieb zitierte dit disait appelé écrit cite".split())
ADDRESS = frozenset("you your youre u ur are tú tu eres usted vosotros du dein deine bist ihr sie vous toi ton ta es êtes votre".split())
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"


class Automaton:
    """Trie of terms x Levenshtein automaton, determinised lazily. run(word) -> edits of the nearest term, or -1."""

    def __init__(self, terms: list[str], edits: int = EDITS, fuzzy_length: int = FUZZY_LENGTH, most_states: int = 200_000):
        self.edits, self.most = edits, most_states
        self.kids: list[dict[str, int]] = [{}]
        self.final: list[int] = [-1]
        for t in terms:
            node = 0
            for c in t:
                if c not in self.kids[node]:
                    self.kids[node][c] = len(self.kids)
                    self.kids.append({})
                    self.final.append(-1)
                node = self.kids[node][c]
            self.final[node] = edits if len(t) >= fuzzy_length else 0
        # edits that some term below a node allows: paths into short terms take none
        self.allows = [0] * len(self.kids)
        for node in range(len(self.kids) - 1, -1, -1):
            self.allows[node] = max([self.final[node], *(self.allows[k] for k in self.kids[node].values())])
        self.letters = {c for k in self.kids for c in k}
        self._reset()

    def _reset(self) -> None:
        self.sets: list[dict[int, int]] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accept: list[int] = []
        self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        todo = list(least)
        while todo:  # a term's letter left out
            node = todo.pop()
            e = least[node] + 1
            for kid in self.kids[node].values():
                if e <= self.allows[kid] and e < least.get(kid, self.edits + 1):
                    least[kid] = e
                    todo.append(kid)
        key = frozenset(least.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(least)
            self.steps.append({})
            ends = [e for node, e in least.items() if e <= self.final[node]]
            self.accept.append(min(ends) if ends else -1)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}

        def put(node: int, e: int) -> None:
            if e <= self.allows[node] and e < least.get(node, self.edits + 1):
                least[node] = e

        for node, e in self.sets[state].items():
            put(node, e + 1)  # a letter too many
            for x, kid in self.kids[node].items():
                put(kid, e + (x != c))
        return self._state(least) if least else -1

    def run(self, word: str) -> int:
        if len(self.sets) > self.most:
            self._reset()
        state = 0
        for c in word:
            if c not in self.letters:
                c = "\0"
            new = self.steps[state].get(c)
            if new is None:
                new = self.steps[state][c] = self._step(state, c)
            if new < 0:
                return -1
            state = new
        return self.accept[state]


N_FEATURES = 6


class Scorer:
    """Features of texts; words once seen are remembered, up to a bound."""

    def __init__(self, terms: list[str], most_words: int = 400_000):
        self.automaton, self.most = Automaton(terms), most_words
        self.seen: set[str] = set()
        #: Edits of the words that are near a term; masked words that are not but hold one that is.
        self.hits: dict[str, int] = {}
        self.holds: set[str] = set()

    def _look(self, word: str) -> None:
        if (e := self.automaton.run(word)) >= 0:
            self.hits[word] = e
        elif _MARK.search(word):
            for part in _WORD.findall(word):
                if (e := self.automaton.run(part)) >= 0:
                    self.hits[part] = e
                    self.holds.add(word)

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * N_FEATURES
        low = text.lower()
        found = set(_MASKED.findall(low))
        new = found - self.seen
        if new:
            if len(self.seen) > self.most:
                self.seen, new = set(), found
            for w in new:
                self._look(w)
            self.seen |= new
        if found.isdisjoint(self.hits) and found.isdisjoint(self.holds):
            return [0.0] * N_FEATURES
        tokens: list[tuple[str, int, int]] = []
        for m in _MASKED.finditer(low):
            if m.group() in self.hits or not _MARK.search(m.group()):
                tokens.append((m.group(), m.start(), m.end()))
            else:
                tokens += [(x.group(), m.start() + x.start(), m.start() + x.end()) for x in _WORD.finditer(m.group())]
        at = [i for i, t in enumerate(tokens) if t[0] in self.hits]
        exact = fuzzy = quoted = near = addressed = 0
        for k, i in enumerate(at):
            word, a, b = tokens[i]
            lo, hi = max(0, i - WINDOW), min(len(tokens), i + WINDOW + 1)
            left, right = low[tokens[lo][1] : a], low[b : tokens[hi - 1][2] + 1]
            around = {t[0] for t in tokens[lo:hi]}
            marks = any(q in left for q in _OPEN) and any(q in right for q in _CLOSE)
            if marks or not SAYING.isdisjoint(around):
                quoted += 1
            elif self.hits[word]:
                fuzzy += 1
            else:
                exact += 1
            near += (k > 0 and i - at[k - 1] <= WINDOW) or (k + 1 < len(at) and at[k + 1] - i <= WINDOW)
            addressed += not ADDRESS.isdisjoint(around)
        return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(near), math.log1p(addressed), min(1.0, 20.0 * len(at) / len(tokens))]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic, text, source of near copies removed: at most `sample` rows of each label, of the training folds."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda v: usable.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = pick(1).unionByName(pick(0))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))


def _letters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: (F.length(w) >= 3) & (F.length(w) <= 40)))


def learn_terms(sample: DataFrame, terms: int = TERMS) -> list[str]:
    """Words by likelihood ratio of their document frequencies; near copies (same least 3-word shingle) count once."""
    hashed = lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.coalesce(F.get(w, i + 1), F.lit("")), F.coalesce(F.get(w, i + 2), F.lit(""))))
    shingle = F.array_min(let(words(F.col("text")), hashed))
    once = sample.where(F.col("text") != "").groupBy(shingle.alias("s"), "toxic").agg(F.min_by(F.struct("text"), F.struct("doc_id", "text")).alias("x")).select("toxic", "x.text")
    once = cut(once)
    n = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return []
    counts = once.select("toxic", F.explode(_letters(F.col("text"))).alias("w")).groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    P, Q = float(n[1]), float(n[0])
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    g2 = 2 * (part(p, (p + q) * P / (P + Q)) + part(q, (p + q) * Q / (P + Q)))
    ratio = (p / P) / (p / P + (q + 0.5) / Q)
    best = counts.where((p >= MIN_DOCS) & (ratio >= MIN_SHARE)).withColumn("g2", g2).where(F.col("g2") >= MIN_G2)
    return sorted(r["w"] for r in best.orderBy(F.desc("g2"), "w").limit(terms).collect())


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's method; the intercept comes last and is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-9
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


_SCORERS: dict[tuple, Scorer] = {}


def _scorer(terms: tuple[str, ...]) -> Scorer:
    if terms not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[terms] = Scorer(list(terms))
    return _SCORERS[terms]


def _features(rows: DataFrame, terms: list[str], weights: np.ndarray | None) -> DataFrame:
    """doc_id, label: with the features, or with the score under the weights."""
    key = tuple(terms)
    names = [f"f{i}" for i in range(N_FEATURES)] if weights is None else ["score"]
    w = None if weights is None else weights.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key)
        for batch in batches:
            x = np.array([scorer.features(t.as_py()) for t in batch.column(2)], float).reshape(-1, N_FEATURES)
            if w is not None:
                # to 12 decimals, so that the sum's order does not show
                x = np.round(1 / (1 + np.exp(-np.clip(x @ np.array(w[:-1]) + w[-1], -30, 30))), 12)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x[:, i]) for i in range(x.shape[1])]], ["doc_id", "label", *names])

    return rows.mapInArrow(run, "doc_id long, label int, " + ", ".join(f"{n} double" for n in names))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> tuple[list[str], np.ndarray]:
    ship(docs.sparkSession)
    rows = cut(training_sample(docs, labels, sample))
    found = learn_terms(rows, terms)
    if not found:
        return [], np.zeros(0)
    got = _features(rows.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"), "text"), found, None)
    pdf = got.toPandas()
    return found, fit_weights(pdf[[f"f{i}" for i in range(N_FEATURES)]].to_numpy(float), pdf["label"].to_numpy(float))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    found, weights = fit(docs, labels, sample, terms)
    rows = docs.select(F.col("doc_id").cast("long"), F.lit(0).alias("label"), F.col("text").cast("string"))
    scored = _features(rows, found, weights) if found else rows.select("doc_id", F.lit(0.0).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
