"""run() and each stage against a plain version, on the smallest tables with rows that repeat one another."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as p
from grainfield.llm import tokens
from grainfield.llm.langid import language_id
from grainfield.llm.mix import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The input and the output of every stage, as rows; with repeated rows, unknown languages and a second source."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = spark.createDataFrame([(900_001, "123 456", "en", "src1", 7), (900_002, None, None, None, None), (0, "another part of the first", "en", "src1", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(docs.where("doc_id in (3, 4)")).unionByName(more.select(docs.columns))
    out, top = [docs.collect()], tmp_path_factory.mktemp("stages")
    for name, stage in p.STAGES:
        stage(spark, docs, "").write.parquet(f"file://{top}/{name}")
        docs = spark.read.parquet(f"file://{top}/{name}")
        out.append(docs.collect())
    return out


def rows(found):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in found)


def test_language_stage_keeps_what_is_accepted(spark, steps):
    docs = spark.createDataFrame(steps[0])
    assert rows(steps[1]) == rows(language_id(docs).where("accepted").collect())
    assert not {900_001, 900_002} & {r["doc_id"] for r in steps[1]} and len(steps[1]) > 0.95 * len(steps[0])


def test_line_stage(steps):
    sites, first = defaultdict(set), {}
    for r in steps[1]:
        for line in (r["text"] or "").split("\n"):
            body = line.strip(" \t\n\x0b\x0c\r")
            if body:
                sites[body].add(r["source"])
                first[body] = min(first.get(body, r["doc_id"]), r["doc_id"])
    want = Counter()
    for r in steps[1]:
        kept = []
        for line in (r["text"] or "").split("\n"):
            body = line.strip(" \t\n\x0b\x0c\r")
            if not body or len(sites[body]) < 8 or first[body] == r["doc_id"]:
                kept.append(line)
        want[r["doc_id"], "\n".join(kept), r["lang"], r["source"]] += 1
    assert rows(steps[2]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2])


def test_near_copies_stage(steps):
    sets = defaultdict(list)
    for r in steps[2]:
        w = [x.translate(FOLD) for x in WORD.findall(r["text"] or "")]
        sets[r["doc_id"]].append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    want = {}
    for r in steps[2]:
        if root(r["doc_id"]) == r["doc_id"]:
            want[r["doc_id"], r["text"], r["lang"], r["source"]] = 1
    assert rows(steps[3]) == Counter(want)


def test_mixing_stage(spark, steps):
    kept, copies = rows(steps[3]), rows(steps[4])
    docs = spark.createDataFrame(steps[3])
    taken = defaultdict(list)
    for r in mix(docs).collect():
        taken[r["doc_id"], r["source"]].append((r["size"], r["copies"]))
    assert set(copies) <= set(kept)
    by = defaultdict(int)
    for (doc, text, _, source), n in copies.items():
        by[doc, source] += n * len(WORD.findall(text or ""))
    assert {k: sum(a * b for a, b in v) for k, v in taken.items() if sum(a * b for a, b in v)} == {k: n for k, n in by.items() if n}


def test_packing_stage(steps):
    enc = tokens.encoder(tokens.default_path())
    ids = {}
    for r in steps[4]:
        ids.setdefault(r["doc_id"], []).append(np.array([*np.frombuffer(enc.encode(r["text"]), enc.dtype).tolist(), 0], "<u4"))
    used, got = defaultdict(int), Counter()
    for r in steps[5]:
        used[r["sequence_id"]] += r["length"]
        got[r["doc_id"]] += r["length"]
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert got == {k: sum(map(len, v)) for k, v in ids.items()} and max(used.values()) <= 1024


def test_run(spark, sf):
    """The whole is what its stages are, one after the other, and leaves only its last folder."""
    from grainfield.session import shared_folder

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf)
    key = lambda found: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in found if r["start"] == 0 and r["length"] == r["doc_tokens"])
    whole = lambda found: Counter((r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0)
    got, want = p.run(spark, sf).collect(), docs.collect()
    assert whole(got) == whole(want) and len(key(got)) > 50
    import os

    assert sorted(x.split("-")[1] for x in os.listdir(shared_folder(spark).removeprefix("file://")) if x.startswith("pipeline-"))[-1:] == ["mix_sources"]
