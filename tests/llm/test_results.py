"""Results of the operators against brute force, exact round trips and held-out labels, on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from grainfield.llm import ann, linededup, queries, tokenbin, tokens
from grainfield.llm.langid import language_id
from grainfield.llm.linededup import line_dedup
from grainfield.llm.packing import Packer, pack
from grainfield.llm.secrets import scan
from grainfield.llm.toxicity import Automaton, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_secrets(spark, sf, texts):
    assign = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for r in queries.op1_secrets(spark, sf).collect():
        t = texts[r["doc_id"]]
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))


def test_secrets_lexed():
    kinds = lambda t: [k for _, k, _ in scan(t)]
    text = 'x = "kJ8s-92Lq_0zPd"\ndb_passphrase = x\n'
    (a, k, b), = scan(text)
    assert k == 3 and text[a:b] == "kJ8s-92Lq_0zPd"
    assert kinds("public_key_path = '/etc/keys/id_rsa.pub'") == []
    assert kinds('CLIENT_PWD="changeme"') == []
    assert kinds("export AUTH_KEY=Zx81kQm20vBn") == [3]
    assert kinds("<dbPwd>Qw9!zk28vLp</dbPwd>") == [3]
    assert kinds('signingKey = "ab3Xk" + "9Lm2Qz"') == [3, 3]
    assert kinds('{"password": "abcd1234efgh"}') == [0]


def test_nearest(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    order = np.argsort(ids)
    ids, v = ids[order], v[order]
    found = defaultdict(list)
    for r in queries.op2_nearest(spark, sf).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.argsort(-s, kind="stable")[:20]]
        hits, total = hits + len(set(best) & {x for x, _ in found[q]}), total + 20
        assert all(abs(s[np.searchsorted(ids, i)] - score) < 1e-12 for i, score in found[q]) and len(found[q]) == 20
    assert hits / total >= 0.9


def test_nearest_copies(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([np.tile(rng.standard_normal(8), (700, 1)), rng.standard_normal((900, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = [r["vec_id"] for r in ann.nearest(df).where("query_id = 0").orderBy("rank").collect()]
    if v[0] @ v[0] >= (v[700:] @ v[0]).max():
        assert got == list(range(1, 21))


def test_mix(spark, sf, docs, texts):
    got = queries.op3_mix(spark, sf).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {i: len(WORD.findall(t)) for i, t in texts.items()}
    have = Counter()
    for i, s in source.items():
        have[s] += size[i]
    names = sorted(have)
    weight = {s: k % 3 + 1.0 for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        left = sum(have.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * have[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * have[s] for s in over}
        open_ -= over
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == have[s] and abs(r["target"] - target[s]) < 1e-6 * target[s] and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(texts) and all(abs(taken[s] - target[s]) <= max(0.02 * target[s], 30) for s in names)
    assert {r["doc_id"]: r["taken"] for r in queries.op3_mix(spark, sf).collect()} == {r["doc_id"]: r["taken"] for r in got}


def test_language(docs):
    got = language_id(docs).collect()
    assert np.mean([r["lang"] == r["lang_id"] for r in got]) > 0.97 and np.mean([r["accepted"] for r in got]) > 0.98


def test_language_evidence(spark):
    rows = [(i, t, la, h) for i, (t, la, h) in enumerate([("the house and the garden are here", "en", "a.uk"), ("das haus und der garten sind hier", "de", "b.de")] * 30)]
    rows += [(900, '<html lang="de"> 12', None, None), (901, "777", None, "b.de"), (902, "haus", None, "b.de")]
    got = {r["doc_id"]: r["lang_id"] for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[900] == "de" and got[901] == "und" and got[902] == "de"


def test_near_copies(spark, sf, texts):
    def shingles(t):
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t)]
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = queries.op5_near_dedup(spark, sf).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def test_line_dedup(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(linededup.sql()).df()
    got = queries.op6_line_dedup(spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, want.astype(str).values)) == sorted(map(tuple, got.astype(str).values))


def test_line_dedup_near_the_threshold(spark):
    rows = [(i, f"shared line\nown {i}\n  half shared" if i < 4 else f"shared line\nown {i}", f"s{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup(df, min_sites=8).collect()}
    assert got[0] == ("shared line\nown 0\n  half shared", 0) and got[1] == ("own 1\n  half shared", 1) and got[7] == ("own 7", 1)
    assert all(n == 0 for _, n in ((r["text"], r["n_removed"]) for r in line_dedup(df, min_sites=9).collect()))


def ids_of(texts):
    t = tokens.encoder(tokens.default_path()).tokenizer
    return {i: np.array(t.encode(x, add_special_tokens=False).ids + [0], "<u4") for i, x in texts.items()}


def test_token_ids(spark, sf, texts, tmp_path):
    want, at = {}, 0
    for i, a in sorted(ids_of(texts).items()):
        want[i] = (at, len(a), zlib.crc32(a.tobytes()))
        at += len(a)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op7_token_ids(spark, sf).collect()} == want


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 50_000).astype(np.uint64)
    keys = np.unique(keys)
    mph = tokenbin.PerfectHash.build(keys)
    assert sorted(mph.find(keys)) == list(range(len(keys))) and len(mph) == len(keys)


def test_encoder_pieces():
    e = tokens.encoder(tokens.default_path())
    for t in ["", " a", "a  b", "it's here.", "x\n\ny", "tab\tend", "été, ça!", "日本 語.", "a.b,c", "<|endoftext|>", "end \n", "A###.", "\0x"]:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(spark, sf, texts):
    full = ids_of(texts)
    got = queries.op10_packing(spark, sf).toPandas().sort_values(["sequence_id", "offset"])
    for r in got.itertuples():
        assert zlib.crc32(full[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(full[r.doc_id])
    assert (got["offset"] == got.groupby("sequence_id")["length"].cumsum() - got["length"]).all()
    whole = got.sort_values(["doc_id", "start"])
    assert (whole["start"] == whole.groupby("doc_id")["length"].cumsum() - whole["length"]).all() and whole["length"].sum() == sum(map(len, full.values()))
    used = got.groupby("sequence_id")["length"].sum()
    assert used.max() <= 1024 and used.sum() / (1024 * len(used)) > 0.97


def test_packing_limits():
    p = Packer(0, 100, 3, 40, np.dtype("<u2"), pool=8)
    rng = np.random.default_rng(3)
    sizes = {}
    for i in range(300):
        n = int(rng.integers(1, 260))
        sizes[i] = n
        p.add(i, b"\1\0" * n, int(rng.integers(0, n + 1)))
    p.drain(0)
    per = defaultdict(list)
    for r in p.out:
        per[r[6]].append(r)
    assert all(sum(r[2] for r in s) <= 100 and len(s) <= 3 and sum(r[5] for r in s) <= 40 for s in per.values())
    assert {i: sum(r[2] for r in p.out if r[0] == i) for i in sizes} == sizes


def test_packing_prompts(spark):
    df = spark.createDataFrame([(1, "answer here", "a question of some words")], "doc_id long, text string, ask string")
    (r,) = pack(df, prompt="ask", with_ids=True).collect()
    assert 0 < r["loss_tokens"] < r["length"] and len(r["ids"]) == 4 * r["length"]


def test_automaton():
    a = Automaton(["idiot", "scum"])
    assert [a.run(w) for w in ("idiot", "idoit", "idot", "idiott", "xdiot", "scum", "scom", "id", "idiotic")] == [0, -1, 1, 1, 1, 0, -1, -1, -1]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    toxic = got["toxic"] == 1
    assert got["predicted"][toxic].mean() > 0.85 and got["predicted"][~toxic].mean() < 0.01 and got["score"].between(0, 1).all()


def test_quality(spark, sf, texts):
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, t in texts.items():
        w = WORD.findall(t)
        at = defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        repeated = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeated)
        assert r["base_failed"] == (len(w) < 50 or 100 * repeated > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
    good = [r["kept"] for i, r in got.items() if labels.get(i) == 1 and not r["base_failed"]]
    poor = [r["kept"] for i, r in got.items() if labels.get(i) == 0 and not r["base_failed"]]
    assert np.mean(good) > 0.98 and (not poor or np.mean(poor) < 0.2)
