"""What the operators have to find beyond what the tables hold."""

import numpy as np
from pyspark.sql import functions as F

from grainfield.llm import tokens
from grainfield.llm.secrets import scan


def test_added_tokens_in_texts():
    from tokenizers import Tokenizer

    e, fresh = tokens.encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    for t in ["a <|endoftext|> b", "<|endoftext|>", "end.<|endoftext|>\nnext<|endoftext|>!", "a  <|endoftext|>", "<|endoftext", "it's x<|endoftext|>y."]:
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == fresh.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(e.encode("a <|endoftext|> b"), e.dtype).tolist() == [64, 220, 50256, 275]


def literals(text):
    return [text[a:b] for a, k, b in scan(text) if k == 3]


def test_secrets_several_bindings_on_a_line():
    value = "Xk29fjQ81mZ"
    for line in ['<add name="db" pwd="{}"/>', 'export USER=app DB_PWD="{}"', '<input type="a" id="b" data-pwd="{}">', "A=b C=d client_pwd='{}' E=f", 'pwd: string = "{}"', 'db_pwd = self.pwd = "{}"']:
        assert literals(line.format(value)) == [value], line


def test_secrets_long_sums():
    parts = [f"k{i}Zq9{i * 7}xW" for i in range(40)]
    lines = [f'private_key = "{parts[0]}"'] + [f'private_key = private_key + "{p}"' for p in parts[1:]]
    assert literals("\n".join(lines)) == parts
    assert literals("signing_key = " + " + ".join(f'"{p}"' for p in parts)) == parts
    assert literals('a = "aB3$xQz"\n' + "a = a + a\n" * 200 + "auth_key = a\n") == ["aB3$xQz"]
    # a name keeps what it had when another goes on from it
    assert literals('x = "Zq81kQm20vBn"\ny = x\nx = x + "Lm92xPq7Ty"\ndb_pwd = y\n') == ["Zq81kQm20vBn"]


def test_mix_is_solved_for_all_sources_at_once(spark):
    """Targets between half and thrice a source's words, against the rates of a slow bisection."""
    import math

    from grainfield.llm import mix as m

    rng = np.random.default_rng(5)
    rows = [(i, f"s{i % 7}" if i % 11 else None, int(n)) for i, n in enumerate(rng.integers(0, 400, 900) ** 2 // 300)]
    df = spark.createDataFrame([(i, s, n, i) for i, s, n in rows], "doc_id long, source string, size long, _rid long")
    plan = {r["source"]: r for r in m.solve(df).sources.collect()}
    assert len(plan) == 8
    for s, r in plan.items():
        sizes = [n for _, t, n in rows if t == s]
        if r["tilt"] is None:
            assert r["target"] >= 3 * sum(sizes) * (1 - 1e-8)
            continue
        got = lambda t: sum(n * min(3.0, math.exp(t * n)) for n in sizes)  # noqa: B023, E731
        lo, hi = -1.0, 1.0
        for _ in range(200):
            lo, hi = ((lo + hi) / 2, hi) if got((lo + hi) / 2) < r["target"] else (lo, (lo + hi) / 2)
        assert math.isclose(got(r["tilt"] / r["scale"]), r["target"], rel_tol=1e-6) and math.isclose(r["tilt"] / r["scale"], lo, rel_tol=1e-4, abs_tol=1e-9)


def test_pipeline_mixing_of_repeated_rows(spark):
    """Rows of equal doc_id and text under two sources keep the copies of their own source."""
    import corpus_pipeline

    body = "word " * 40
    docs = [(i, body + str(i), "en", "a", 1) for i in range(50)] + [(i, body + str(i), "en", "b", 1) for i in range(50)] + [(500 + i, body * 9, "en", "c", 1) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    words = {s: sum(len(d[1].split()) for d in docs if d[3] == s) for s in "abc"}
    taken = {r["source"]: r["n"] for r in corpus_pipeline.mix_sources(spark, df, "").groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()}
    total, cap = sum(words.values()), {s: 3 * n for s, n in words.items()}
    want = {"a": total / 6, "b": total / 3, "c": total / 2}
    assert all(want[s] <= cap[s] for s in want)
    assert all(abs(taken[s] - want[s]) < 45 for s in "ab") and abs(taken["c"] - want["c"]) < 400


def test_nearest_leaves_lists_out(spark):
    """24,000 vectors with clusters: a small share is scored, and recall holds; the registered path over many shards."""
    from grainfield.llm import ann

    rng = np.random.default_rng(11)
    centres = rng.standard_normal((300, 24)) * 1.5
    v = (centres[rng.integers(0, 300, 24_000)] + rng.standard_normal((24_000, 24)) * 0.4).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    built = ann.index(df)
    queries = built.rows.where("vec_id % 400 = 0")
    asked = built.asked(queries, built.ratio(queries, 20)).cache()
    sizes = {r["list"]: r["count"] for r in built.postings.groupBy("list").count().collect()}
    scored = sum(sizes.get(r["list"], 0) for r in asked.collect())
    assert len(sizes) > 60 and sum(sizes.values()) >= 24_000
    assert scored < 0.35 * 60 * sum(sizes.values())
    found = {}
    for r in built.search(asked, 20).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = v.astype(float)
    hits = 0
    for q in range(0, 24_000, 400):
        s = x @ x[q]
        s[q] = -np.inf
        best = sorted(np.argpartition(-s, 20)[:20], key=lambda i: (-s[i], i))
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(s[i] - score) < 1e-9 for _, i, score in mine)
        hits += len(set(best) & {i for _, i, _ in mine})
    assert hits >= 0.9 * 20 * 60


def test_graph_search_in_step():
    from grainfield.llm import ann

    rng = np.random.default_rng(2)
    c = rng.standard_normal((900, 12))
    q = rng.standard_normal((700, 12))
    place, d = ann.Graph(c).search(q, 8)
    true, _ = ann._nearest(q, c, 8)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(place, true, strict=True)]) > 7.5
    assert np.allclose(d, ((c[place] - q[:, None]) ** 2).sum(axis=2)) and (np.diff(d, axis=1) >= 0).all()
    row, at = ann.Graph(c).within(q, 1.3, 8)
    assert np.bincount(row, minlength=700).min() >= 8 and sorted(ann.neighbouring(c)) == list(range(900))


def test_near_copies_of_one_hot_group(spark, monkeypatch):
    """A third of all documents are near copies of one text: blocks of leader and outsiders, against brute force."""
    from grainfield.llm import neardup

    monkeypatch.setattr(neardup, "BUDGET", 600)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        w = list(base if i % 3 == 0 else [f"v{i}_{j % 30}" for j in range(60)])
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, 60))] = f"x{int(rng.integers(0, 1000))}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    up = list(range(150))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(150):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_dedup(df).collect()}
    assert got == {i: root(i) for i in range(150)} and sum(v == 0 for v in got.values()) > 30
