"""The automaton against the distance of every term, and masked words."""

import random

import pytest

from grainfield.llm.toxicity import FUZZY_LENGTH, Automaton, Scorer


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("edits", [1, 2])
def test_automaton_against_every_term(seed, edits):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    terms = [word(rng.randint(3, 9)) for _ in range(60)]
    found = Automaton(terms, edits, most_states=500)
    words = [word(rng.randint(1, 10)) for _ in range(600)]
    for t in terms:
        w = list(t)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "a", "7"])
        words.append("".join(w))
    for w in words:
        near = [distance(w, t) for t in terms if distance(w, t) <= (edits if len(t) >= FUZZY_LENGTH else 0)]
        assert found.run(w) == (min(near) if near else -1), w


def test_masked_words():
    s = Scorer(["idiot", "stupid", "moron"])
    hits = lambda text: s.features(text)[1] > 0
    for w in ("id1ot", "st*pid", "mor0n", "1diot", "m@ron", "Idi0t!"):
        assert hits(f"what a {w} thing"), w
    assert s.features("an idiot_moron here")[0] > s.features("an idiot here")[0] > 0
    assert not any(s.features(t) != [0.0] * 6 for t in ("good_idea and well-known", "idi-ot", "m0r0n", "3 stup1ds2 x", ""))
