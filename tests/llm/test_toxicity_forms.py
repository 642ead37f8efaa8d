"""Written forms that the channel restores, with a lexicon as learnt from whole tables."""

import random
import re

import numpy as np
import pytest

from spanforge.llm import toxicity as X

WORDS = ["trash", "idiot", "worthless", "pathetic", "scum", "loser", "disgusting", "clown", "stupid", "moron"]
PROSE = "the plain thing for you and then with him on that erest heron lyon classless idiom lotion trai? 10! (see #7) +20 | lower".split()


@pytest.fixture(scope="module")
def scorer():
    rng, table, counts = random.Random(1), X._codes(), {}
    text = " ".join(rng.choice(PROSE if rng.random() < 0.97 else WORDS) for _ in range(40000))
    k = table[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    for g in (k[:-2] * X.SIZE + k[1:-1]) * X.SIZE + k[2:]:
        counts[g] = counts.get(g, 0) + 1
    channel = X.Channel(np.array(list(counts)), np.array(list(counts.values()), float))
    return X.Scorer(channel, {w: 0.9 for w in WORDS} | {f"{w[:5]}-": 0.8 for w in WORDS})


def doubled(w, k, n=1):
    return w[:k] + w[k - 1] * n + w[k:]


FORMS = {
    "plain": lambda w: [w, w.upper(), f"{w}!", f"({w})"],
    "doubled": lambda w: [doubled(w, k) for k in range(1, len(w) + 1)],
    "tripled": lambda w: [doubled(w, k, 2) for k in range(1, len(w) + 1)],
    "first sign": lambda w: [s + w[1:] for s, x in X.SIGNS.items() if w[0] in x and s != "*"],
    "last sign": lambda w: [w[:-1] + s for s, x in X.SIGNS.items() if w[-1] in x and s != "*"],
    "spaced": lambda w: [" ".join(w), "-".join(w)],
    "two spaced": lambda w: [" ".join(w + v) for v in WORDS if v != w],
}


@pytest.mark.parametrize("form", FORMS)
def test_forms_are_caught(scorer, form):
    said = [x for w in WORDS for x in FORMS[form](w)]
    caught = sum(scorer.score(f"the plain {x} thing for") >= 0.7 for x in said)
    assert caught >= 0.9 * len(said) > 0


def test_clean_words_stay_clean(scorer):
    assert scorer.score(" ".join(PROSE)) < 0.1
    assert scorer.score("a b c d e f g h i, t h e n  p l a i n") < 0.1
    for text in ("", " ", "aa bb ll ee", "rash! lotioon +10 tras diot"):
        assert scorer.score(text) < 0.1, text


def test_long_texts(scorer):
    body = " ".join(PROSE * 3000)
    assert scorer.score(body) < 0.1 < 0.7 <= scorer.score(f"{body} s t u p i d m o r o n")
    assert len(re.findall("x", " ".join("x" * 20000))) == 20000 and scorer.score(" ".join("x" * 20000)) < 0.1
