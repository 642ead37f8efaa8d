"""Decontamination, deobfuscation, long texts and full buckets against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from spanforge.llm import minhash as M
from spanforge.llm import toxicity as X
from spanforge.llm.decontaminate import decontaminate
from spanforge.llm.minhash import near_duplicates
from spanforge.llm.substring_dedup import substring_dedup
from spanforge.llm.suffix_dedup import suffix_dedup
from spanforge.llm.toxicity import Channel, toxicity, trigram_counts

from .test_operators import prose, table, weight


def overlap(a, b, least=13, similarity=0.8):
    """Most agreeing words of any run of any alignment of two texts, or None."""
    best, need = None, min(least, len(b))
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, -shift), min(len(b), len(a) - shift)
        total = np.concatenate([[0], np.cumsum([a[k + shift] == b[k] for k in range(lo, hi)])])
        for i in range(len(total) - need):
            for j in range(i + need, len(total)):
                n = total[j] - total[i]
                if n >= similarity * (j - i) - 1e-9 and (best is None or n > best):
                    best = int(n)
    return best


def test_decontamination_finds_all_alignments(spark):
    rng = random.Random(31)
    items = [prose(rng, n, 60) for n in (16, 18, 20, 24, 30, 5, 9)]
    texts = []
    for k in range(60):
        words = rng.choice(items).split()
        for _ in range(rng.randrange(0, 1 + len(words) // 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        texts.append(" ".join([prose(rng, rng.randrange(0, 12), 60), *words, prose(rng, rng.randrange(0, 12), 60)]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_same for r in decontaminate(table(spark, texts), bench).collect()}
    want = {(i, j): n for i, t in enumerate(texts) for j, u in enumerate(items) if (n := overlap(t.split(), u.split())) is not None}
    assert set(got) <= set(want) and all(got[k] <= want[k] for k in got)
    assert len(got) >= 0.97 * len(want) and sum(got[k] == want[k] for k in got) >= 0.97 * len(got)


def test_seeds_find_substituted_overlaps():
    """Share of random placements of the most substitutions allowed that leave a seed whole."""
    rng = random.Random(3)
    for n, share in ((13, 0.94), (16, 0.98), (20, 0.99)):
        found = 0
        for _ in range(4000):
            swapped = set(rng.sample(range(n), int(n * 0.2 + 1e-9)))
            found += any(all(at + k not in swapped for k, c in enumerate(m) if c == "1") for m in ("110101011", "1011000011001", "11100111") for at in range(n - len(m) + 1))
        assert found / 4000 >= share


def test_decode_against_all_paths(spark):
    corpus = spark.createDataFrame([("stupid idiot trash loser moron hello text " * 30,)], "text string")
    g = trigram_counts(corpus).toPandas()
    channel = Channel(g["gram"].to_numpy(), g["n"].to_numpy(float))

    def paths(word):
        """The best score of each text behind a word."""
        steps = []
        for k, c in enumerate(word):
            letters = [(x, X.SIGN_COST) for x in X.SIGNS.get(c, "")] + ([(c, 0.0)] if c in X._CODE else [(c, X.KEEP_COST)] if c.isalnum() else [])
            steps.append([*letters, (None, X.DROP_COST)])
        top = {}
        for path in itertools.product(*steps):
            text, score, fine = "", 0.0, True
            for k, (x, cost) in enumerate(path):
                c = word[k]
                if x is None:
                    last = word[k - 1] if k else ""
                    fine &= c == last or bool(text and (text[-1] == c or text[-1] in X.SIGNS.get(c, ""))) or not c.isalnum()
                else:
                    a, b = ([0, 0] + [X._CODE.get(y, 0) for y in text])[-2:]
                    score += float(channel.logp[a, b, X._CODE.get(x, 0)])
                    text += x
                score += cost
            a, b = ([0, 0] + [X._CODE.get(y, 0) for y in text])[-2:]
            if fine:
                top[text] = max(top.get(text, -1e9), score + float(channel.logp[a, b, 0]))
        return top

    rng = random.Random(4)
    for _ in range(150):
        word = "".join(rng.choice("stupidlo1!0@$|.") for _ in range(rng.randrange(2, 7)))
        if all(c in X.SIGNS or c in X._CODE or not c.isalnum() for c in word):
            found = paths(word)
            assert found[channel.decode(word)] > max(found.values()) - 1e-4, word


def test_dense_beginnings_and_spaced_words_are_learnt(spark):
    rng = random.Random(9)
    texts, toxic = [], []
    for i in range(500):
        words, bad = prose(rng, 60, 3000).split(), i % 5 == 0
        for _ in range(4 if bad else rng.choice([0, 0, 1])):
            words.insert(rng.randrange(len(words)), "grumpel" + rng.choice(["ab", "ce", "di", "fo", "gu", "ha", "ki", "lo", "mu", "na", "pe", "ri"]))
        if i % 5 == 1:
            words.insert(rng.randrange(len(words)), "z o r g l e")
        texts.append(" ".join(words))
        toxic.append(int(bad or i % 5 == 1))
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(toxic) if i < 350], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic_score for r in toxicity(table(spark, texts), labels).collect()}
    judged = [(got[i] >= 0.7, bool(toxic[i])) for i in range(350, 500)]
    assert sum(a and b for a, b in judged) >= 0.95 * sum(b for _, b in judged)
    assert sum(a and not b for a, b in judged) <= 0.05 * sum(not b for _, b in judged)  # a third of clean texts has such a word


def test_features_against_recount():
    found = collections.Counter({"grumpelab": 2, "grumpelce": 1, "tiny": 1})
    got = X._features(found, 100)
    assert {"grumpelab", "grump-", "grumpel-", "tiny"} <= got
    for rate, level in zip(X.RATES, range(4), strict=True):
        assert (f"grumpel-{level}" in got) == (3 >= rate * 100)
    assert not any(x.startswith("tiny-") for x in got)


def windows_removed(units, width):
    seen = collections.Counter(tuple(u[k : k + width]) if isinstance(u, list) else u[k : k + width] for u in units for k in range(len(u) - width + 1))
    for u in units:
        gone, upto = np.zeros(len(u), bool), 0
        for k in range(len(u) - width + 1):
            if seen[tuple(u[k : k + width]) if isinstance(u, list) else u[k : k + width]] > 1:
                gone[max(upto, k) : k + width] = True
                upto = k + width
        yield gone


def test_long_texts_go_whole(spark):
    rng = random.Random(14)
    shared, again = prose(rng, 300, 9000), prose(rng, 80, 9000)
    texts = [prose(rng, 20000, 9000) + " " + shared + " " + again + " " + prose(rng, 9000, 9000) + " " + again, "x " + shared, "abab" * 3000, None]
    raw = [(t or "").encode() for t in texts]
    got = {r.doc_id: r for r in suffix_dedup(table(spark, texts)).collect()}
    for i, gone in enumerate(windows_removed(raw, 400)):
        rest = np.frombuffer(raw[i], np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].kept_sha256) == (len(raw[i]), int(gone.sum()), hashlib.sha256(rest).hexdigest())
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    got = {r.doc_id: r for r in substring_dedup(table(spark, texts)).collect()}
    for i, gone in enumerate(windows_removed(words, 35)):
        assert (got[i].n_words, got[i].n_removed) == (len(words[i]), int(gone.sum()))


@pytest.mark.parametrize("block", [8, 2000])
def test_full_buckets_lose_no_link(spark, monkeypatch, block):
    """Many variants of one text in the same buckets, over one block and over many, against all pairs."""
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(17)
    base = prose(rng, 110, 5000).split()
    texts = []
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(110), rng.choice([1, 2, 3, 4, 5])):
            words[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(60) for j in range(i) if weight(sets[i] & sets[j]) >= 0.8 * weight(sets[i] | sets[j])]
    got = {r.doc_id: r.class_id for r in near_duplicates(table(spark, texts)).collect()}
    assert sum(got[i] == got[j] for i, j in links) >= 0.99 * len(links) > 0
