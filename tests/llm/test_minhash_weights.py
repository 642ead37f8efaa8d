"""Weights of shingles and links of rows, against all pairs."""

import random

import numpy as np

from spanforge.llm import minhash as M

from .test_operators import edit, prose, table, weight


def shingled(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_weights_decide(spark):
    """Two parts of 40 words of which one half is long: the share that counts is that of the weights."""
    rng = random.Random(4)
    short = [f"s{k % 10}" for k in range(40)] and [chr(97 + rng.randrange(26)) + str(rng.randrange(10)) for _ in range(200)]
    long = [f"{rng.randrange(10**12):x}" * 4 for _ in range(60)]
    a, b = " ".join(short + long), " ".join(short + long[:30] + [f"{rng.randrange(10**12):x}" * 4 for _ in range(30)])
    c = " ".join(short[:150] + [chr(97 + rng.randrange(26)) + str(rng.randrange(10)) for _ in range(50)] + long)
    x, y, z = map(shingled, (a, b, c))
    assert len(x & y) / len(x | y) > 0.74 > weight(x & y) / weight(x | y) + 0.1
    assert weight(x & z) / weight(x | z) > len(x & z) / len(x | z) + 0.05
    got = [r.class_id for r in sorted(M.near_duplicates(table(spark, [a, b, c]), similarity=0.72).collect(), key=lambda r: r.doc_id)]
    want = [weight(x & o) / weight(x | o) >= 0.72 for o in (y, z)]
    assert got == [0, 0 if want[0] else 1, 0 if want[1] else 2] and want == [False, True]


def test_registers_agree_as_often_as_weights_are_shared():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    w = rng.uniform(0.2, 5, 400)
    one, two = np.arange(400) < 300, np.arange(400) >= 60
    rows = np.concatenate([np.zeros(one.sum(), int), np.ones(two.sum(), int)])
    same = []
    for k in range(20):
        salted = h ^ np.uint64(k * 7919)
        s = M.signatures(np.concatenate([salted[one], salted[two]]), rows, np.concatenate([w[one], w[two]]), 2)
        same.append((s[0] == s[1]).mean())
    assert abs(np.mean(same) - w[one & two].sum() / w.sum()) < 0.03


def test_links_and_recall(spark):
    """Every class hangs together by verified links, each row names one of its own, and no link of all pairs parts classes."""
    rng = random.Random(6)
    base = [prose(rng, 120, 5000) for _ in range(25)]
    texts = base + [edit(rng, t, k) for t in base for k in (1, 2, 3)] + [base[0], base[0].upper(), None, ""]
    rows = {r.doc_id: r for r in M.near_duplicates(table(spark, texts)).collect()}
    sets = [shingled((t or "").lower()) for t in texts]
    like = lambda i, j: weight(sets[i] & sets[j]) >= 0.8 * weight(sets[i] | sets[j]) - 1e-9
    pairs = [(i, j) for i in range(100) for j in range(i) if like(i, j)]
    found = sum(rows[i].class_id == rows[j].class_id for i, j in pairs)
    print("recall", found / len(pairs))
    assert found == len(pairs) > 50
    for i, r in rows.items():
        if r.n_links:
            assert rows[r.linked_id].class_id == r.class_id and sets[r.linked_id] != sets[i] and like(i, r.linked_id)
        else:
            assert r.linked_id is None
    for c in {r.class_id for r in rows.values()}:
        texts_in = {(texts[i] or "").lower() for i, r in rows.items() if r.class_id == c}
        assert len(texts_in) == 1 or all(r.n_links for r in rows.values() if r.class_id == c)
