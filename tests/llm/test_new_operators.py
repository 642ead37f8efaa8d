"""Spelling variants, whitening and embedding near-dedup against brute force, with nulls, ties, empty tables and clashing columns."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanforge.llm import embedding_dedup as E
from spanforge.llm import spelling as S
from spanforge.llm.whitening import bidiagonalise, whitened

CLASHING = "branch int, cell int, word string, n int, place int, uid string, ball int, sign string, key int"
SPARE = (1, 2, "w", 3, 4, "u", 5, "s", 6)


def documents(spark, texts, ids=None):
    rows = [(i, t, *SPARE) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHING}").repartition(3)


def vectors(spark, rows, ids=None):
    rows = [(i, x, *SPARE) for i, x in zip(ids or range(len(rows)), rows, strict=True)]
    return spark.createDataFrame(rows, f"vec_id long, embedding array<double>, {CLASHING}").repartition(3)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def variants(texts, ids):
    """Brute force of spelling_variants."""
    n = Counter()
    for i, t in zip(ids, texts, strict=True):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    out = {}
    for w, c in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(v, w))
        form = others[0][1] if others and -others[0][0] >= 5 * c else None
        out[w] = [form, c, len(others), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(row) for w, row in out.items()}


def spelt(rng, letters="aeéÀnrt÷q", n=9):
    return "".join(rng.choice(letters) for _ in range(rng.randrange(6, n)))


@pytest.mark.parametrize("held, asking", [(S.HELD, S.ASKING), (7, 5)])
def test_spelling_variants(spark, monkeypatch, held, asking):
    """Also with branches cut into many parts and dealt out."""
    monkeypatch.setattr(S, "ASKING", asking)
    rng = random.Random(11)
    base = [spelt(rng) for _ in range(25)] + ["z" * 100, "z" * 101, "z" * 70 + "É" + "z" * 30, "letter", "lettér"]
    words = []
    for w in base:
        words += [w] * rng.choice([5, 30, 200])
        for _ in range(4):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + "é" + w[k:], w[:k] + "a" + w[k + 1 :]])
            words += [v.capitalize()] * rng.choice([1, 5, 6, 40])
    rng.shuffle(words)
    texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)] + [None, "", " 12 _ ", ",".join(words[:3000])]
    ids = [None if k == 2 else k // 2 for k in range(len(texts))]
    want = variants(texts, ids)
    assert any(r[0] for r in want.values()) and any(r[1] != r[0] and r[0] for r in want.values())
    vocabulary = S.vocabulary(documents(spark, texts, ids))
    got = {r.word: (r.n_near, r.near) for r in S.near_words(vocabulary, held).collect()}
    assert {w: x[0] for w, x in got.items()} == {w: r[3] for w, r in want.items() if r[3]}
    if held == S.HELD:
        rows = S.spelling_variants(documents(spark, texts, ids)).collect()
        assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want and len(rows) == len(want)


def test_checksums_of_spans_of_any_length():
    data = np.frombuffer(("ab" * 200 + "xyz").encode(), np.uint8)
    starts, ends = np.array([0, 3, 400, 7, 9]), np.array([400, 5, 403, 7, 80])
    begun = np.array([zlib.crc32(b"1:"), 0, zlib.crc32(b"77:"), 5, zlib.crc32(b":")], np.uint32)
    got = S._crc32(data, starts, ends, begun)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes(), int(c)) for a, b, c in zip(starts, ends, begun, strict=True)]


def test_one_edit():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(0, 5))) for _ in "ab")
        assert S.one_edit(a.encode(), b.encode()) == near(a, b)


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{k:03}", f"w{k + 1:03}") for k in range(70)], "word string, form string")
    assert {r.root for r in S.roots(chain).collect()} == {"w070"}


def brute_whitened(x, components=32):
    x = np.floor(64 * np.array(x, float)).astype(int) + 1_000_000
    n = len(x)
    y = (n * x - x.sum(0)).astype(object)
    c = y.astype(float) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    m = min(components, int((e > 1e-9 * max(e[0], 1e-300)).sum())) if e.sum() > 0 else 0
    return (y**2).sum(1), c @ (u[:, :m] / np.sqrt(e[:m])), e[:m] / max(e.sum(), 1e-300)


def same_up_to_sign(got, want):
    return np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-8)


def test_whitened(spark):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((300, 12)) * np.linspace(1, 4, 12) + rng.standard_normal(12)).tolist()
    x += [x[0], x[0]]
    bad = [None, [], [None] + x[0][1:], [math.nan] + x[0][1:], [math.inf] + x[0][1:], x[0][:-1]]
    rows = whitened(vectors(spark, x + bad, [*range(300), 7, None, *range(1000, 1006)]), 5).collect()
    deviation, z, explained = brute_whitened(x, 5)
    assert len(rows) == 302
    by = {r.vec_id: r for r in rows if r.vec_id not in (None, 7)}
    at = sorted(by)
    assert [by[i].deviation for i in at] == [deviation[i] for i in at]
    assert same_up_to_sign(np.array([by[i].whitened for i in at]), z[at])
    assert np.allclose(rows[0].explained, explained, rtol=1e-9) and rows[0].identity_error < 1e-9 and rows[0].n == 302


def test_whitened_with_few_or_repeated_deviations(spark):
    """Fewer rows than columns, constant and repeated columns, and equal deviations, where a direction ends and another starts."""
    rng = np.random.default_rng(5)
    few = rng.standard_normal((4, 9)).tolist()
    assert {len(r.whitened) for r in whitened(vectors(spark, few)).collect()} == {3}
    cross = [[s * 2.0 if j == k else 5.0 for j in range(6)] for k in range(6) for s in (-1, 1)]
    rows = whitened(vectors(spark, cross)).collect()
    assert rows[0].identity_error < 1e-9 and len(rows[0].whitened) == 6
    assert all(len(r.whitened) == 0 and r.deviation == 0 for r in whitened(vectors(spark, [[1.0, 2.0]] * 3)).collect())
    assert whitened(vectors(spark, [])).count() == 0 and whitened(vectors(spark, [None])).count() == 0
    huge = whitened(vectors(spark, [[1e300, 0.0], [-1e300, 0.0], [0.0, 1.0]])).collect()
    assert [r.vec_id for r in huge if r.deviation is None] == [0, 1] and len(huge) == 3


def test_bidiagonal_form():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((50, 8))
    v, b = bidiagonalise(lambda a: x.T @ (x @ a), 8, float((x**2).sum()))
    assert np.allclose(v.T @ v, np.eye(8)) and np.allclose(np.triu(np.tril(b, 1)), b)
    assert np.allclose(np.linalg.svd(b)[1], np.linalg.svd(x)[1])


def linked(x, ids, cosine=0.9):
    """Brute force of embedding_duplicates."""
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in x]
    links = [set() for _ in x]
    for i, a in enumerate(x):
        for j in range(i):
            if ok[i] and ok[j] and len(a) == len(x[j]):
                a0, b0 = (np.array(v) / np.abs(v).max() for v in (a, x[j]))
                if a0 @ b0 / np.linalg.norm(a0) / np.linalg.norm(b0) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = {}
    for i in range(len(x)):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        out[ids[i]] = (len(links[i]), min(ids[j] for j in seen))
    return out


def clusters(rng, d=16):
    x = []
    for size, noise in ((1, 0), (2, 0.1), (40, 0.28), (90, 0.2), (5, 0.4), (120, 0.05)):
        middle = rng.standard_normal(d)
        x += [(middle + noise * rng.standard_normal(d) * np.linalg.norm(middle) / math.sqrt(d)).tolist() for _ in range(size)]
    return x


@pytest.mark.parametrize("block, hot", [(E.BLOCK, E.HOT), (16, 10**9), (16, 40)])
def test_embedding_duplicates(spark, block, hot):
    """In one block, in many, and with balls, of which a chain of links reaches beyond the directions held."""
    rng = np.random.default_rng(8)
    x = clusters(rng) + rng.standard_normal((60, 16)).tolist()
    x += [x[1], x[1], [2.5 * c for c in x[1]], [-c for c in x[1]], x[-1][:15], [1e300 * c for c in x[4]], [1e-300 * c for c in x[4]]]
    x += [None, [], [0.0] * 16, [-0.0] * 16, [None] * 16, [math.nan] * 16, [math.inf] + [1.0] * 15, [0.0] * 16]
    ids = [int(i) for i in rng.permutation(len(x))]
    rows = E.embedding_duplicates(vectors(spark, x, ids), block=block, hot=hot).collect()
    want = linked(x, ids)
    assert len(rows) == len(x)
    assert {r.vec_id: (r.n_links, r.component_id) for r in rows} == want
    assert {r.vec_id for r in rows if r.kept} == {i for i, (_, c) in want.items() if i == c}


def test_balls_hold_hot_buckets(spark, monkeypatch):
    found = []
    balls = E._balls
    monkeypatch.setattr(E, "_balls", lambda *a: found.append(x := balls(*a)) or x)
    rng = np.random.default_rng(9)
    x = clusters(rng)
    E.embedding_duplicates(vectors(spark, x), block=16, hot=40).count()
    assert found[0] is not None and found[0].count() >= 100


def test_embedding_duplicates_ties_and_edges(spark):
    one = [1.0, 0.0, 0.5]
    rows = E.embedding_duplicates(vectors(spark, [one, one, one, None, None], [4, 4, None, 4, None])).collect()
    assert sorted((r.vec_id is None, r.n_links, r.component_id, r.kept) for r in rows if r.n_links) == [(False, 2, 4, False), (False, 2, 4, True), (True, 2, 4, False)]
    assert [r.kept for r in rows if not r.n_links] == [True, True]
    assert E.embedding_duplicates(vectors(spark, [])).count() == 0
    with pytest.raises(ValueError):
        E.embedding_duplicates(vectors(spark, []), cosine=0.0)


def test_tables_miss_few_pairs():
    for nodes in (10, 10_000, 10_000_000):
        pool = E.tables_for(nodes, 0.9)
        agree = (1 - math.acos(0.9) / math.pi) ** pool.shape[1]
        assert (1 - agree) ** len(pool) <= E.MISSED and all(len(set(row)) == len(row) for row in pool.tolist())
