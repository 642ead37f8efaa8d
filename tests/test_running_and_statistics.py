"""Prefix scans, exact percentiles, statistics and shaped tokens, against brute force."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import stats
from spanforge.operators import analytics as A
from spanforge.operators import ledger as L
from spanforge.operators import scan as C
from spanforge.operators import shaped as H


def series(spark, n=700, keys=("hot", "cold", None)):
    rng = random.Random(n)
    rows = [(keys[0] if rng.random() < 0.9 else rng.choice(keys), i // 3, i, round(rng.uniform(-5, 5), 3) if rng.random() < 0.95 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, at long, id long, v double").repartition(5)


@pytest.mark.parametrize("block", [2, 16, C.BLOCK])
def test_scans_over_one_hot_key(spark, block):
    rows, df = series(spark)
    lift = {"s": F.coalesce("v", F.lit(0.0)), "n": F.lit(1).cast("long"), "last": F.array("id")}
    zero = {"s": F.lit(0.0), "n": F.lit(0).cast("long"), "last": F.array().cast("array<bigint>")}
    add, _ = C.sums("s", "n")
    out = C.scanned(df, ["k"], ["at", "id"], lift, lambda a, b: add(a, b) | C.lasts(4)(a, b), zero, block).collect()
    assert len(out) == len(rows)
    seen = {}
    got = {r.id: r for r in out}
    for k, _, i, v in sorted(rows, key=lambda r: r[2]):
        own = seen.setdefault(k, [])
        assert got[i]["_before"]["n"] == len(own) and got[i]["_before"]["last"] == [x for x, _ in own[-4:]]
        own.append((i, v or 0.0))
        assert got[i]["_upto"]["s"] == pytest.approx(sum(x for _, x in own), abs=1e-9) and got[i]["_upto"]["last"] == [x for x, _ in own[-4:]]


def test_long_exponential_average(spark):
    """So long that what is kept of the first row is no more than 0."""
    rows, df = series(spark, 12_000, ("one",))
    want = 0.0
    for *_, v in sorted(rows, key=lambda r: r[2]):
        want = 0.9 * want + 0.1 * (v or 0.0)
    got = L.ema(df, ["k"], ["at", "id"], "v").collect()
    assert [(r.k, r.n) for r in got] == [("one", 12_000)] and got[0].ema == pytest.approx(want)


def test_rolling_mean_and_budget(spark):
    rows, df = series(spark, 300)
    got = {r.id: r.rolling_mean for r in A.rolling_mean(df, ["k"], ["at", "id"], "v", 3).collect()}
    for k in ("hot", "cold", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: r[2])
        for j, r in enumerate(own):
            near = [x[3] for x in own[max(j - 2, 0) : j + 1] if x[3] is not None]
            assert got[r[2]] == (pytest.approx(statistics.fmean(near)) if near else None)
    few = spark.createDataFrame([("a", 1, 5.0), ("a", 2, None), ("a", 3, 6.0), ("a", 4, 1.0)], "k string, at long, c double")
    assert [r["at"] for r in sorted(L.within_budget(few, ["k"], ["at"], "c", F.lit(10.0)).collect(), key=lambda r: r["at"])] == [1, 2, 3]


def test_places_are_whole(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit(1).alias("same")).repartition(7)
    assert all(r["_place"] == r["x"] for r in C.placed(df, ["x"]).collect())
    assert sorted(r["_place"] for r in C.placed(df, ["same"]).collect()) == list(range(1000))


@pytest.mark.parametrize("by", [["k"], []])
def test_percentiles(spark, by):
    rng = random.Random(3)
    values = {"a": [rng.lognormvariate(0, 3) for _ in range(501)], "b": [1.5] * 40, "c": [-1e300, 1e300, 0.0], "d": [7.0], "e": [float(rng.randrange(5)) for _ in range(100)], None: [2.0, 1.0], "n": [None, None]}
    rows = [(k, v) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = [0.0, 0.25, 0.5, 0.95, 1.0]
    got = {(r.k if by else "all"): r.q for r in C.percentiles(df, by, "v", shares).collect()}
    groups = {k: [v for v in vs if v is not None] for k, vs in values.items()} if by else {"all": [v for _, v in rows if v is not None]}
    assert set(got) == {k for k, v in groups.items() if v}
    for k, q in got.items():
        own = sorted(groups[k])
        for share, x in zip(shares, q, strict=True):
            at = share * (len(own) - 1)
            low, high = own[math.floor(at)], own[min(math.floor(at) + 1, len(own) - 1)]
            assert x == pytest.approx(low if low == high else (math.floor(at) + 1 - at) * low + (at - math.floor(at)) * high)
    assert C.percentiles(df.filter("v is null"), by, "v", [0.5]).count() == 0


def tail_by_steps(f, d1, d2, steps=400_000):
    """P(F > f) by the midpoint rule over the density of x = d1 f / (d1 f + d2)."""
    low = d1 * f / (d1 * f + d2)
    top = min(1.0, low + 400 / d2)  # what lies beyond is below exp(-200)
    edges = np.linspace(0, 1, steps + 1)
    edges = low + (1 - low) * (1 - (1 - edges) ** 2) if top == 1 else low + (top - low) * edges
    x = (edges[1:] + edges[:-1]) / 2
    ln = math.lgamma((d1 + d2) / 2) - math.lgamma(d1 / 2) - math.lgamma(d2 / 2)
    return float((np.exp(ln + (d1 / 2 - 1) * np.log(x) + (d2 / 2 - 1) * np.log1p(-x)) * np.diff(edges)).sum())


def test_tails_and_quantiles(spark):
    cases = [(0.3, 2, 9), (1.0, 4, 20), (3.2, 1, 8), (5.5, 6, 400), (0.9, 9, 5000), (2.1, 3, 40_000)]
    df = spark.createDataFrame(cases, "f double, a long, b long")
    for r in df.select("*", stats.f_tail(F.col("f"), F.col("a"), F.col("b")).alias("p")).collect():
        assert r.p == pytest.approx(tail_by_steps(r.f, r.a, r.b), abs=2e-6)
    known = {1: 12.706205, 2: 4.302653, 5: 2.570582, 10: 2.228139, 28: 2.048407}
    rows = spark.createDataFrame([(k,) for k in known], "df long").select("df", stats.t_quantile(0.95, F.col("df")).alias("t")).collect()
    assert {r.df: round(r.t, 6) for r in rows} == known
    back = spark.createDataFrame([(t, k) for k, t in known.items()], "t double, df long").select(stats.t_tails(F.col("t"), F.col("df")).alias("p")).collect()
    assert all(r.p == pytest.approx(0.05, abs=1e-7) for r in back)
    gammas = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.5, 10.0, 12345.5)], "x double").select("x", stats.ln_gamma(F.col("x")).alias("g")).collect()
    assert all(r.g == pytest.approx(math.lgamma(r.x), abs=1e-9, rel=1e-12) for r in gammas)
    edges = df.limit(1).select(stats.f_tail(F.lit(None).cast("double"), F.lit(1), F.lit(1)).alias("n"), stats.f_tail(F.lit(1.0), F.lit(1), F.lit(0)).alias("z"), stats.t_tails(F.lit(0.0), F.lit(4)).alias("one"))
    assert [tuple(r) for r in edges.collect()] == [(None, None, 1.0)]


def test_group_statistics(spark):
    rng = random.Random(6)
    a, b = [rng.gauss(0, 1) for _ in range(12)], [rng.gauss(1, 1) for _ in range(9)]
    df = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b] + [("a", None), (None, 3.0)], "g string, v double")
    r = A.two_groups(df, "g", "v").first()
    pooled = math.sqrt((11 * statistics.variance(a) + 8 * statistics.variance(b)) / 19)
    assert r.df == 19 and r.d == pytest.approx((statistics.fmean(a) - statistics.fmean(b)) / pooled)
    f = A.anova_tail(df.filter("g is not null"), "g", "v").first()
    assert f.f == pytest.approx(r.t**2) and f.p == pytest.approx(r.p)  # two groups: F is the square of t
    assert A.two_groups(df.filter("g = 'a'"), "g", "v").count() == 0
    assert A.two_groups(df.unionAll(spark.createDataFrame([("c", 1.0)], "g string, v double")), "g", "v").count() == 0
    i = {x.g: x for x in A.t_interval(df, ["g"], "v").collect()}
    half = 2.200985 * statistics.stdev(a) / math.sqrt(12)
    assert i["a"].low == pytest.approx(statistics.fmean(a) - half, abs=1e-5) and i[None].low is None


def test_variance_shares(spark):
    rng = random.Random(7)
    rows = [(str(x), str(y), str(z), 5.0 * x + 2.0 * (y == z) + rng.gauss(0, 0.1)) for x in range(3) for y in range(2) for z in range(2) for _ in range(5)]
    got = {r.source: r for r in A.variance_shares(spark.createDataFrame(rows, "x string, y string, z string, v double"), ["x", "y", "z"], "v").collect()}
    assert sum(r.share for r in got.values()) == pytest.approx(1) and got["rest"].rank is None
    assert got["x"].rank == 1 and got["y*z"].rank == 2 and got["x"].share > 0.9 and got["rest"].share < 0.01


def test_shaped_tokens_are_a_bijection(spark):
    df = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("text"), F.lit("pin").alias("pii_type"))
    out = H.shaped_spans(df, "s").collect()
    assert {r.token for r in out} == {f"{k:04}" for k in range(10_000)} and sum(r.token == r.text for r in out) < 20
    one = H.shaped_spans(spark.createDataFrame([(c, "x") for c in "0123456789abcXYZ"], "text string, pii_type string"), "s").collect()
    assert len({r.token for r in one}) == 16 and all(r.token.isdigit() == r.text.isdigit() and r.token.islower() == r.text.islower() for r in one)


def test_shaped_tokens_round_trip(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("0123456789abcXYZ-. @é\n") for _ in range(rng.randrange(0, 90))) for _ in range(120)] + ["4111-1111 1111 1111", "a.b@c.org", "7" * 200, "", None]
    df = spark.createDataFrame([(t, "card" if i % 2 else "mail") for i, t in enumerate(texts)], "text string, pii_type string")
    tokens = H.shaped_spans(df, "secret")
    rows = H.unshaped_spans(tokens.withColumnRenamed("text", "was"), "secret").collect()
    for r in rows:
        assert r.text == r.was
        if r.was:
            kind = lambda c: "d" if c in "0123456789" else "l" if c in "abcdefghijklmnopqrstuvwxyz" else "u" if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c
            assert list(map(kind, r.token)) == list(map(kind, r.was))
    other = H.unshaped_spans(tokens.drop("text"), "another").collect()
    assert sum(r.text == t for r, t in zip(other, texts, strict=True)) < 15
