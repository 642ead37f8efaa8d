"""Small tests of what the third review found."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge import plans
from spanforge.functions import stats
from spanforge.operators import analytics as A
from spanforge.operators import ensemble as N
from spanforge.operators import models as M
from spanforge.operators import scan as C
from spanforge.operators import spans as S
from spanforge.operators import tagger as G


def test_mean_on_the_threshold_passes_in_any_order(spark):
    """F1: three members of 0.7, or 0.9, 0.8, 0.55 and 0.55 in any order, have a mean of just 0.7."""
    groups = [(0.7, 0.7, 0.7), *itertools.permutations((0.9, 0.8, 0.55, 0.55))]
    rows = [(d, "a b", "x", c, 0, k, k + 3) for d, g in enumerate(groups) for k, c in enumerate(g)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type string, confidence double, extractor_rank int, start_pos int, end_pos int").coalesce(1)
    got = {r.doc_id: r.confidence for r in N.exact_vote(df, "weighted").collect()}
    assert got == {d: 0.7 for d in range(len(groups))}


def test_halves_of_a_millionth_round_alike(spark):
    """means of 32 members that end in half a millionth are rounded up, as the SQL does."""
    rows = [(d, "a b", "x", c, 0, k, k + 3) for d in range(1, 32, 2) for k, c in enumerate([0.9] * d + [0.89] * (32 - d))]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type string, confidence double, extractor_rank int, start_pos int, end_pos int")
    got = {r.doc_id: r.confidence for r in N.exact_vote(df, "weighted").collect()}
    assert got == {d: (2 * (890000 * 32 + 10000 * d) + 32) // 64 / 1e6 for d in range(1, 32, 2)}


def test_documents_on_the_threshold_are_accepted(spark):
    """F2: a mean of just 0.7 is enough in any order, and halves of a millionth round up."""
    groups = [(0.7, 0.7, 0.7), *itertools.permutations((0.9, 0.8, 0.55, 0.55)), *((0.9,) * d + (0.89,) * (32 - d) for d in range(1, 32, 2))]
    df = spark.createDataFrame([(d, c) for d, g in enumerate(groups) for c in g], "doc_id long, confidence double").coalesce(1)
    got = {r.doc_id: (r.spans, r.mean, r.accepted) for r in S.accept(df).collect()}
    hundredths = [sum(round(100 * c) for c in g) for g in groups]
    assert got == {d: (len(g), (20000 * h + len(g)) // (2 * len(g)) / 1e6, True) for d, (g, h) in enumerate(zip(groups, hundredths, strict=True))}


@pytest.mark.parametrize("rows", [3_000, 600_000])
def test_sql_of_the_anova_tail_holds_for_many_rows(spark, rows):
    """for five groups the tail of F has a closed form."""
    con = duckdb.connect()
    con.execute("create table orders as select i as o_orderkey, timestamp '1996-01-01' as o_orderdate, 'm' || (i % 5) as o_orderpriority, 1.0::DOUBLE as o_totalprice, 'O' as o_orderstatus from range(5) t(i)")
    con.execute(f"""create table lineitem as select i % 5 as l_orderkey, i as l_linenumber, i as l_partkey, 1.0::DOUBLE as l_extendedprice, (hash(i) % 50 + CASE WHEN i % 5 = 1 THEN {60 / rows**0.5} ELSE 0 END)::DOUBLE as l_quantity,
        0.0::DOUBLE as l_discount, 'A' as l_returnflag, 1 as l_suppkey, timestamp '1996-01-01' as l_shipdate from range({rows}) t(i)""")
    df1, df2, f, p = con.execute(f"select df_between, df_within, f, p from ({plans.ORACLE_SQL['o187_anova_tail']})").fetchone()
    v = [np.array(x) for x, in con.execute("select list(l_quantity) from lineitem group by l_orderkey").fetchall()]
    mean = np.concatenate(v).mean()
    exact = sum(len(x) * (x.mean() - mean) ** 2 for x in v) / 4 / (sum(((x - x.mean()) ** 2).sum() for x in v) / (rows - 5))
    x, a = df2 / (df2 + 4 * exact), df2 / 2
    assert (df1, df2, f) == (4, rows - 5, round(exact, 4))
    assert p == pytest.approx(x**a * (1 + a * (1 - x)), abs=1e-6)
    assert p == pytest.approx(spark.range(1).select(stats.f_tail(F.lit(exact), F.lit(df1), F.lit(df2))).first()[0], abs=1e-6)


def test_errors_have_their_wait(spark):
    """the column that an earlier change took from the query and its SQL."""
    d = "/root/testdata/sf0.001"
    rows = plans.QUERIES["o195_error_category"](spark, d).collect()
    assert rows and all(r.wait == min(2 ** (r.event_id % 8), 60) for r in rows)
    assert "AS wait" in plans.ORACLE_SQL["o195_error_category"]


def test_tasks_keep_only_the_ends_of_a_group(spark):
    """the rows between are left out before rows are dealt by group; nulls and a null group count as before."""
    rows = [(None if k % 7 == 0 else f"g{k % 3}", k, None if k % 11 == 0 else float(k % 13)) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, at int, v double").repartition(6)
    out = A.ends_compared(df, ["g"], ["at"], "v")
    want = {}
    for g in {r[0] for r in rows}:
        own = [v for h, _, v in rows if h == g]
        mean = lambda x: sum(y for y in x if y is not None) / sum(y is not None for y in x)
        want[g] = (mean(own[:5]), mean(own[-5:]))
    got = {r.g: (r["first"], r["last"]) for r in out.collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "Partial" in plan


def test_profiles_read_the_summary_once(spark):
    """neither the steps of the fit nor the result go back to the rows that were summed up."""
    rows = spark.range(600).select((F.col("id") % 6).alias("model"), (F.col("id") % 6 * 10.0 + F.col("id") % 5).alias("a"))
    out = M.model_profiles(rows.groupBy("model").agg(F.avg("a").alias("a")), ["a"])
    assert out.select("profile").distinct().count() == 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "Exchange" not in plan


def test_windows_are_tagged_abreast():
    """F5, F8: sequences of any length get what each gets alone, in a number of steps that grows with the longest and not with all."""
    rng = np.random.default_rng(5)
    tags = ["B-x", "I-x", "O"]
    step, shows = rng.random((3, 3)) + 0.01, rng.random((3, G.SHAPES)) ** 8 + 1e-9
    step[[0, 1, 2], [2, 2, 1]] = 0.5, 0.5, 0.0
    with np.errstate(divide="ignore"):
        model = G.Tagger(tags, np.log(step / step.sum(1, keepdims=True)), np.log(shows / shows.sum(1, keepdims=True)))
    several = sorted((list(rng.integers(0, G.SHAPES, n)) for n in (0, 1, 1, 2, 7, 7, 40, 900)), key=len, reverse=True)
    each = model.likeliest_each(several)
    assert each == [model.likeliest(s) for s in several] and [len(e) for e in each] == [len(s) for s in several]
    ranges = [[(0, 1, best[:1])] if best else [] for best in each]
    assert model.shares_each(several, ranges) == [pytest.approx(model.shares(s, r)) for s, r in zip(several[:-1], ranges, strict=False)] + [[]]
    texts = ["Call 555-1234 now. " * k for k in (3, 0, 700, 1)]
    assert model(texts) == [model([t])[0] for t in texts]


@pytest.mark.parametrize("stretch", [1, 7, 64, C.STRETCH])
def test_trailing_rows_reach_across_stretches(spark, stretch):
    """the mean of five rows is a window over stretches of places, not a fold of arrays; rows are found wherever they are cut."""
    rows = [(None if k % 9 == 0 else f"g{k % 2}", k, None if k % 4 == 0 else float(k * k % 23)) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, at int, v double").repartition(5)
    got = {r.at: r.m for r in C.trailed(df, ["g"], ["at"], 5, lambda w: F.avg("v").over(w), "m", stretch).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        for i, (_, at, _) in enumerate(own):
            last = [v for _, _, v in own[max(i - 4, 0) : i + 1] if v is not None]
            assert got[at] == (pytest.approx(sum(last) / len(last)) if last else None)
    plan = A.rolling_mean(df, ["g"], ["at"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan


@pytest.mark.parametrize("name", ["o144_false_positives", "o147_models_against_truth", "o139_meta_votes"])
def test_texts_are_searched_once(spark, name):
    """predictions and what is made of them come from spans that are written once, and no search is left in the plan."""
    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Scan ExistingRDD" in plan and "documents.parquet" not in plan and "regexp_replace" not in plan


def test_answers_come_from_one_search(spark):
    """the test for documents with spans does not search the text a second time."""
    plan = plans.QUERIES["o122_answer_spans"](spark, "/root/testdata/sf0.001").select("doc_id")._jdf.queryExecution().optimizedPlan()
    filters = [line for line in plan.toString().splitlines() if line.strip(" +-:").startswith("Filter")]
    assert not any("regexp_replace" in line for line in filters) and "Generate" in plan.toString()


def test_cards_are_dealt_to_all_cores(spark):
    """the customers of one small file are searched by more than one task."""
    assert plans.QUERIES["o119_dictionary_spans"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
