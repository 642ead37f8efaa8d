"""Matching of both sides in the row of their document, against matching of two tables of spans."""

import random

from pyspark.sql import functions as F

from spanforge.operators import evaluate as V

SPAN = "struct<start_pos:int,end_pos:int,text:string,pii_type:string>"


def _rows(spark):
    draw = random.Random(5)
    kinds = ("person_name", "name", "location", "address", "phone_number", "odd", None)

    def spans():
        n = draw.choice((0, 1, 4, 12))
        return [(s, s + draw.randint(1, 6), draw.choice(("ann lee", "lee", "12 main st", "")), draw.choice(kinds)) for s in (draw.randint(0, 20) for _ in range(n))]

    rows = [(i, f"m{i % 2}", spans(), spans()) for i in range(60)]
    rows += [(60, "m0", None, spans()), (61, "m1", spans(), None), (62, "m0", None, None), (None, "m1", [(0, 3, "lee", "name")], [(0, 3, "lee", "person")])]
    return spark.createDataFrame(rows, f"doc_id long, model string, spans array<{SPAN}>, truth array<{SPAN}>")


def _tables(rows):
    return (rows.select("doc_id", "model", F.inline(c)).filter("pii_type IS NOT NULL") for c in ("spans", "truth"))


def _typed(rows):
    keep = lambda c: F.filter(c, lambda s: s["pii_type"].isNotNull())
    return rows.withColumns({"spans": keep("spans"), "truth": keep("truth")})


def test_matches_in_row_equal_those_of_tables(spark):
    rows = _typed(_rows(spark)).filter("doc_id IS NOT NULL")  # a join on doc_id drops nulls
    predicted, truth = _tables(rows)
    want = sorted(map(tuple, V.match(predicted.drop("model"), truth.drop("model")).collect()))
    assert want and sorted(map(tuple, V.match_in_row(rows).collect())) == want


def test_counts_in_row_equal_those_of_tables(spark):
    rows = _typed(_rows(spark)).filter("doc_id IS NOT NULL")
    predicted, truth = _tables(rows)
    want = sorted(map(tuple, V.counts(predicted, truth, ("model",), ("doc_id", "model")).collect()))
    assert want and sorted(map(tuple, V.counts_in_row(rows, by=("model",)).collect())) == want


def test_null_key_and_type_in_row(spark):
    rows = _rows(spark)
    assert V.match_in_row(rows.filter("doc_id IS NULL")).select("kind", "score").collect() == [("person_name", 1.0)]
    made = rows.select(F.inline("spans")).count(), rows.select(F.inline("truth")).count()
    total = V.counts_in_row(rows).agg(F.sum(F.col("tp") + F.col("fp")), F.sum(F.col("tp") + F.col("fn"))).first()
    assert tuple(total) == made  # spans without a type are counted too
    assert V.counts_in_row(rows.limit(0)).collect() == [] == V.match_in_row(rows.limit(0)).collect()


def test_in_row_exchanges_only_sums(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    stored = _rows(spark)
    assert "Exchange" not in plan(V.match_in_row(stored)) and plan(V.counts_in_row(stored)).count("Exchange") == 1
