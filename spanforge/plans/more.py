"""Queries of lookups, orders, summaries and dispatch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import dispatch as X
from ..operators import evaluate as V
from ..operators import extract as E
from ..operators import ledger as L
from ..operators import privacy as P
from ..operators import quality as Q
from ..operators import routing as R
from ..sources import files
from .ledger import batch_documents, rounded
from .spans import _BLOCKS, _MATCHED, RULE_SPANS_SQL, _rewritten, _doubled, _spans, _stored_spans, _truth_of, _two
from .tables import LEDGER_SQL, PERFORMANCE_SQL, documents, ledger, performance, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def o029_queue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'Good' WHEN 0 THEN 'Bad' END, 'Unknown') AS tag FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality = 1")
def o030_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tag = F.coalesce(F.when(F.col("quality") == 1, "Good").when(F.col("quality") == 0, "Bad"), F.lit("Unknown"))
    return d.select("doc_id", tag.alias("tag")).filter(F.col("tag").isin("Unknown", "Good"))


@query("SELECT doc_id FROM documents WHERE list_contains([lang, source], 'src3') AND lang = 'en'")
def o031_tag_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.array_contains(F.array("lang", "source"), "src3") & (F.col("lang") == "en")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#1' OR contains(p_name, 'a')")
def o034_experiments_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter((F.col("p_brand") == "Brand#1") | F.contains("p_name", F.lit("a"))).select("p_partkey")


@query("""WITH o AS (SELECT o_custkey AS batch_id, o_orderstatus AS s, o_totalprice AS cost FROM orders) SELECT batch_id, count(*) AS documents, count(*) FILTER (WHERE s = 'F') AS done, round(100.0::DOUBLE * count(*) FILTER (WHERE s = 'F') / count(*), 4) AS done_percent, round(sum(cost), 4) AS cost FROM o GROUP BY batch_id""")
def o064_batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = L.batch_status(batch_documents(spark, sf_dir))
    return rounded(b.select("batch_id", F.col("total").alias("documents"), F.col("completed").alias("done"), (100.0 * F.col("completed") / F.col("total")).alias("done_percent"), "cost"))


@query(f"WITH {RULE_SPANS_SQL} SELECT pii_type, lang AS model, count(*) AS n, round(avg(confidence), 6) AS confidence FROM spans GROUP BY ALL")
def o074_types_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.rule_spans(documents(spark, sf_dir), key=("doc_id", "lang"))
    return rounded(s.groupBy("pii_type", F.col("lang").alias("model")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")), 6)


@query("SELECT o_custkey AS document_id, o_orderkey AS annotation FROM orders WHERE o_orderstatus IN ('F', 'P') QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, o_orderdate DESC, o_orderkey DESC) = 1")
def o100_latest_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed annotations come before completed ones, then the last."""
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P")).withColumn("reviewed", (F.col("o_orderstatus") == "F").cast("int"))
    return A.latest(o, ["o_custkey"], ["reviewed", "o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("annotation"))


@query("SELECT doc_id, priority, row_number() OVER (ORDER BY priority DESC, doc_id) AS place FROM (SELECT doc_id, round((1 - n_chars % 100 / 100.0::DOUBLE) * 10 + 5 * (n_chars % 2), 6) AS priority FROM documents)")
def o110_review_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place."""
    n = F.col("n_chars")
    rows = rounded(table(spark, sf_dir, "documents").select("doc_id", ((1 - n % 100 / 100.0) * 10 + 5 * (n % 2)).alias("priority")), 6)
    return R.numbered(rows, [F.desc("priority"), F.col("doc_id")], "place")


@query(f"WITH {PERFORMANCE_SQL} SELECT model, round(avg(accuracy_score) / avg(cost), 4) AS value FROM performance GROUP BY model ORDER BY value DESC, model LIMIT 3")
def o112_best_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = performance(spark, sf_dir).groupBy("model").agg(F.avg("accuracy_score").alias("quality"), F.avg("cost").alias("cost"))
    return rounded(R.best_value(m, 3).select("model", "value"))


@query(f"WITH {RULE_SPANS_SQL} SELECT DISTINCT doc_id, lower(text) AS text, pii_type FROM spans")
def o116_distinct_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _two(spark, sf_dir)
    return both.select("doc_id", F.lower("text").alias("text"), "pii_type").distinct()


@query()
def o141_dispatched_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.extract(documents(spark, sf_dir), "first").select("doc_id", "text", "pii_type", "confidence", "start_pos", "extractor"))


@query(_MATCHED + """ SELECT doc_id, text, pii_type, round(confidence, 6) AS confidence, start_pos, end_pos, extractor FROM spans
WHERE NOT EXISTS (FROM m JOIN said USING (doc_id, kind, i) WHERE said.doc_id = spans.doc_id AND said.start_pos = spans.start_pos AND said.end_pos = spans.end_pos AND said.text = spans.text)
ORDER BY spans.confidence DESC, doc_id, start_pos, pii_type LIMIT 10""")
def o144_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten likeliest predictions that no truth matches."""
    p = _stored_spans(spark, sf_dir)
    hit = V.match(p, _truth_of(p)).select("doc_id", F.col("p_start").alias("start_pos"), F.col("p_end").alias("end_pos"), F.col("p_text").alias("text"))
    return rounded(p.join(hit, ["doc_id", "start_pos", "end_pos", "text"], "left_anti").orderBy(F.desc("confidence"), "doc_id", "start_pos", "pii_type").limit(10).drop("context"))


@query("SELECT event_id, event_type AS text, 'EVENT' AS pii_type, (event_id % 9)::INT AS start_pos, round(CASE WHEN event_id % 2 = 0 THEN value / 1000 ELSE 1 END, 6) AS confidence FROM events")
def o146_coerced_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities under two sets of names, half of them without a score."""
    e, even = table(spark, sf_dir, "events"), F.col("event_id") % 2 == 0
    a = F.to_json(F.struct(F.col("event_type").alias("text"), F.lit("EVENT").alias("type"), (F.col("event_id") % 9).alias("start_pos"), (F.col("value") / 1000).alias("confidence")))
    b = F.to_json(F.struct(F.col("event_type").alias("value"), F.lit("EVENT").alias("label"), (F.col("event_id") % 9).alias("start")))
    return rounded(files.coerced(e.select("event_id", F.when(even, a).otherwise(b).alias("json"))).select("event_id", "text", "pii_type", "start_pos", "confidence"), 6)


@query()
def o147_models_against_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro means over documents of each model's rates."""
    spans = _stored_spans(spark, sf_dir)
    per = V.rates(X.cross_evaluate(_doubled(spans), _truth_of(spans), V.counts))
    return rounded(per.groupBy("model").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.countDistinct("doc_id").alias("documents")), 6)


@query(f"WITH {RULE_SPANS_SQL} SELECT CASE WHEN confidence < 0.3::DOUBLE THEN 'very_low' WHEN confidence < 0.5::DOUBLE THEN 'low' WHEN confidence < 0.7::DOUBLE THEN 'medium' WHEN confidence < 0.9::DOUBLE THEN 'high' ELSE 'very_high' END AS level, count(*) AS n FROM spans GROUP BY ALL")
def o157_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).groupBy(Q.level(F.round("confidence", 6), Q.LEVELS).alias("level")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS documents, round(sum(CASE lang WHEN 'en' THEN 0.02::DOUBLE ELSE 0.03::DOUBLE END * (1 + n_chars / 5000.0::DOUBLE)), 6) AS cost FROM documents GROUP BY source")
def o172_labelling_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.when(F.col("lang") == "en", 0.02).otherwise(0.03)
    return rounded(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(price * (1 + F.col("n_chars") / 5000)).alias("cost")), 6)


@query(f"WITH {LEDGER_SQL}, m AS (SELECT provider, model, avg(estimated_cost) AS c FROM ledger GROUP BY ALL) SELECT provider, model, arg_min(model, row(c, model)) OVER (PARTITION BY provider) AS cheaper FROM m")
def o174_cheaper_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ledger(spark, sf_dir).groupBy("provider", "model").agg(F.avg("estimated_cost").alias("c"))
    return m.select("provider", "model", F.min_by("model", F.struct("c", "model")).over(Window.partitionBy("provider")).alias("cheaper"))


@query(f"WITH {PERFORMANCE_SQL} SELECT 'accuracy' AS measure, round(avg(accuracy_score), 4) AS value FROM performance UNION ALL SELECT 'cost', round(sum(cost), 4) FROM performance UNION ALL SELECT 'success_rate', round(avg(success::INT), 4) FROM performance")
def o194_executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = A.overview(performance(spark, sf_dir))
    return rounded(one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("accuracy", "cost", "success_rate"))))))


@query("SELECT 'b1' AS batch_id, count(*) AS documents, 'created' AS status FROM documents")
def o208_new_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"))
    return R.new_batch(d, "b1", datetime(2024, 1, 1))[0].select("batch_id", "documents", "status")


@query(_rewritten(_BLOCKS))
def o151_protected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir)
    return X.protect(found.select("doc_id", "text"), P.without_overlaps(X.extract(found, "rule_based")), "redaction")
