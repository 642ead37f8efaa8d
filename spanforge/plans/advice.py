"""Queries of models over spans, estimates and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import advice as D
from ..operators import analytics as A
from ..operators import ensemble as N
from ..operators import models as M
from ..operators import privacy as P
from ..operators import spans as S
from .ledger import rounded
from .spans import RULE_SPANS_SQL, _UPPER, _doubled, _spans, _stored_spans, _truth_of
from .tables import LEDGER_SQL, PERFORMANCE_SQL, documents, ledger, performance, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def o120_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(M.chunks(F.col("text"))).alias("chunk", "text"))


_TOKENS = """t AS (SELECT *, (length(token) * 7 + position + 1) % 10 AS h FROM (SELECT doc_id, unnest(w) AS token, unnest(range(0, len(w))) AS position FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\f]+') AS w FROM documents))),
g AS (SELECT doc_id, position, token, CASE WHEN h < 3 THEN 'B-PER' WHEN h < 6 THEN 'I-PER' ELSE 'O' END AS tag, 0.8::DOUBLE + h / 50.0::DOUBLE AS confidence FROM t)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toy tagger: a word's length and place give its tag."""
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "")).alias("position", "token"))
    h = (F.length("token") * 7 + F.col("position") + 1) % 10
    return words.select("doc_id", "position", "token", F.when(h < 3, "B-PER").when(h < 6, "I-PER").otherwise("O").alias("tag"), (0.8 + h / 50.0).alias("confidence"))


@query(f"WITH {_TOKENS}, s AS (SELECT *, sum((tag LIKE 'B-%')::INT) OVER (PARTITION BY doc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS span FROM g WHERE confidence >= 0.82::DOUBLE AND tag <> 'O') SELECT doc_id, string_agg(token, ' ' ORDER BY position) AS text, 'person_name' AS pii_type, min(position) AS start_token FROM s WHERE span > 0 GROUP BY doc_id, span")
def o121_bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bio_spans(tags(spark, sf_dir), 0.82).select("doc_id", "text", "pii_type", F.col("start_token").cast("long").alias("start_token"))


@query(f"WITH {RULE_SPANS_SQL} SELECT CASE WHEN confidence >= 0.9::DOUBLE THEN 'A' WHEN confidence >= 0.8::DOUBLE THEN 'B' WHEN confidence >= 0.7::DOUBLE THEN 'C' ELSE 'D' END AS grade, count(*) AS n FROM spans GROUP BY ALL")
def o123_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).groupBy(M.quality_grade(F.col("confidence")).alias("grade")).agg(F.count("*").alias("n"))


@query()
def o139_meta_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _stored_spans(spark, sf_dir)
    two = M.span_features(_doubled(spans))
    model = M.train_meta(M.labelled(two, _truth_of(spans)))
    return rounded(M.meta(N.exact_groups(two), model))


@query("""WITH c AS (SELECT quality AS t, 1 - toxic AS p, count(*) AS n FROM labels GROUP BY ALL), k AS (SELECT x.k, coalesce((SELECT sum(n) FROM c WHERE t = x.k), 0) AS s, coalesce((SELECT sum(n) FROM c WHERE p = x.k), 0) AS f, coalesce((SELECT sum(n) FROM c WHERE t = x.k AND p = x.k), 0) AS h FROM (SELECT t AS k FROM c UNION SELECT p FROM c) x),
r AS (SELECT s, h, CASE WHEN f > 0 THEN h / f::DOUBLE ELSE 0 END AS p, CASE WHEN s > 0 THEN h / s::DOUBLE ELSE 0 END AS r FROM k)
SELECT round(sum(h) / sum(s)::DOUBLE, 6) AS accuracy, round(sum(s * p) / sum(s), 6) AS precision, round(sum(s * r) / sum(s), 6) AS recall, round(sum(s * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END) / sum(s), 6) AS f1 FROM r""")
def o140_weighted_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.weighted_rates(table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("predicted"))), 6)


@query("SELECT event_id, user_id % 2 = 0 AND event_id % 3 > 0 AS compliant FROM events")
def o153_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 2 == 0).alias("u"), (F.col("event_id") % 3 > 0).alias("v"))
    r = e.select("event_id", *(F.col("u").alias(c) for c in ("consent_obtained", "dpo_designated", "pia_completed")), *(F.col("v").alias(c) for c in ("privacy_policy_available", "breach_procedures")))
    return P.checklist(r, P.LAW25).select("event_id", "compliant")


@query(f"""WITH {RULE_SPANS_SQL}, t AS (SELECT doc_id, count(*) AS n, list({_UPPER}) AS types FROM spans GROUP BY doc_id)
SELECT doc_id, CASE WHEN n > 10 THEN 'High' WHEN n > 5 THEN 'Medium' ELSE 'Low' END AS difficulty, CASE WHEN d.source = 'src1' THEN 'Healthcare' WHEN list_contains(types, 'SSN') OR list_contains(types, 'ID_NUMBER') THEN 'HR' WHEN list_contains(types, 'ORGANIZATION') AND list_contains(types, 'ADDRESS') THEN 'Finance' ELSE 'General' END AS domain FROM t JOIN documents d USING (doc_id)""")
def o166_suggested_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _spans(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(S.upper_type(F.col("pii_type"))).alias("entities"))
    names = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("source") == "src1", "medical.txt").otherwise("a.txt").alias("name"))
    return D.suggest_tags(types.join(names, "doc_id")).select("doc_id", "difficulty", "domain")


@query("SELECT doc_id, round((CASE lang WHEN 'en' THEN 0.7::DOUBLE WHEN 'fr' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END + least(n_chars * 1000 / 1048576.0::DOUBLE / 10, 1) + 0.2::DOUBLE) / 3, 6) AS factor FROM documents")
def o169_content_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "PDF").when(F.col("lang") == "fr", "png").otherwise("odd")
    return rounded(table(spark, sf_dir, "documents").select("doc_id", D.content_factor(kind, F.col("n_chars") * 1000, F.lit(0.2)).alias("factor")), 6)


@query("""WITH i AS (SELECT doc_id, trunc((85 + trunc(n_chars * 1000.0::DOUBLE / 1048576 * 50)) * CASE WHEN doc_id % 2 = 0 THEN 1.5::DOUBLE ELSE 1 END)::INT AS n FROM documents), o AS (SELECT doc_id, n, least(greatest(50, trunc(n * 1.5::DOUBLE)::INT), 2000) AS m FROM i)
SELECT doc_id, n AS input_tokens, m AS output_tokens, round(n / 1000.0::DOUBLE * 0.01::DOUBLE + m / 1000.0::DOUBLE * 0.03::DOUBLE, 6) AS cost FROM o""")
def o171_image_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", D.image_tokens(F.col("n_chars"), F.lit(1000.0), F.col("doc_id") % 2 == 0).alias("input_tokens"))
    d = d.withColumn("output_tokens", D.output_tokens(F.lit("table_extraction"), F.col("input_tokens")))
    return rounded(d.withColumn("cost", D.document_cost(F.col("input_tokens"), F.col("output_tokens"), F.lit(0.01), F.lit(0.03))), 6)


@query(f"WITH {LEDGER_SQL} SELECT model, count(*) AS requests, round(avg(success::INT), 6) AS success_rate, round(avg(processing_time), 6) AS seconds FROM ledger GROUP BY model")
def o177_routing_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ledger(spark, sf_dir).groupBy("model").agg(F.count("*").alias("requests"), F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("success_rate"), F.avg("processing_time").alias("seconds")), 6)


@query(f"""WITH {LEDGER_SQL}, m AS (SELECT model, count(*) AS n, avg(success::INT) AS r, avg(processing_time) / 5 AS c, substr(model, 2)::INT AS k FROM ledger GROUP BY model)
SELECT model, round(CASE WHEN k % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE * (5 - k % 5) / 5 + 0.3::DOUBLE * r + 0.2::DOUBLE * c, 6) AS score FROM m WHERE k % 5 <= 3""")
def o178_local_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("model", 2, 3).cast("int")
    m = ledger(spark, sf_dir).groupBy("model").agg(F.count("*").alias("requests"), F.count_if("success").alias("successes"), (F.avg("processing_time") / 5).alias("confidence"))
    m = m.withColumns({"loaded": k % 2 == 0, "available": F.lit(True), "size": F.element_at(F.array(*map(F.lit, D.SIZES)), k % 5 + 1)})
    return rounded(D.local_model_scores(m).select("model", "score"), 6)


@query()
def o191_model_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.model_profiles(A.summary(performance(spark, sf_dir), ["model"]), ["accuracy_mean", "cost_mean", "latency_mean"]).drop("accuracy_std"))


@query(f"""WITH {PERFORMANCE_SQL}, o AS (SELECT avg(accuracy_score) AS a, avg(success::INT) AS s FROM performance), m AS (SELECT model, avg(accuracy_score) AS a, avg(cost) AS c FROM performance GROUP BY model), x AS (SELECT max(a) - min(a) AS gap, stddev_samp(c) / avg(c) AS cv, count(*) AS k, max(c) AS d FROM m)
SELECT 'high_accuracy' AS rule, 'info' AS severity, round(a, 4) AS value FROM o WHERE a >= 0.9 UNION ALL SELECT 'low_accuracy', 'high', round(a, 4) FROM o WHERE a < 0.7 UNION ALL SELECT 'success_rate', 'high', round(s, 4) FROM o WHERE s < 0.95 UNION ALL SELECT 'accuracy_gap', 'medium', round(gap, 4) FROM x WHERE gap > 0.2
UNION ALL SELECT 'cost_variation', 'medium', round(cv, 4) FROM x WHERE cv > 0.5 UNION ALL SELECT 'expensive_model', 'medium', round(d, 4) FROM x WHERE d > 0.05 UNION ALL SELECT 'many_models', 'info', k::DOUBLE FROM x WHERE k > 5""")
def o193_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = performance(spark, sf_dir)
    return rounded(D.insights(A.overview(p).select("accuracy", "success_rate"), A.summary(p, ["model"])), 4)


@query("SELECT p_brand AS model, round(p_retailprice, 4) AS price FROM (SELECT p_brand, min(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand) ORDER BY p_retailprice, p_brand LIMIT 1")
def o213_cheapest_able(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("model")).agg(F.min("p_retailprice").alias("price")).withColumns({"vision": F.lit(True), "available": F.lit(True), "quality": F.lit(0.5)})
    return rounded(D.cheapest_able(m).select("model", "price"))


@query("SELECT o_orderpriority AS kind, count(*) AS backups, round(sum(o_totalprice), 2) AS bytes, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 30 DAY) AS expired FROM orders GROUP BY ALL")
def o217_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("bytes"), F.col("o_orderdate").alias("created_at"))
    return rounded(D.backups(b, F.lit("1998-01-01").cast("timestamp")), 2)
