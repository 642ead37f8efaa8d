"""Queries over the usage ledger and the run history."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger as L
from .tables import LEDGER_SQL, RESULTS_SQL, RUNS_SQL, ledger, results, runs, table

QUERIES, ORACLE_SQL = {}, {}
DAY, AS_OF = date(2024, 1, 10), datetime(2024, 1, 31)


def query(sql: str | None = None):
    """Registers a query, and the SQL it is held against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


M = "count(*) AS requests, coalesce(sum(total_tokens), 0)::BIGINT AS tokens, round(coalesce(sum(estimated_cost), 0), 4) AS cost, count(*) FILTER (WHERE success) AS successes"
WITH = f"WITH {LEDGER_SQL} "
HISTORY = f"WITH {RUNS_SQL}, {RESULTS_SQL} "


@query(WITH + """SELECT session_id, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens,
  round(sum(estimated_cost), 4) AS estimated_cost, round(coalesce(sum(actual_cost), 0), 4) AS actual_cost, round(avg(processing_time), 4) AS avg_processing_time, count(*) FILTER (WHERE success) AS successes,
  count(*) FILTER (WHERE NOT success) AS failures, round(100.0::DOUBLE * count(*) FILTER (WHERE success) / count(*), 4) AS success_rate FROM ledger GROUP BY session_id""")
def o045_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.session_summary(ledger(spark, sf_dir)))


@query(WITH + f"SELECT session_id, provider, {M} FROM ledger GROUP BY ALL")
def o046_session_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.by_provider(ledger(spark, sf_dir)))


@query(WITH + f"SELECT provider || '/' || model AS model_key, {M} FROM ledger GROUP BY ALL")
def o046_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.by_model(ledger(spark, sf_dir)))


@query(WITH + "SELECT provider, count(*) AS requests, round(coalesce(sum(estimated_cost), 0), 4) AS cost FROM ledger WHERE timestamp >= DATE '2024-01-10' AND timestamp < DATE '2024-01-11' GROUP BY ROLLUP (provider)")
def o047_daily_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.daily_cost(ledger(spark, sf_dir), DAY))


@query(WITH + "SELECT provider, CAST(timestamp AS DATE) AS day, count(*) AS requests, round(coalesce(sum(estimated_cost), 0), 4) AS cost FROM ledger WHERE timestamp >= DATE '2024-01-01' AND timestamp < DATE '2024-02-01' GROUP BY GROUPING SETS ((provider), (CAST(timestamp AS DATE)), ())")
def o048_monthly_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.monthly_cost(ledger(spark, sf_dir), 2024, 1))


@query(WITH + f"SELECT CAST(timestamp AS DATE) AS day, {M} FROM ledger WHERE timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31' GROUP BY ALL")
def o049_cost_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.cost_trend(ledger(spark, sf_dir), AS_OF))


@query(WITH + f"SELECT provider, model, {M}, round(avg(estimated_cost), 4) AS avg_cost FROM ledger GROUP BY provider, model ORDER BY sum(estimated_cost) DESC, provider, model LIMIT 10")
def o050_top_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.top_models(ledger(spark, sf_dir)))


@query(WITH + "SELECT strftime(timestamp, '%H') AS hour, count(*) AS requests, round(avg(estimated_cost), 4) AS avg_cost FROM ledger GROUP BY ALL")
def o051_hourly_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.hourly_pattern(ledger(spark, sf_dir)))


@query(WITH + "SELECT provider, model, error_message, count(*) AS errors FROM ledger WHERE NOT success GROUP BY ALL")
def o052_error_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.error_analysis(ledger(spark, sf_dir))


@query(WITH + "SELECT count(*) AS requests, round(sum(estimated_cost), 4) AS cost, sum(total_tokens)::BIGINT AS tokens, round(sum(estimated_cost) / count(*), 4) AS avg_cost FROM ledger")
def o053_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.overall(ledger(spark, sf_dir)))


_BATCHED = "o AS (SELECT o_custkey AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status, o_totalprice AS cost FROM orders)"


def batch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("pending")
    return o.select(F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("document_id"), status.alias("status"), F.col("o_totalprice").alias("cost"), F.col("o_orderdate").alias("created_at"))


@query(f"""WITH {_BATCHED}, b AS (SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, round(sum(cost), 4) AS cost FROM o GROUP BY ALL)
SELECT *, CASE WHEN completed + failed < total THEN 'processing' WHEN failed = 0 THEN 'completed' ELSE 'completed_with_errors' END AS batch_status FROM b""")
def o054_batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.batch_status(batch_documents(spark, sf_dir)))


_PERF = """count(DISTINCT d.run_id) AS total_runs, count(*) AS total_documents, round(sum(cost), 4) AS total_cost, sum(entities_found)::BIGINT AS total_entities, round(avg(processing_time), 4) AS avg_processing_time,
  round(avg(confidence), 4) AS avg_confidence, round(avg(success::INT), 4) AS success_rate, round(sum(cost) / count(*), 4) AS cost_per_document FROM runs r JOIN results d ON r.id = d.run_id"""


_PERF_FINE = _PERF.replace(", 4)", ", 7)")


@query(HISTORY + f"SELECT model_used, CAST(r.timestamp AS DATE) AS day, {_PERF_FINE} GROUP BY ALL")
def o055_model_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.model_performance(runs(spark, sf_dir), results(spark, sf_dir)), 7)


@query(HISTORY + f"SELECT model_used, {_PERF} WHERE r.timestamp >= TIMESTAMP '1996-01-01' AND r.timestamp < TIMESTAMP '1997-01-01' GROUP BY ALL")
def o056_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = runs(spark, sf_dir).filter((F.col("timestamp") >= F.lit(datetime(1996, 1, 1))) & (F.col("timestamp") < F.lit(datetime(1997, 1, 1))))
    return rounded(L.model_performance(year, results(spark, sf_dir), ["model_used"]))


@query(HISTORY + "SELECT model_used, CAST(r.timestamp AS DATE) AS day, count(*) AS documents, round(sum(cost), 7) AS cost, round(sum(cost) / count(*), 7) AS avg_cost FROM runs r JOIN results d ON r.id = d.run_id GROUP BY ALL")
def o057_cost_by_model_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.model_performance(runs(spark, sf_dir), results(spark, sf_dir))
    return rounded(out.select("model_used", "day", F.col("total_documents").alias("documents"), F.col("total_cost").alias("cost"), F.col("cost_per_document").alias("avg_cost")), 7)


@query(HISTORY + """SELECT run_id, count(*) AS documents, count(*) FILTER (WHERE success) AS successes, round(sum(cost), 7) AS cost, sum(entities_found)::BIGINT AS entities, round(sum(processing_time), 7) AS seconds,
  round(coalesce(avg(confidence) FILTER (WHERE success AND confidence <> 0), 0), 7) AS avg_confidence, coalesce(array_to_string(list(document_id ORDER BY document_id) FILTER (WHERE NOT success), ','), '') AS failed,
  round(sum(cost) / count(*), 7) AS cost_per_document, round(sum(entities_found)::DOUBLE / count(*), 7) AS entities_per_document FROM results GROUP BY run_id""")
def o058_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.run_rollup(results(spark, sf_dir)).withColumn("failed", F.array_join("failed", ",")), 7)


@query(WITH + "SELECT event_id, session_id, provider, round(estimated_cost, 4) AS estimated_cost FROM ledger ORDER BY timestamp DESC, event_id DESC LIMIT 10")
def o059_last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.realtime(ledger(spark, sf_dir))[1].select("event_id", "session_id", "provider", "estimated_cost"))


@query(WITH + f"SELECT model, {M} FROM ledger GROUP BY ALL")
def o060_usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.by_provider(ledger(spark, sf_dir), ["model"]))


@query(HISTORY + "SELECT d.document_id, r.model_used, round(d.cost, 4) AS cost FROM results d JOIN runs r ON r.id = d.run_id")
def o035_runs_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.joined(runs(spark, sf_dir), results(spark, sf_dir)).select("document_id", "model_used", "cost"))


@query("""WITH s AS (SELECT o_orderkey AS run_id, o_custkey AS batch_id, o_totalprice AS cost, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM orders)
SELECT run_id, batch_id, round(cost, 2) AS cost, round(before, 2) AS spent_before FROM s WHERE before <= 500000""")
def o104_budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch_documents(spark, sf_dir).withColumnRenamed("document_id", "run_id")
    out = L.within_budget(rows, ["batch_id"], ["created_at", "run_id"], "cost", F.lit(500000.0))
    return rounded(out.select("run_id", "batch_id", "cost", "spent_before"), 2)


@query(WITH + """, o AS (SELECT model, estimated_cost AS x, row_number() OVER (PARTITION BY model ORDER BY timestamp, event_id) AS k, count(*) OVER (PARTITION BY model) AS n FROM ledger WHERE success)
SELECT model, round(sum(0.1::DOUBLE * pow(0.9::DOUBLE, n - k) * x), 4) AS ema, count(*) AS n FROM o GROUP BY model""")
def o103_ema_of_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.ema(ledger(spark, sf_dir).filter("success"), ["model"], ["timestamp", "event_id"], "estimated_cost"))


_PRICES = [("view", "m0", 0.01, 0.03), ("click", "m1", 0.002, 0.004), ("purchase", "m2", 0.005, 0.015)]


@query(WITH + f""", p AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {c}::DOUBLE, {d}::DOUBLE)" for a, b, c, d in _PRICES)}) v(provider, model, pin, pout))
SELECT event_id, round((input_tokens::DOUBLE / 1000 * coalesce(pin, 0.001::DOUBLE) + output_tokens::DOUBLE / 1000 * coalesce(pout, 0.003::DOUBLE)) * 1.1::DOUBLE, 6) AS estimated_cost FROM ledger LEFT JOIN p USING (provider, model)""")
def o170_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame(_PRICES, "provider string, model string, input_price double, output_price double")
    return rounded(L.estimate_cost(ledger(spark, sf_dir).drop("estimated_cost"), prices).select("event_id", "estimated_cost"), 6)


_LIMITS = [("view", 1000.0), ("click", 50000.0), ("purchase", 9000.0), ("signup", 1e9)]


@query(WITH + f""", l AS (SELECT * FROM (VALUES {", ".join(f"('{a}', {b}::DOUBLE)" for a, b in _LIMITS)}) v(provider, lim)), s AS (SELECT provider, sum(estimated_cost) AS c FROM ledger GROUP BY provider)
SELECT provider, round(c, 4) AS cost, round(lim, 4) AS "limit", round(greatest(lim - c, 0), 4) AS remaining, round(CASE WHEN lim > 0 THEN c / lim ELSE 0 END, 4) AS used_share, coalesce(c < lim, true) AS can_afford,
  CASE WHEN lim IS NULL THEN 'unlimited' WHEN c >= 1.2::DOUBLE * lim THEN 'emergency' WHEN c > lim THEN 'exceeded' WHEN c / lim >= 0.8::DOUBLE THEN 'warning' ELSE 'healthy' END AS state FROM s LEFT JOIN l USING (provider)""")
def o173_budget_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame(_LIMITS, "provider string, limit double")
    spent = ledger(spark, sf_dir).groupBy("provider").agg(F.sum("estimated_cost").alias("cost"))
    return rounded(L.budget_state(spent, limits)).withColumn("remaining", F.when(F.col("limit").isNotNull(), F.col("remaining")).otherwise(F.lit(0.0)))
