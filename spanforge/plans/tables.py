"""The test tables in the roles of the domain's tables, for Spark and for the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Dealt out to all cores where the scan has fewer tasks than that, as over one small file; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the usage ledger."""
    e = table(spark, sf_dir, "events")
    tokens = F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0))
    failed = F.col("event_type") == "error"
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_type").alias("provider"),
        F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("model"),
        tokens.alias("input_tokens"),
        (tokens * 2).alias("output_tokens"),
        (tokens * 3).alias("total_tokens"),
        F.col("value").alias("estimated_cost"),
        F.when(F.col("event_id") % 3 == 0, F.col("value") * 0.9).alias("actual_cost"),
        (F.col("event_id") % 50 / 10.0).alias("processing_time"),
        (~failed).alias("success"),
        F.when(failed, F.concat(F.lit("code "), (F.col("event_id") % 5).cast("string"))).alias("error_message"),
    )


LEDGER_SQL = """ledger AS (SELECT event_id, ts AS timestamp, user_id::VARCHAR AS session_id, event_type AS provider, 'm' || (user_id % 7)::VARCHAR AS model,
  coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS input_tokens, 2 * coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS output_tokens, 3 * coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS total_tokens,
  value AS estimated_cost, CASE WHEN event_id % 3 = 0 THEN value * 0.9::DOUBLE END AS actual_cost, (event_id % 50)::DOUBLE / 10::DOUBLE AS processing_time,
  event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN 'code ' || (event_id % 5)::VARCHAR END AS error_message FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as runs."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("model_used"), F.col("o_totalprice").alias("budget"), F.col("o_orderstatus").alias("status"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as the results of a run's documents."""
    i = table(spark, sf_dir, "lineitem")
    return i.select(
        F.col("l_orderkey").alias("run_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("document_id"),
        F.col("l_partkey").alias("part"),
        F.concat(F.lit("doc"), (F.col("l_partkey") % 40).cast("string")).alias("document_name"),
        F.col("l_extendedprice").alias("cost"),
        F.col("l_quantity").alias("processing_time"),
        (1 - F.col("l_discount")).alias("confidence"),
        (F.col("l_returnflag") != "R").alias("success"),
        (F.col("l_suppkey") % 9).alias("entities_found"),
        F.col("l_shipdate").alias("timestamp"),
        F.element_at(F.create_map(*(F.lit(x) for x in ("A", "Easy", "N", "Medium", "R", "Hard"))), F.col("l_returnflag")).alias("difficulty"),
        F.concat(F.lit("d"), (F.col("l_suppkey") % 5).cast("string")).alias("domain"),
    )


RUNS_SQL = "runs AS (SELECT o_orderkey AS id, o_orderdate AS timestamp, o_orderpriority AS model_used, o_totalprice AS budget, o_orderstatus AS status FROM orders)"
RESULTS_SQL = """results AS (SELECT l_orderkey AS run_id, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS document_id, l_partkey AS part, 'doc' || (l_partkey % 40)::VARCHAR AS document_name, l_extendedprice AS cost, l_quantity AS processing_time,
  1 - l_discount AS confidence, l_returnflag <> 'R' AS success, l_suppkey % 9 AS entities_found, l_shipdate AS timestamp,
  CASE l_returnflag WHEN 'A' THEN 'Easy' WHEN 'N' THEN 'Medium' WHEN 'R' THEN 'Hard' END AS difficulty, 'd' || (l_suppkey % 5)::VARCHAR AS domain FROM lineitem)"""


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined runs and results as rows of model performance."""
    d = results(spark, sf_dir)
    r = runs(spark, sf_dir).select(F.col("id").alias("run_id"), F.col("model_used").alias("model"))
    return d.join(r, "run_id").select("document_id", "document_name", "model", "difficulty", "domain", "timestamp", F.col("confidence").alias("accuracy_score"), (F.col("cost") / 1e6).alias("cost"), F.col("processing_time").alias("latency"), "success", "entities_found")


PERFORMANCE_SQL = f"""{RUNS_SQL}, {RESULTS_SQL}, performance AS (SELECT d.document_id, document_name, r.model_used AS model, difficulty, domain, d.timestamp, confidence AS accuracy_score, d.cost / 1e6::DOUBLE AS cost, processing_time AS latency, success, entities_found
  FROM results d JOIN runs r ON r.id = d.run_id)"""
