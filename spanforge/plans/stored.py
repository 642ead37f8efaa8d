"""Queries that write tables as files and read them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as E
from ..sources import files, sinks
from ..sources.keyed import KeyedTable, delete_cascade
from .spans import RULE_SPANS_SQL, rounded
from .tables import LEDGER_SQL, documents, ledger, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Documents of an exported text file, which is read as one row.
FILE_DOCUMENTS = 200


def query(sql: str):
    """Registers a query with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("SELECT source, sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')))::BIGINT AS words FROM documents GROUP BY source")
def o001_discovered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files in a folder for each source; the files found there and their words."""
    folder = sinks.shared_folder(spark, "texts")
    table(spark, sf_dir, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").option("maxRecordsPerFile", FILE_DOCUMENTS).text(folder)
    found = files.read_text(files.discover(spark, folder, ["txt"]))
    return found.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(F.sum("word_count").alias("words"))


@query(f"WITH {RULE_SPANS_SQL} SELECT doc_id, text AS entity, pii_type AS label, start_pos AS start FROM spans")
def o012_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their spans as training lines, read back as one row for each entity."""
    folder = sinks.shared_folder(spark, "training")
    rows = E.with_rule_spans(documents(spark, sf_dir).select("doc_id", "text"))
    entity = lambda s: F.struct(s["text"].alias("text"), s["pii_type"].alias("label"), s["start_pos"].alias("start"), s["end_pos"].alias("end"))
    rows.select(F.col("doc_id").cast("string").alias("id"), "text", F.transform("spans", entity).alias("entities")).write.json(folder)
    lines = files.read_training(spark, folder)
    return lines.select(F.col("id").cast("long").alias("doc_id"), F.explode("entities").alias("e")).select("doc_id", F.col("e.text").alias("entity"), "e.label", "e.start")


@query("SELECT page_id FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 1")
def o014_changed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that an earlier snapshot has not, or has with another hash."""
    p = table(spark, sf_dir, "pages")
    now = p.select(F.col("page_id").cast("string").alias("path"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))
    old = F.when(F.col("path").cast("long") % 5 == 1, F.sha2("sha256", 256)).otherwise(F.col("sha256"))
    before = now.filter(F.col("path").cast("long") % 3 != 0).withColumn("sha256", old)
    return files.changed(now, before).select(F.col("path").cast("long").alias("page_id"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'ValueError: no text' END AS error, CASE WHEN page_id % 4 <> 0 THEN length(coalesce(html, ''))::INT END AS characters FROM pages WHERE page_id % 4 <> 1")
def o015_handled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of four kinds: one without a handler, one whose handler fails."""

    def broken(content: bytes) -> str:
        raise ValueError("no text")

    kinds = F.element_at(F.array(*map(F.lit, ("pdf", "exe", "html", "txt"))), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    found = table(spark, sf_dir, "pages").select(F.concat_ws(".", F.col("page_id").cast("string"), kinds).alias("path"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("content"))
    read = files.read_with(found, {"pdf": broken, "html": bytes.decode, "txt": bytes.decode})
    return read.select(F.substring_index("path", ".", 1).cast("long").alias("page_id"), "error", F.length("text").alias("characters"))


@query(f"WITH {RULE_SPANS_SQL} SELECT doc_id, text, pii_type, start_pos, confidence FROM spans")
def o016_saved_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of each document as a JSON object, read back."""
    folder = sinks.shared_folder(spark, "results")
    sinks.save_results(E.rule_spans(documents(spark, sf_dir)), folder)
    saved = spark.read.schema("doc_id long, pii_entities array<struct<text: string, pii_type: string, start_pos: int, confidence: double>>").json(folder)
    return rounded(saved.select("doc_id", F.inline("pii_entities")))


@query(f"WITH {LEDGER_SQL} SELECT event_id, provider, total_tokens, estimated_cost, success FROM ledger WHERE session_id = '1' AND timestamp >= TIMESTAMP '1990-01-01'")
def o017_usage_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a session as CSV, in order of time, read back."""
    from datetime import datetime

    folder, kept = sinks.shared_folder(spark, "usage"), ledger(spark, sf_dir)
    sinks.export_usage(kept, folder, "csv", first=datetime(1990, 1, 1), session="1")
    return spark.read.option("header", "true").schema(kept.schema).csv(folder).select("event_id", "provider", "total_tokens", "estimated_cost", "success")


@query(f"WITH {RULE_SPANS_SQL} SELECT d.doc_id, s.pii_type, s.start_pos FROM documents d LEFT JOIN spans s USING (doc_id)")
def o018_dataset_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each span, and one for each document without any, as CSV, read back."""
    folder, found = sinks.shared_folder(spark, "dataset"), documents(spark, sf_dir)
    sinks.export_dataset(found.select("doc_id"), E.rule_spans(found).select("doc_id", "pii_type", "start_pos"), folder)
    return spark.read.option("header", "true").schema("doc_id long, pii_type string, start_pos int").csv(folder)


@query(f"WITH {RULE_SPANS_SQL} SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT doc_id) AS with_spans, count(*) AS spans FROM spans")
def o020_export_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir)
    return sinks.export_with_totals(found.select("doc_id"), E.rule_spans(found).select("doc_id", "pii_type", "start_pos"), sinks.shared_folder(spark, "export"))


@query(f"WITH {LEDGER_SQL} SELECT provider, count(*) AS points, sum(total_tokens)::BIGINT AS tokens FROM ledger GROUP BY provider")
def o021_metric_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics in a folder for each name, read back."""
    folder = sinks.shared_folder(spark, "metrics")
    sinks.export_by(ledger(spark, sf_dir).select("provider", "total_tokens"), folder, "provider")
    return spark.read.schema("total_tokens long, provider string").json(folder).groupBy("provider").agg(F.count("*").alias("points"), F.sum("total_tokens").alias("tokens"))


@query(f"""WITH {LEDGER_SQL}, d AS (SELECT model, timestamp::DATE AS day, max(total_tokens) AS most, count(*) AS n FROM ledger GROUP BY ALL)
SELECT model, day, CASE WHEN dayofmonth(day) % 2 = 0 THEN most + 1 ELSE most END AS most, n FROM d""")
def o023_upserted_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of models by day after even days have been written anew."""
    days = ledger(spark, sf_dir).groupBy("model", F.to_date("timestamp").alias("day")).agg(F.max("total_tokens").alias("most"), F.count("*").alias("n"))
    anew = days.filter(F.dayofmonth("day") % 2 == 0).withColumn("most", F.col("most") + 1)
    return sinks.upserted(days, anew, ["model", "day"])


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def o023_rollup_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by month and customer up to the middle of a month; what came since replaces that month and adds the next ones, in their buckets only."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.trunc("o_orderdate", "month"))
    totals = lambda rows: rows.groupBy("month", "o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    stored = KeyedTable(sinks.shared_folder(spark, "rollup"), ("month", "o_custkey"), ("month",), 32)
    stored.create(totals(orders.filter("o_orderdate < '2001-06-15'")))
    stored.upsert(totals(orders.filter("month >= '2001-06-01'")))
    return stored.rows(spark).withColumn("total", F.round("total", 2))


@query("SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderstatus = 'O' THEN 'processing' ELSE o_orderstatus END AS status, round(o_totalprice, 2) AS price FROM orders")
def o209_status_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial update: open orders of the last months get a status, their price is not given and stays."""
    orders = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("month"), "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    stored = KeyedTable(sinks.shared_folder(spark, "statuses"), ("month", "o_orderkey"), ("month",), 32)
    stored.create(orders)
    stored.upsert(orders.filter("month >= '2001-01-01' AND status = 'O'").select("month", "o_orderkey", F.lit("processing").alias("status")), partial=True)
    return stored.rows(spark).select("o_orderkey", "status", F.round("price", 2).alias("price"))


@query("""WITH results AS (SELECT l_orderkey, l_linenumber, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL)
SELECT l_linenumber, count(*) AS results, sum(n)::BIGINT AS n, round(sum(quantity), 2) AS quantity FROM results
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus IN ('F', 'P')) GROUP BY l_linenumber""")
def o211_cascaded_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that are left when ended batches of before 1996 went, and their results with them."""
    batches = KeyedTable(sinks.shared_folder(spark, "batches"), ("o_orderkey",), buckets=32)
    results = KeyedTable(sinks.shared_folder(spark, "results"), ("l_orderkey", "l_linenumber"), ("l_orderkey",), 32)
    batches.create(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"))
    results.create(table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")))
    old = (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")) & F.col("o_orderstatus").isin("F", "P")
    delete_cascade(spark, batches, old, {results: {"l_orderkey": "o_orderkey"}})
    left = results.rows(spark).groupBy("l_linenumber").agg(F.count("*").alias("results"), F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))
    return left.withColumn("quantity", F.round("quantity", 2))
