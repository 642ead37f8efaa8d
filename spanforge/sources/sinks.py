"""Writers: results, exports and upserts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or else the warehouse; a temporary one if both are one process."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        alone = context.master == "local" or context.master.startswith("local[")
        base = tempfile.mkdtemp(prefix="spark-export-") if alone else spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to a shared folder and cut off from its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def save_results(spans: DataFrame, path: str, key: str = "doc_id") -> None:
    """A JSON object for each document with its spans."""
    own = [c for c in spans.columns if c != key]
    spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_pos", *(c for c in own if c != "start_pos")))).alias("pii_entities")).write.json(path)


def export_usage(ledger: DataFrame, path: str, kind: str = "csv", first: datetime | None = None, last: datetime | None = None, session: str | None = None) -> None:
    """The ledger between two times and of a session, in order of time."""
    for test in ((F.col("timestamp") >= F.lit(first)) if first else None, (F.col("timestamp") <= F.lit(last)) if last else None, (F.col("session_id") == session) if session else None):
        ledger = ledger if test is None else ledger.filter(test)
    writer = ledger.orderBy("timestamp").write
    writer.option("header", "true").csv(path) if kind == "csv" else writer.json(path)


def exploded_rows(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each span, and one for each document without any."""
    return docs.join(spans.withColumnRenamed("text", "span_text"), key, "left")


def export_dataset(docs: DataFrame, spans: DataFrame, path: str, kind: str = "csv", key: str = "doc_id") -> None:
    rows = exploded_rows(docs, spans, key)
    rows.write.option("header", "true").csv(path) if kind == "csv" else rows.write.json(path)


def export_with_totals(docs: DataFrame, spans: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Writes the rows of exploded_rows as JSON; returns one row with what was written: documents, those with spans, and spans."""
    export_dataset(docs, spans, path, "json", key)
    rows = docs.sparkSession.read.schema("doc long, pii_type string".replace("doc", key)).json(path)
    return rows.agg(F.countDistinct(key).alias("documents"), F.countDistinct(F.when(F.col("pii_type").isNotNull(), F.col(key))).alias("with_spans"), F.count("pii_type").alias("spans"))


def export_by(rows: DataFrame, path: str, by: str) -> None:
    """JSON lines in a folder for each value of a column, as metrics by name or errors by category; readers of one value read its folder only."""
    rows.write.partitionBy(by).json(path)


def upserted(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key; of several new rows, the last by all columns."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    w = Window.partitionBy(*by).orderBy(F.desc("_v"), *(F.desc(c) for c in old.columns if c not in by))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_v")


def write_report(rows: DataFrame, path: str) -> None:
    """A report of few rows as one JSON file."""
    rows.coalesce(1).write.json(path)
