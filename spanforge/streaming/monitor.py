"""Structured Streaming over metric points, each with a batch twin that gives the same rows on the same data."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.scan import scanned, sums
from ..sources.files import CONTENT_TYPES

#: Fixed values: (alert, metric, threshold, above, seconds).
ALERTS = (
    ("high_cpu", "cpu_percent", 85.0, True, 300), ("high_memory", "memory_percent", 90.0, True, 180), ("low_disk", "disk_free_percent", 10.0, False, 60), ("slow_processing", "processing_time", 5000.0, True, 120),
    ("high_error_rate", "error_rate", 0.1, True, 60), ("low_throughput", "throughput", 1.0, False, 300), ("queue_backlog", "queue_size", 100.0, True, 120),
)


def window_statistics(points: DataFrame, width: str = "15 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, least and most of each metric in event-time windows; works on streams and tables."""
    marked = points.withWatermark("timestamp", late) if points.isStreaming else points
    w = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    out = marked.groupBy(w.alias("w"), "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "metric", "n", "mean", "least", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of a user with no longer pause than gap."""
    marked = events.withWatermark("timestamp", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("timestamp", gap).alias("w"), "session_id").agg(F.count("*").alias("n"), F.sum("estimated_cost").alias("cost")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "session_id", "n", "cost")


def breaching(value: Column, threshold: float, above: bool) -> Column:
    return value > threshold if above else value < threshold


def alerts_batch(points: DataFrame, threshold: float, above: bool, seconds: int) -> DataFrame:
    """Points at which an alert fires: a later point of a run of breaches, at least seconds after its first; any good point ends the run."""
    order = Window.partitionBy("metric").orderBy("timestamp", "value")
    bad = points.withColumn("bad", breaching(F.col("value"), threshold, above))
    runs = bad.withColumn("run", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("bad")
    began = F.min("timestamp").over(Window.partitionBy("metric", "run"))
    first = F.row_number().over(Window.partitionBy("metric", "run").orderBy("timestamp", "value")) == 1
    return runs.withColumns({"began": began, "first": first}).filter(~F.col("first") & (F.unix_timestamp("timestamp") - F.unix_timestamp("began") >= seconds)).select("metric", "timestamp", "value", "began")


def alerts_stream(points: DataFrame, threshold: float, above: bool, seconds: int, keep: str = "1 hour") -> DataFrame:
    """alerts_batch() over a stream; the state of a metric, the start of its run, goes after an hour of event time without points."""
    schema = "metric string, timestamp timestamp, value double, began timestamp"

    def step(key: tuple[Any, ...], tables: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        began = state.get[0] if state.exists else -1
        out, last = [], 0
        for row in pd.concat(list(tables)).sort_values(["timestamp", "value"]).itertuples():
            at = int(row.timestamp.timestamp() * 1000)
            last = max(last, at)
            if not (row.value > threshold if above else row.value < threshold):
                began = -1
            elif began < 0:
                began = at
            elif at // 1000 - began // 1000 >= seconds:
                out.append((key[0], row.timestamp, row.value, pd.Timestamp(began, unit="ms")))
        state.update((began,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 3_600_000)
        yield pd.DataFrame(out, columns=["metric", "timestamp", "value", "began"])

    marked = points.withWatermark("timestamp", keep)
    return marked.groupBy("metric").applyInPandasWithState(step, schema, "began long", "append", GroupStateTimeout.EventTimeTimeout)


def error_rate(events: DataFrame, by: str = "provider") -> DataFrame:
    """Errors for each operation so far, after each event."""
    rule, _ = sums("errors", "n")
    zero = F.lit(0).cast("long")
    lift = {"errors": F.when(F.col("success"), 0).otherwise(1).cast("long"), "n": F.lit(1).cast("long")}
    out = scanned(events, [by], ["timestamp", "event_id"], lift, rule, {"errors": zero, "n": zero})
    return out.withColumn("error_rate", F.col("_upto.errors") / F.greatest(F.col("_upto.n"), F.lit(1))).drop("_before", "_upto")


def retained(points: DataFrame, most: int = 10000) -> DataFrame:
    """The last `most` points of each metric."""
    w = Window.partitionBy("metric").orderBy(F.desc("timestamp"), F.desc("value"))
    return points.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def retained_summary(points: DataFrame, most: int = 10000) -> DataFrame:
    """What the last `most` points of each metric say: their number, first and last time, mean, and the latest value."""
    kept = retained(points, most).groupBy("metric")
    latest = F.max(F.struct("timestamp", "value"))["value"]
    return kept.agg(F.count("*").alias("n"), F.min("timestamp").alias("oldest"), F.max("timestamp").alias("newest"), F.avg("value").alias("mean"), latest.alias("latest"))


def retained_stream(points: DataFrame, most: int = 10000, late: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """retained_summary() over a stream: a row for each metric that got points in a micro-batch, over the points it holds then.

    The points are list state of the metric, `most` at most, in order of time and value. Rows later than `late` behind the
    newest ones are dropped, rows with a null in any column are ignored; a metric that gets nothing for `idle` of event time
    loses its state by a timer. The state store of the session must be RocksDB (rocksdb_state()). Runs in update mode.
    """
    hold = int(pd.Timedelta(idle).total_seconds() * 1000)
    marked = points.select("metric", "timestamp", "value").dropna().withWatermark("timestamp", late)
    schema = "metric string, n long, oldest timestamp, newest timestamp, mean double, latest double"
    return marked.groupBy("metric").transformWithStateInPandas(_LastPoints(most, hold), schema, "Update", "EventTime")


class _LastPoints(StatefulProcessor):
    """Holds the last points of a metric."""

    def __init__(self, most: int, hold: int) -> None:
        self.most, self.hold = most, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", "at long, value double")

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.points.get()), columns=["at", "value"])
        for table in rows:  # cut after each, so that a large batch of one metric is never whole in memory
            new = pd.DataFrame({"at": table["timestamp"].astype("datetime64[us]").astype("int64"), "value": table["value"]})
            held = (pd.concat([held, new]) if len(held) else new).sort_values(["at", "value"]).tail(self.most)
        self.points.put([(int(a), float(v)) for a, v in zip(held["at"], held["value"], strict=True)])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        newest = int(held["at"].iloc[-1])
        self.handle.registerTimer(newest // 1000 + self.hold)
        times = [pd.Timestamp(int(t), unit="us") for t in (held["at"].iloc[0], newest)]
        yield pd.DataFrame({"metric": [key[0]], "n": [len(held)], "oldest": times[:1], "newest": times[1:], "mean": [held["value"].mean()], "latest": [held["value"].iloc[-1]]})

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.points.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def rocksdb_state(spark: SparkSession) -> None:
    """State of streams that start from now on is kept in RocksDB, which list state and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Progress(StreamingQueryListener):
    """How far a stream is that works off a known number of rows (files, for new_files()): add it by spark.streams.addListener().

    name: of the query, as set by queryName(). total: rows that are there when it starts, for the estimate of what is left;
    those that were done before a restart must not be in it. Reports come after each micro-batch and are kept as sums only.
    """

    def __init__(self, name: str, total: int | None = None) -> None:
        self.name, self.total = name, total
        self.rows = self.batches = 0
        self.seconds = 0.0
        self.state, self.error, self._run = "waiting", None, None

    def onQueryStarted(self, event: Any) -> None:
        if event.name == self.name:
            self._run, self.state, self.error = str(event.runId), "running", None

    def onQueryProgress(self, event: Any) -> None:
        progress = event.progress
        if progress.name == self.name and progress.numInputRows:
            self.rows += progress.numInputRows
            self.batches += 1
            self.seconds += progress.durationMs.get("triggerExecution", 0) / 1000

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        if str(event.runId) == self._run:
            self.error = event.exception
            self.state = "failed" if event.exception else "ended"

    def report(self) -> dict[str, Any]:
        """Rows and batches done, rows a second, share done and seconds left; None where the total or the speed is unknown."""
        speed = self.rows / self.seconds if self.seconds else None
        left = None if self.total is None else max(self.total - self.rows, 0)
        return {
            "state": self.state, "error": self.error, "rows": self.rows, "batches": self.batches, "rows_per_second": speed,
            "done": None if not self.total else min(self.rows / self.total, 1.0), "seconds_left": None if left is None or not speed else left / speed,
        }


def new_files(spark: SparkSession, folder: str, endings: Sequence[str] = tuple(CONTENT_TYPES), files: int = 50, most_bytes: int | None = None) -> DataFrame:
    """A stream of the files below a folder, so many at a time: path, modificationTime, length and content.

    Which files are done is in the checkpoint of the query that reads it, so no markers are written or listed. Endings are
    matched in any case. Other files are not listed, and of files larger than most_bytes the content is not read.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    any_case = ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in endings)
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files)
    stream = reader.option("pathGlobFilter", f"*.{{{any_case}}}").load(folder)
    return stream if most_bytes is None else stream.filter(F.col("length") <= most_bytes)


def process_new(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Hands each micro-batch of a stream to work until all that is there is done.

    A batch that was cut off comes again with the same number and the same rows: work must write by that number, as to a
    folder of its name, so that a repeat replaces the first try.
    """
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def process_folder(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str, files: int = 50, name: str | None = None) -> StreamingQuery:
    """Hands new JSON files of a folder to work, so many at a time; what is done is in the checkpoint."""
    return process_new(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder), work, checkpoint, name)
