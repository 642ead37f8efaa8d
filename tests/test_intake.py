"""Streams against their batch twins over restarts, and the intake of files with its progress."""

import json
import os
import time
from datetime import datetime, timedelta, timezone

import pytest

from spanforge.streaming import monitor as M

SCHEMA = "metric string, timestamp timestamp, value double"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get(PROVIDER)
    M.rocksdb_state(spark)
    yield
    spark.conf.set(PROVIDER, before)


def _write(folder, number, points):
    path = folder / f"{number}.json"
    path.write_text("\n".join(json.dumps({"metric": m, "timestamp": (START + timedelta(seconds=s)).isoformat(), "value": v}) for m, s, v in points))
    os.utime(path, (10**9 + number, 10**9 + number))  # the order in which the stream takes them


def _run(spark, folder, checkpoint, seen, **kw):
    stream = M.retained_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder)), **kw)

    def keep(batch, number):
        seen.extend((number, tuple(r)) for r in batch.collect())

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def test_retained_stream_equals_batch_over_restarts(spark, rocksdb, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    # ties, repeated points, points out of order, a metric that comes once, and nulls
    for k in range(4):
        _write(folder, k, [("cpu", 60 * k + (7 * i) % 50, float(i % 3)) for i in range(9)] + [("disk", 60 * k, 1.0)] * 2 + ([("once", 5, 2.0), (None, 6, 1.0), ("cpu", 7, None)] if k == 0 else []))
        if k in (1, 3):  # two runs of two files each on one checkpoint
            _run(spark, folder, str(tmp_path / "c"), seen, most=10, late="1 hour")
    last = {}
    for _, row in sorted(seen):
        last[row[0]] = row
    points = spark.read.schema(SCHEMA).json(str(folder)).dropna()
    assert last == {r[0]: tuple(r) for r in M.retained_summary(points, 10).collect()}
    assert last["cpu"][1] == 10 and last["disk"][1] == 8 and last["once"][1] == 1


def test_idle_metric_loses_its_state(spark, rocksdb, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    _write(folder, 0, [("a", 0, 1.0), ("b", 0, 1.0)])
    _write(folder, 1, [("b", 7200, 2.0)])
    _write(folder, 2, [("b", 7201, 3.0)])
    _write(folder, 3, [("a", 7202, 4.0), ("b", 7202, 5.0)])
    _run(spark, folder, str(tmp_path / "c"), seen, late="1 minute", idle="1 hour")
    last = {row[0]: row for _, row in sorted(seen)}
    assert last["a"][1] == 1 and last["a"][4] == 4.0


def _until(test, seconds=20):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.1)
    assert test()


def test_files_come_once_and_progress_is_told(spark, tmp_path):
    folder, out = tmp_path / "files", str(tmp_path / "out")
    (folder / "below").mkdir(parents=True)
    names = [f"{i}.txt" for i in range(5)] + ["below/5.TXT", "x.log", "large.txt"]
    for n in names:
        (folder / n).write_text(n * (100 if n == "large.txt" else 1))

    def work(batch, number):
        batch.selectExpr("regexp_extract(path, '[^/]+$', 0) AS name", "cast(content AS string) AS text").write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run(progress):
        spark.streams.addListener(progress)
        try:
            M.process_new(M.new_files(spark, str(folder), ("txt", "md"), 3, 50), work, str(tmp_path / "c"), progress.name).awaitTermination()
            _until(lambda: progress.state == "ended")
        finally:
            spark.streams.removeListener(progress)
        return progress.report()

    first = run(M.Progress("intake", len(names)))
    assert first["rows"] == 6 and first["batches"] >= 2 and first["error"] is None and first["rows_per_second"] > 0 and first["seconds_left"] is not None
    (folder / "later.txt").write_text("later")
    second = run(M.Progress("intake", 1))  # a restart on the checkpoint takes the new file only
    assert second["rows"] == 1 and second["done"] == 1.0 and second["seconds_left"] == 0
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("name", "text").collect())
    assert got == sorted((n.split("/")[-1], n) for n in names[:6]) + [("later.txt", "later")]


def test_failed_work_is_told_and_repeated(spark, tmp_path):
    folder, done = tmp_path / "in", []
    folder.mkdir()
    _write(folder, 0, [("a", 0, 1.0)])
    progress = M.Progress("failing")

    def work(batch, number):
        if not done:
            done.append("failed")
            raise ValueError("no room")
        done.append((number, batch.count()))

    spark.streams.addListener(progress)
    try:
        with pytest.raises(Exception, match="no room"):
            M.process_folder(spark, str(folder), SCHEMA, work, str(tmp_path / "c"), name="failing").awaitTermination()
        _until(lambda: progress.state == "failed")
        assert "no room" in progress.report()["error"] and progress.report()["seconds_left"] is None
        M.process_folder(spark, str(folder), SCHEMA, work, str(tmp_path / "c"), name="failing").awaitTermination()
        _until(lambda: progress.state == "ended")
    finally:
        spark.streams.removeListener(progress)
    assert done == ["failed", (0, 1)] and progress.report()["rows"] >= 1
