"""Tables that change in place, against the same change in Python."""

import os

import pytest
from pyspark.sql import functions as F

from spanforge.sources.keyed import KeyedTable, delete_cascade


def _files(path):
    return {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _buckets(files):
    return {int(os.path.basename(d).split("=")[1]) for d, _ in files}


@pytest.fixture
def days(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "days"), ("day", "model"), ("day",), 16)
    rows = [(d, m, 10.0 * d + k, f"t{d}") for d in range(40) for k, m in enumerate(("a", "b"))] + [(None, "a", 1.0, None)]
    table.create(spark.createDataFrame(rows, "day long, model string, cost double, note string"))
    return table, {r[:2]: r[2:] for r in rows}


def _held(spark, table):
    rows = [tuple(r) for r in table.rows(spark).collect()]
    out = {r[:2]: r[2:] for r in rows}
    assert len(out) == len(rows) and table.missing(spark) == []
    return out


def test_upsert_writes_only_what_it_touches(spark, days):
    table, held = days
    assert _held(spark, table) == held
    before = _files(table.path)
    # an int key meets the stored longs; of rows that share a key the last stays; a null key is a value
    new = [(3, "a", 7.0, "x"), (3, "a", 8.0, None), (3, "c", 1.0, "y"), (None, "a", None, "z")]
    touched = table.upsert(spark.createDataFrame(new, "day int, model string, cost double, note string"))
    assert _held(spark, table) == held | {(3, "a"): (8.0, None), (3, "c"): (1.0, "y"), (None, "a"): (None, "z")}
    after = _files(table.path)
    assert 1 <= len(touched) <= 2 and _buckets(dict(after.items() - before.items())) == set(touched)
    same = {k for k in before if int(os.path.basename(k[0]).split("=")[1]) not in touched}
    assert same and all(after[k] == before[k] for k in same)
    table.upsert(spark.createDataFrame(new, "day int, model string, cost double, note string"))  # again: nothing changes
    assert _held(spark, table)[(3, "a")] == (8.0, None)


def test_partial_update_keeps_what_is_null(spark, days):
    table, held = days
    table.upsert(spark.createDataFrame([(5, "a", 99.0), (6, "b", None), (77, "a", 1.0)], "day long, model string, cost double"), partial=True)
    assert _held(spark, table) == held | {(5, "a"): (99.0, "t5"), (77, "a"): (1.0, None)}


def test_empty_changes_write_nothing(spark, days):
    table, held = days
    before = _files(table.path)
    assert table.upsert(table.rows(spark).limit(0)) == [] == table.delete(table.rows(spark).select("day").limit(0))
    assert _files(table.path) == before and _held(spark, table) == held


def test_bucket_without_rows_is_written(spark, days):
    table, held = days
    touched = table.delete(table.rows(spark).select("day").distinct())
    assert _held(spark, table) == {} and touched
    table.upsert(spark.createDataFrame([(1, "a", 2.0, "n")], "day long, model string, cost double, note string"))
    assert _held(spark, table) == {(1, "a"): (2.0, "n")}


def test_empty_table(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("k",), buckets=4)
    table.create(spark.createDataFrame([], "k long, v string"))
    assert table.rows(spark).count() == 0 and table.missing(spark) == []
    table.upsert(spark.createDataFrame([(1, "a")], "k long, v string"))
    assert [tuple(r) for r in table.rows(spark).collect()] == [(1, "a")]


def test_lost_bucket_is_noticed(spark, days):
    table, _ = days
    touched = table.upsert(spark.createDataFrame([(3, "a", 7.0, "x")], "day long, model string, cost double, note string"))
    folder = os.path.join(table.path, f"_bucket={touched[0]}")
    for f in os.listdir(folder):
        os.remove(os.path.join(folder, f))
    assert table.missing(spark) == touched
    with pytest.raises(RuntimeError):
        table.delete(spark.createDataFrame([(3,)], "day long"))


def test_wrong_columns(spark, days):
    table, _ = days
    for columns in ("day long, cost double", "day long, model string, cost double", "day long, model string, cost double, note string, more int"):
        with pytest.raises(ValueError):
            table.upsert(spark.createDataFrame([], columns))
    with pytest.raises(ValueError):
        KeyedTable("x", ("a",), ("b",))
    with pytest.raises(ValueError):
        KeyedTable(table.path + "2", ("k",)).create(spark.createDataFrame([], "k long, _Live boolean"))


def test_cascade(spark, tmp_path):
    runs, results = KeyedTable(str(tmp_path / "runs"), ("id",), buckets=8), KeyedTable(str(tmp_path / "results"), ("run_id", "doc"), ("run_id",), 8)
    runs.create(spark.range(20).withColumn("age", F.col("id") * 10))
    results.create(spark.range(20).withColumnRenamed("id", "run_id").crossJoin(spark.range(3).withColumnRenamed("id", "doc")).withColumn("v", F.lit(1)))
    before = _files(results.path)
    gone = delete_cascade(spark, runs, F.col("age") >= 180, {results: {"run_id": "id"}})
    assert sorted(r[0] for r in gone.collect()) == [18, 19]
    assert sorted(r[0] for r in runs.rows(spark).collect()) == list(range(18))
    assert sorted((r[0], r[1]) for r in results.rows(spark).collect()) == [(i, j) for i in range(18) for j in range(3)]
    assert len(_buckets(dict(_files(results.path).items() - before.items()))) <= 2
