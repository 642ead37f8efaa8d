"""Batch twins of the streaming operators over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import monitor as M
from .ledger import rounded
from .tables import LEDGER_SQL, ledger, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("metric"), "value")


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS start, time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP + INTERVAL 15 MINUTE AS \"end\", event_type AS metric, count(*) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most FROM events GROUP BY ALL")
def o198_window_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(M.window_statistics(points(spark, sf_dir)))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""WITH b AS (SELECT event_type AS metric, ts, value, value > 20 AS bad, sum((NOT value > 20)::INT) OVER (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM events),
r AS (SELECT *, min(ts) OVER (PARTITION BY metric, run) AS began, row_number() OVER (PARTITION BY metric, run ORDER BY ts, value) AS n FROM b WHERE bad)
SELECT metric, ts::TIMESTAMP AS timestamp, round(value, 4) AS value, began::TIMESTAMP AS began FROM r WHERE n > 1 AND floor(epoch(ts)) - floor(epoch(began)) >= 300""")
def o199_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(M.alerts_batch(points(spark, sf_dir), 20.0, True, 300))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("timestamp", "began")})


@query(f"WITH {LEDGER_SQL} SELECT event_id, provider, round(sum((NOT success)::INT) OVER w / count(*) OVER w::DOUBLE, 6) AS error_rate FROM ledger WINDOW w AS (PARTITION BY model ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def o200_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.error_rate(ledger(spark, sf_dir), "model").select("event_id", "provider", "error_rate"), 6)


@query("SELECT event_type AS metric, count(*) AS n FROM (SELECT event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) <= 100) GROUP BY ALL")
def o106_retained_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.retained(points(spark, sf_dir), 100).groupBy("metric").agg(F.count("*").alias("n"))


@query("""WITH kept AS (SELECT event_type AS metric, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) <= 500)
SELECT metric, count(*) AS n, min(ts)::TIMESTAMP AS oldest, max(ts)::TIMESTAMP AS newest, round(avg(value), 4) AS mean, round(arg_max(value, row(ts, value)), 4) AS latest FROM kept GROUP BY metric""")
def o198_last_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch twin of the stream that holds the last points of each metric in its state."""
    out = rounded(M.retained_summary(points(spark, sf_dir), 500))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("oldest", "newest")})


@query(f"""WITH {LEDGER_SQL}, g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY session_id ORDER BY timestamp, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM ledger),
s AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT session_id, min(timestamp)::TIMESTAMP AS start, max(timestamp)::TIMESTAMP + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(estimated_cost), 4) AS cost FROM s GROUP BY session_id, k""")
def o202_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(M.sessions(ledger(spark, sf_dir)))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
