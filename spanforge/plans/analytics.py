"""Queries of model analytics over runs and their results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from .ledger import rounded
from .tables import LEDGER_SQL, PERFORMANCE_SQL, ledger, performance

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


W = f"WITH {PERFORMANCE_SQL} "
S = """round(avg(accuracy_score), 4) AS accuracy_mean, round(stddev_samp(accuracy_score), 4) AS accuracy_std, count(*) AS n, round(avg(cost), 6) AS cost_mean, round(avg(latency), 4) AS latency_mean, round(avg(success::INT), 4) AS success_rate"""


def summarised(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6 if c == "cost_mean" else 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(W + f"SELECT model, {S} FROM performance GROUP BY model")
def o079_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(A.summary(performance(spark, sf_dir), ["model"]))


@query(W + f"SELECT difficulty, {S}, CASE difficulty WHEN 'Easy' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Hard' THEN 3 ELSE 4 END AS place FROM performance GROUP BY difficulty")
def o080_by_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarised(A.by_difficulty(performance(spark, sf_dir)))


@query(W + "SELECT CAST(timestamp AS DATE) AS day, round(avg(accuracy_score), 9) AS accuracy_mean, round(sum(cost), 9) AS cost_sum FROM performance GROUP BY ALL")
def o081_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.daily(performance(spark, sf_dir)), 9)


@query(W + "SELECT model, round(avg(accuracy_score) / avg(cost), 4) AS cost_efficiency, round(avg(accuracy_score) / avg(latency), 4) AS speed_efficiency FROM performance GROUP BY model")
def o082_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.efficiency(performance(spark, sf_dir)))


@query(W + "SELECT model, round(avg(latency), 4) AS mean, round(min(latency), 4) AS least, round(max(latency), 4) AS most, round(quantile_cont(latency, 0.95), 4) AS p95 FROM performance GROUP BY model")
def o083_latency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.latency_profile(performance(spark, sf_dir)))


@query(W + "SELECT 'accuracy_score' AS a, 'cost' AS b, round(corr(accuracy_score, cost), 6) AS corr FROM performance UNION ALL SELECT 'accuracy_score', 'latency', round(corr(accuracy_score, latency), 6) FROM performance UNION ALL SELECT 'cost', 'latency', round(corr(cost, latency), 6) FROM performance")
def o084_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.correlations(performance(spark, sf_dir), ["accuracy_score", "cost", "latency"]), 6)


_C = "c AS (SELECT model, coalesce(avg(accuracy_score) FILTER (WHERE difficulty = 'Easy'), 0) AS e, coalesce(avg(accuracy_score) FILTER (WHERE difficulty = 'Medium'), 0) AS m, coalesce(avg(accuracy_score) FILTER (WHERE difficulty = 'Hard'), 0) AS h FROM performance GROUP BY model)"


@query(W + f', {_C} SELECT model, round(e, 4) AS "Easy", round(m, 4) AS "Medium", round(h, 4) AS "Hard", round(list_var_samp([e, m, h]), 8) AS row_variance FROM c')
def o085_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.pivoted(performance(spark, sf_dir), ("Easy", "Medium", "Hard"))
    return out.select("model", *(F.round(c, 4).alias(c) for c in ("Easy", "Medium", "Hard")), F.round("row_variance", 8).alias("row_variance"))


_G = "g AS (SELECT model, difficulty, avg(accuracy_score) AS m, coalesce(stddev_samp(accuracy_score), 0) AS s FROM performance GROUP BY ALL)"


@query(W + f", {_G} SELECT model, round(greatest(1 - stddev_pop(m) / avg(m), 0), 6) AS adaptability, round(greatest(1 - stddev_samp(m) / avg(m), 0), 6) AS adaptability_sample FROM g GROUP BY model")
def o086_adaptability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = performance(spark, sf_dir)
    return rounded(A.adaptability(p).join(A.adaptability(p, sample=True).withColumnRenamed("adaptability", "adaptability_sample"), "model"), 6)


@query(W + "SELECT model, round(1 - least(stddev_samp(accuracy_score), 1), 6) AS consistency, round(avg((accuracy_score > 0.7::DOUBLE)::INT), 6) AS robustness FROM performance GROUP BY model")
def o087_steadiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.steadiness(performance(spark, sf_dir)), 6)


@query(W + """, g2 AS (SELECT difficulty, avg(accuracy_score) AS a, avg(cost) AS c, avg(latency) AS l FROM performance GROUP BY ALL), v AS (SELECT stddev_pop(a) / avg(a) AS x, stddev_pop(c) / avg(c) AS y, stddev_pop(l) / avg(l) AS z FROM g2)
SELECT round(x, 6) AS cv_accuracy_score, round(y, 6) AS cv_cost, round(z, 6) AS cv_latency, round((x + y + z) / 3, 6) AS cv_mean FROM v""")
def o088_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.variation(performance(spark, sf_dir), ["accuracy_score", "cost", "latency"]), 6)


@query(W + "SELECT model, round(100 * stddev_pop(latency) / avg(latency), 4) AS cv_percent, round(100 * stddev_pop(latency), 4) AS std_percent, round(100 * (max(latency) - min(latency)) / avg(latency), 4) AS range_percent, 100 * stddev_pop(latency) / avg(latency) <= 50 AS within FROM performance GROUP BY model")
def o089_variance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.variance_check(performance(spark, sf_dir), "latency", 50.0))


@query(W + f", {_C} SELECT model, round(e, 4) AS easy, round(h, 4) AS hard, round(100 * (e - h) / e, 4) AS loss_percent, 100 * (e - h) / e > 15 AS significant FROM c")
def o090_degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.degradation(performance(spark, sf_dir)))


@query(W + """, o AS (SELECT model = '1-URGENT' AS base, * FROM performance), x AS (SELECT avg(accuracy_score) FILTER (WHERE base) AS a0, avg(accuracy_score) FILTER (WHERE NOT base) AS a1, avg(cost) FILTER (WHERE base) AS c0, avg(cost) FILTER (WHERE NOT base) AS c1 FROM o)
SELECT 'accuracy_score' AS metric, round(100 * (a1 - a0) / a0, 6) AS improvement FROM x UNION ALL SELECT 'cost', round(-100 * (c1 - c0) / c0, 6) FROM x""")
def o091_improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.improvement(performance(spark, sf_dir), F.col("model") == "1-URGENT", {"accuracy_score": False, "cost": True}), 6)


@query(W + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS least, round(max({c})::DOUBLE, 4) AS most FROM performance" for c in ("accuracy_score", "cost", "latency")))
def o092_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.profile(performance(spark, sf_dir), ["accuracy_score", "cost", "latency"]))


@query(W + "SELECT count(DISTINCT model) AS models, count(DISTINCT document_name) AS documents, count(*) AS n, round(avg(accuracy_score), 4) AS accuracy, round(sum(cost), 4) AS cost, round(avg(latency), 4) AS latency, round(avg(success::INT), 4) AS success_rate FROM performance")
def o093_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.overview(performance(spark, sf_dir)))


@query(W + ", g3 AS (SELECT document_name, sum(entities_found)::BIGINT AS entities_found FROM performance GROUP BY ALL), b AS (SELECT quantile_cont(entities_found, 0.8) AS bar FROM g3) SELECT document_name, entities_found, round(bar, 4) AS bar FROM g3, b WHERE entities_found > bar")
def o094_high_entity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.above_percentile(performance(spark, sf_dir), "document_name", "entities_found"))


@query(W + """, r AS (SELECT model, avg(cost) FILTER (WHERE CAST(timestamp AS DATE) > DATE '1998-01-01' - 7) AS recent, avg(cost) FILTER (WHERE NOT CAST(timestamp AS DATE) > DATE '1998-01-01' - 7) AS before FROM performance GROUP BY model)
SELECT model, round(recent, 6) AS recent, round(before, 6) AS before, round(100 * (recent - before) / before, 6) AS change_percent FROM r""")
def o095_recent_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.recent_change(performance(spark, sf_dir), F.to_date("timestamp"), F.to_date(F.lit("1998-01-01")), "cost"), 6)


@query(W + "SELECT model, round(sum(cost) / sum(success::INT), 6) AS cost_per_success, round(sum(entities_found) / sum(cost), 6) AS entities_per_dollar FROM performance GROUP BY model")
def o096_unit_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.unit_costs(performance(spark, sf_dir)), 6)


@query(W + "SELECT least(floor(latency / 2.5::DOUBLE), 19)::INT AS bin, count(*) AS n FROM performance WHERE latency BETWEEN 0 AND 50 GROUP BY ALL")
def o097_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(performance(spark, sf_dir), "latency", 0.0, 50.0, 20)


@query(W + "SELECT document_id, model, round(avg(latency) OVER (PARTITION BY model ORDER BY timestamp, document_id, latency ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS rolling_mean FROM performance")
def o098_rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.rolling_mean(performance(spark, sf_dir).select("document_id", "model", "timestamp", "latency"), ["model"], ["timestamp", "document_id", "latency"], "latency").select("document_id", "model", "rolling_mean"))


@query(W + ", g4 AS (SELECT domain, document_name, count(*) AS n FROM performance GROUP BY ALL) SELECT domain, document_name, n, round(rank() OVER (PARTITION BY domain ORDER BY n DESC) + (count(*) OVER (PARTITION BY domain, n) - 1) / 2.0::DOUBLE, 2) AS rank FROM g4")
def o099_average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = performance(spark, sf_dir).groupBy("domain", "document_name").agg(F.count("*").alias("n"))
    return rounded(A.average_rank(counts, ["domain"], "n"), 2)


@query(W + """, o AS (SELECT model, latency, row_number() OVER (PARTITION BY model ORDER BY timestamp, document_id) AS up, row_number() OVER (PARTITION BY model ORDER BY timestamp DESC, document_id DESC) AS down FROM performance),
e AS (SELECT model, avg(latency) FILTER (WHERE up <= 5) AS f, avg(latency) FILTER (WHERE down <= 5) AS l FROM o GROUP BY model)
SELECT model, round(f, 4) AS first, round(l, 4) AS last, CASE WHEN l > f * 1.05::DOUBLE THEN 'improving' WHEN l < f * 0.95::DOUBLE THEN 'declining' ELSE 'stable' END AS trend FROM e""")
def o101_ends_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.ends_compared(performance(spark, sf_dir), ["model"], ["timestamp", "document_id"], "latency"))


@query(f"WITH {LEDGER_SQL}" + """, d AS (SELECT provider, CAST(timestamp AS DATE) AS day, sum(estimated_cost) AS cost FROM ledger GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY day) - 1 AS k FROM d)
SELECT provider, round(regr_slope(cost, k), 4) AS slope, round(regr_intercept(cost, k) + regr_slope(cost, k) * count(*), 4) AS next, round(7 * avg(cost) + 24.5::DOUBLE * regr_slope(cost, k), 4) AS week_ahead, count(*) AS n FROM x GROUP BY provider""")
def o102_linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ledger(spark, sf_dir).groupBy("provider", F.to_date("timestamp").alias("day")).agg(F.sum("estimated_cost").alias("cost"))
    return rounded(A.linear_trend(daily, ["provider"], ["day"], "cost"))


@query(f"WITH {LEDGER_SQL}, r AS (SELECT session_id, provider, event_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, event_id DESC) AS n FROM ledger) SELECT session_id, provider, event_id FROM r WHERE n = 1")
def o106_latest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.latest(ledger(spark, sf_dir), ["session_id"], ["timestamp", "event_id"]).select("session_id", "provider", "event_id")


@query(W + f""", {_G}, v AS (SELECT model, avg(s / m) AS wi, stddev_pop(m) / avg(m) AS be FROM g GROUP BY model)
SELECT model, round(wi, 6) AS within, round(be, 6) AS between, round(0.6::DOUBLE * least(wi / 2, 1) + 0.4::DOUBLE * least(be / 2, 1), 6) AS variance, round(1 - (0.6::DOUBLE * least(wi / 2, 1) + 0.4::DOUBLE * least(be / 2, 1)), 6) AS stability FROM v""")
def o186_variance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.variance_score(performance(spark, sf_dir)), 6)


@query(W + """, g5 AS (SELECT difficulty, count(*) AS n, avg(latency) AS m, var_samp(latency) AS v FROM performance GROUP BY ALL), o AS (SELECT count(*) AS k, sum(n) AS t, sum(n * m) AS s, sum(n * m * m) AS q, sum((n - 1) * v) AS i FROM g5)
SELECT k - 1 AS df_between, (t - k)::BIGINT AS df_within, round(((q - s * s / t) / (k - 1)) / (i / (t - k)), 4) AS f FROM o""")
def o187_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.anova(performance(spark, sf_dir), "difficulty", "latency"))


@query(W + "SELECT round((SELECT var_pop(m) FROM (SELECT avg(latency) AS m FROM performance GROUP BY difficulty)) / (SELECT var_pop(latency) FROM performance), 8) AS effect")
def o188_effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.effect_size(performance(spark, sf_dir), "difficulty", "latency"), 8)


@query(f"WITH {LEDGER_SQL}" + """, b AS (SELECT provider, model, quantile_cont(estimated_cost, 0.25) AS q1, quantile_cont(estimated_cost, 0.75) AS q3 FROM ledger GROUP BY ALL HAVING count(*) >= 4)
SELECT event_id, provider, model, round(estimated_cost, 6) AS estimated_cost, CASE WHEN greatest(q1 - estimated_cost, estimated_cost - q3) > 2.5::DOUBLE * (q3 - q1) THEN 'high' ELSE 'medium' END AS severity FROM ledger JOIN b USING (provider, model) WHERE greatest(q1 - estimated_cost, estimated_cost - q3) > 1.5::DOUBLE * (q3 - q1)""")
def o189_iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.iqr_outliers(ledger(spark, sf_dir), ["provider", "model"], "estimated_cost")
    return rounded(out.select("event_id", "provider", "model", "estimated_cost", "severity"), 6)


def _beta(x: str, a: str, b: str, steps: int) -> str:
    """DuckDB SQL for the regularised incomplete beta function, by Simpson's rule over the root of its variable."""
    s, w = f"(sqrt({x}) * k / {steps})", f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"""(list_sum(list_transform(range(0, {steps} + 1), lambda k: {w} * pow({s}, 2 * ({a}) - 1) * pow(1 - {s} * {s}, ({b}) - 1))) * sqrt({x}) / {steps} / 3 * 2 * exp(lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b})))"""


def _f_tail(f: str, df1: str, df2: str, steps: int) -> str:
    """DuckDB SQL for the tail of F: the same function in w with x exp(-w² / a) for its variable, so that steps are as fine for any degrees of freedom."""
    a, b, w = f"({df2} / 2.0::DOUBLE)", f"({df1} / 2.0::DOUBLE)", f"(8.0::DOUBLE * k / {steps})"
    log_x = f"(-ln(1 + {df1} * {f} / {df2}))"
    return f"""(exp({a} * {log_x} + lgamma({a} + {b}) - lgamma({a}) - lgamma({b})) / {a} * 8 / {steps} / 3
  * list_sum(list_transform(range(0, {steps} + 1), lambda k: CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * 2 * {w} * exp(-{w} * {w}) * pow(1 - exp({log_x} - {w} * {w} / {a}), {b} - 1))))"""


@query(W + f""", g5 AS (SELECT model, count(*) AS n, avg(latency) AS m, var_samp(latency) AS v FROM performance WHERE domain = 'd1' GROUP BY ALL), o AS (SELECT count(*) AS k, sum(n) AS t, sum(n * m) AS s, sum(n * m * m) AS q, sum((n - 1) * v) AS i FROM g5),
f AS (SELECT k - 1 AS df_between, (t - k)::BIGINT AS df_within, ((q - s * s / t) / (k - 1)) / (i / (t - k)) AS f FROM o)
SELECT df_between, df_within, round(f, 4) AS f, round({_f_tail("f", "df_between", "df_within", 20_000)}, 6) AS p FROM f""")
def o187_anova_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the models of a domain differ in latency."""
    out = A.anova_tail(performance(spark, sf_dir).filter("domain = 'd1'"), "model", "latency")
    return out.select("df_between", "df_within", F.round("f", 4).alias("f"), F.round("p", 6).alias("p"))


@query(W + """, g6 AS (SELECT min(difficulty) AS first, max(difficulty) AS second, count(*) FILTER (WHERE difficulty = 'Easy') AS a, count(*) FILTER (WHERE difficulty = 'Hard') AS b, avg(latency) FILTER (WHERE difficulty = 'Easy') AS ma, avg(latency) FILTER (WHERE difficulty = 'Hard') AS mb,
  var_samp(latency) FILTER (WHERE difficulty = 'Easy') AS va, var_samp(latency) FILTER (WHERE difficulty = 'Hard') AS vb FROM performance WHERE difficulty <> 'Medium'),
t6 AS (SELECT first, second, a + b - 2 AS df, (ma - mb) / sqrt(((a - 1) * va + (b - 1) * vb) / (a + b - 2)) AS d, a, b FROM g6), s6 AS (SELECT *, d / sqrt(1.0::DOUBLE / a + 1.0::DOUBLE / b) AS t FROM t6)
SELECT first, second, df, round(t, 6) AS t, round(d, 6) AS d, round(1 - 2 * abs(t) / 1000 / 3 * exp(lgamma((df + 1) / 2.0::DOUBLE) - lgamma(df / 2.0::DOUBLE)) / sqrt(df * pi())
  * list_sum(list_transform(range(0, 1001), lambda k: CASE WHEN k = 0 OR k = 1000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + t * t * k * k / 1e6::DOUBLE / df, -(df + 1) / 2.0::DOUBLE))), 6) AS p FROM s6""")
def o188_two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t test and Cohen's d of easy against hard documents."""
    return rounded(A.two_groups(performance(spark, sf_dir).filter("difficulty <> 'Medium'"), "difficulty", "latency"), 6)


@query(W.replace("WITH ", "WITH RECURSIVE ", 1) + f""", halves AS (SELECT df, 0.0::DOUBLE AS low, 20.0::DOUBLE AS high, 0 AS k FROM (SELECT unnest(range(1, 29)) AS df)
  UNION ALL SELECT df, CASE WHEN wide THEN (low + high) / 2 ELSE low END, CASE WHEN wide THEN high ELSE (low + high) / 2 END, k + 1
  FROM (SELECT *, {_beta("(df / (df + (low + high) * (low + high) / 4))", "df / 2.0::DOUBLE", "0.5::DOUBLE", 4000)} > 0.05::DOUBLE AS wide FROM halves WHERE k < 40)),
quantiles AS (SELECT df, (low + high) / 2 AS t FROM halves WHERE k = 40),
g7 AS (SELECT model, document_name, count(*) AS n, avg(latency) AS mean, stddev_samp(latency) AS s FROM performance WHERE success GROUP BY ALL)
SELECT model, document_name, n, round(mean, 4) AS mean, round(mean - coalesce(t, 1.96::DOUBLE) * s / sqrt(n), 4) AS low, round(mean + coalesce(t, 1.96::DOUBLE) * s / sqrt(n), 4) AS high FROM g7 LEFT JOIN quantiles ON df = n - 1""")
def o192_t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.t_interval(performance(spark, sf_dir).filter("success"), ["model", "document_name"], "latency"))


_FACTORS = ("model", "difficulty", "domain")
_SHARE = "(SELECT sum(n * pow(m - (SELECT avg(latency) FROM performance), 2)) / (SELECT var_pop(latency) * count(latency) FROM performance) FROM (SELECT count(*) AS n, avg(latency) AS m FROM performance GROUP BY {}))"
_PAIRS = [(a, b) for i, a in enumerate(_FACTORS) for b in _FACTORS[i + 1 :]]


@query(W + ", one AS (" + " UNION ALL ".join([f"SELECT '{f}' AS source, {_SHARE.format(f)} AS share" for f in _FACTORS] + [f"SELECT '{a}*{b}', {_SHARE.format(f'{a}, {b}')} - {_SHARE.format(a)} - {_SHARE.format(b)}" for a, b in _PAIRS]) + """)
SELECT source, round(share, 8) AS share, row_number() OVER (ORDER BY share DESC, source)::INT AS rank FROM one UNION ALL SELECT 'rest', round(1 - sum(share), 8), NULL FROM one""")
def o190_variance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What drives latency: main effects and two-way interactions."""
    return rounded(A.variance_shares(performance(spark, sf_dir), _FACTORS, "latency"), 8)


@query(W + f", {_G} SELECT model, round(avg(1 / (1 + s / m)), 6) AS stability FROM g GROUP BY model")
def o190_stability_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.stability_ranking(performance(spark, sf_dir)), 6)


@query(W + "SELECT model, round(avg(latency), 4) AS mean, round(avg(latency) - 1.96::DOUBLE * stddev_samp(latency) / sqrt(count(*)), 4) AS low, round(avg(latency) + 1.96::DOUBLE * stddev_samp(latency) / sqrt(count(*)), 4) AS high FROM performance GROUP BY model")
def o192_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.interval(performance(spark, sf_dir), ["model"], "latency"))


_M = """s AS (SELECT model, avg(accuracy_score) AS a, avg(cost) AS c, avg(latency) AS l, count(*) AS n FROM performance GROUP BY model HAVING count(*) >= 3),
x AS (SELECT *, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) AS na, 1 - (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS nc, 1 - (l - min(l) OVER ()) / (max(l) OVER () - min(l) OVER ()) AS nl FROM s)"""


@query(W + f", {_M} SELECT model, n, round((na + nc + nl) / 3, 6) AS composite, round(0.5::DOUBLE * na + 0.3::DOUBLE * nc + 0.2::DOUBLE * nl, 6) AS quality, greatest(na, nc, nl) > 0.75::DOUBLE AND least(na, nc, nl) >= 0.25::DOUBLE AS front FROM x")
def o182_decision_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.decision_matrix(performance(spark, sf_dir)).select("model", "n", "composite", "quality", "front"), 6)


@query(W + f""", {_M}, v AS (SELECT model, 0.5::DOUBLE * a / sqrt(sum(a * a) OVER ()) AS a, 0.3::DOUBLE * c / sqrt(sum(c * c) OVER ()) AS c, 0.2::DOUBLE * l / sqrt(sum(l * l) OVER ()) AS l FROM s),
d AS (SELECT model, sqrt(pow(a - max(a) OVER (), 2) + pow(c - min(c) OVER (), 2) + pow(l - min(l) OVER (), 2)) AS p, sqrt(pow(a - min(a) OVER (), 2) + pow(c - max(c) OVER (), 2) + pow(l - max(l) OVER (), 2)) AS q FROM v)
SELECT model, round(q / (p + q), 6) AS closeness, round(rank() OVER (ORDER BY q / (p + q) DESC), 1)::DOUBLE AS rank FROM d""")
def o183_topsis(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.decision_matrix(performance(spark, sf_dir))
    return rounded(A.topsis(m, {"accuracy_mean": 0.5, "cost_mean": 0.3, "latency_mean": 0.2}, ["cost_mean", "latency_mean"]), 6)


_SCENARIOS = [("even", 1 / 3, 1 / 3, 1 / 3), ("accuracy", 0.6, 0.2, 0.2), ("cost", 0.2, 0.6, 0.2), ("speed", 0.2, 0.2, 0.6)]


@query(W + f""", {_M}, w AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for n, a, b, c in _SCENARIOS)}) t(scenario, wa, wc, wl)),
r AS (SELECT model, rank() OVER (PARTITION BY scenario ORDER BY na * wa + nc * wc + nl * wl DESC) AS k FROM x, w) SELECT model, round(avg(k), 6) AS mean_rank, round(stddev_samp(k), 6) AS rank_std FROM r GROUP BY model""")
def o184_weight_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios = spark.createDataFrame(_SCENARIOS, "scenario string, w_accuracy_norm double, w_cost_norm double, w_latency_norm double")
    m = A.decision_matrix(performance(spark, sf_dir))
    return rounded(A.weight_sensitivity(m, scenarios, ["accuracy_norm", "cost_norm", "latency_norm"]), 6)


@query(W + f", {_M} SELECT model, round(a, 4) AS accuracy_mean, round(l, 4) AS latency_mean FROM x WHERE a >= 0.5 AND l <= 25.6::DOUBLE")
def o185_constrained_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.decision_matrix(performance(spark, sf_dir))
    return rounded(A.constrained_best(m, "quality", accuracy_mean=(0.5, None), latency_mean=(None, 25.6)).select("model", "accuracy_mean", "latency_mean"))
