"""Model analytics: groups, windows, trends, variance, outliers and decision scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import f_tail, t_quantile, t_tails
from ..functions.text import ratio
from .scan import percentiles, trailed

DIFFICULTIES = ("Easy", "Medium", "Hard", "Very Hard")
#: Weights of variance scores, thresholds of ratings.
VARIANCE_WEIGHTS = (0.6, 0.4)


def enrich(rows: DataFrame, scores: str, success: str, model: str) -> DataFrame:
    """accuracy: the mean of the scores, 0.8 for a success without any, 0 for a failure; provider: what stands before the slash."""
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    accuracy = F.when(~F.col(success), 0.0).when(F.coalesce(F.size(scores), F.lit(0)) > 0, mean).otherwise(0.8)
    return rows.withColumns({"accuracy": accuracy, "provider": F.when(F.contains(F.col(model), F.lit("/")), F.split_part(F.col(model), F.lit("/"), F.lit(1))).otherwise("unknown")})


def summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and count of accuracy; mean cost and latency; success rate."""
    return rows.groupBy(*by).agg(
        F.avg("accuracy_score").alias("accuracy_mean"), F.stddev_samp("accuracy_score").alias("accuracy_std"), F.count("*").alias("n"), F.avg("cost").alias("cost_mean"), F.avg("latency").alias("latency_mean"),
        F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("success_rate"),
    )


def by_difficulty(rows: DataFrame) -> DataFrame:
    """summary() with the place of each level in the fixed order."""
    place = F.array_position(F.array(*map(F.lit, DIFFICULTIES)), F.col("difficulty"))
    return summary(rows, ["difficulty"]).withColumn("place", place.cast("int"))


def daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.to_date("timestamp").alias("day")).agg(F.avg("accuracy_score").alias("accuracy_mean"), F.sum("cost").alias("cost_sum"))


def efficiency(rows: DataFrame) -> DataFrame:
    """Accuracy for cost and for latency."""
    out = rows.groupBy("model").agg(F.avg("accuracy_score").alias("a"), F.avg("cost").alias("c"), F.avg("latency").alias("l"))
    return out.select("model", ratio(F.col("a"), F.col("c")).alias("cost_efficiency"), ratio(F.col("a"), F.col("l")).alias("speed_efficiency"))


def latency_profile(rows: DataFrame) -> DataFrame:
    """Exact 95th percentile with linear interpolation."""
    out = rows.groupBy("model").agg(F.avg("latency").alias("mean"), F.min("latency").alias("least"), F.max("latency").alias("most"))
    high = percentiles(rows, ["model"], "latency", [0.95]).select(F.col("model").alias("_model"), F.col("q")[0].alias("p95"))
    return out.join(high, out["model"].eqNullSafe(high["_model"]), "left").drop("_model")


def correlations(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each pair of columns, each unordered pair computed in the same pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = rows.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs))).alias("s")).select("s.*")


def pivoted(rows: DataFrame, values: Sequence[str] = DIFFICULTIES) -> DataFrame:
    """Mean accuracy by model and difficulty, 0 where there is none, and the sample variance of a model's row."""
    wide = rows.groupBy("model").pivot("difficulty", list(values)).agg(F.avg("accuracy_score")).fillna(0.0)
    cells = F.array(*(F.col(f"`{v}`") for v in values))
    mean = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x) / len(values)
    squares = F.aggregate(F.transform(cells, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return wide.withColumn("row_variance", squares / (len(values) - 1))


def adaptability(rows: DataFrame, sample: bool = False, group: str = "difficulty") -> DataFrame:
    """1 less the variation of a model's group means, 0 at least; sample: sample deviation in place of population's."""
    means = rows.groupBy("model", group).agg(F.avg("accuracy_score").alias("m"))
    spread = F.stddev_samp("m") if sample else F.stddev_pop("m")
    return means.groupBy("model").agg(F.greatest(1 - ratio(spread, F.avg("m")), F.lit(0.0)).alias("adaptability"))


def steadiness(rows: DataFrame) -> DataFrame:
    """consistency: 1 less the deviation; robustness: share of accuracies above 0.7."""
    return rows.groupBy("model").agg((1 - F.least(F.stddev_samp("accuracy_score"), F.lit(1.0))).alias("consistency"), F.avg(F.when(F.col("accuracy_score") > 0.7, 1.0).otherwise(0.0)).alias("robustness"))


def variation(rows: DataFrame, metrics: Sequence[str], group: str = "difficulty") -> DataFrame:
    """Coefficient of variation of each metric's group means, and their mean."""
    means = rows.groupBy(group).agg(*(F.avg(m).alias(m) for m in metrics))
    out = means.agg(*(ratio(F.stddev_pop(m), F.avg(m)).alias(f"cv_{m}") for m in metrics))
    total = sum((F.col(f"cv_{m}") for m in metrics[1:]), F.col(f"cv_{metrics[0]}"))
    return out.withColumn("cv_mean", total / len(metrics))


def variance_check(rows: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Per cent of variation, deviation and range of each model, and whether variation is within threshold."""
    out = rows.groupBy("model").agg(F.stddev_pop(metric).alias("std"), F.avg(metric).alias("mean"), (F.max(metric) - F.min(metric)).alias("range"))
    cv = 100 * ratio(F.col("std"), F.col("mean"))
    return out.select("model", cv.alias("cv_percent"), (100 * F.col("std")).alias("std_percent"), (100 * ratio(F.col("range"), F.col("mean"))).alias("range_percent"), (cv <= threshold).alias("within"))


def degradation(rows: DataFrame, hard: str = "Hard") -> DataFrame:
    """Loss of mean accuracy from Easy to hard in per cent; over 15 is significant."""
    means = rows.groupBy("model").agg(*(F.avg(F.when(F.col("difficulty") == d, F.col("accuracy_score"))).alias(n) for d, n in (("Easy", "easy"), (hard, "hard"))))
    loss = 100 * ratio(F.col("easy") - F.col("hard"), F.col("easy"))
    return means.select("model", "easy", "hard", loss.alias("loss_percent"), (loss > 15).alias("significant"))


def improvement(rows: DataFrame, base: Column, metrics: Mapping[str, bool]) -> DataFrame:
    """Change from the base rows to the others in per cent for each metric; True: lower is better, so the sign turns."""
    one = rows.agg(*(F.avg(F.when(base if side == "base" else ~base, F.col(m))).alias(f"{m}_{side}") for m in metrics for side in ("base", "other")))
    change = [(m, (-100 if low else 100) * F.when(F.col(f"{m}_base") != 0, (F.col(f"{m}_other") - F.col(f"{m}_base")) / F.col(f"{m}_base")).otherwise(0.0)) for m, low in metrics.items()]
    return one.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c.alias("improvement")) for m, c in change))).alias("s")).select("s.*")


def profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, nulls, distinct values and moments of each column, all in one pass."""
    parts = [(c, F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("most"))) for c in columns]
    return rows.agg(*(p.alias(c) for c, p in parts)).select(F.explode(F.array(*(F.col(c) for c, _ in parts))).alias("s")).select("s.*")


def overview(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("model").alias("models"), F.countDistinct("document_name").alias("documents"), F.count("*").alias("n"), F.avg("accuracy_score").alias("accuracy"), F.sum("cost").alias("cost"), F.avg("latency").alias("latency"), F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("success_rate"))


def above_percentile(rows: DataFrame, key: str, value: str, at: float = 0.8) -> DataFrame:
    """Groups whose summed value is above the given percentile of all groups."""
    sums = rows.groupBy(key).agg(F.sum(value).alias(value))
    bar = percentiles(sums, [], value, [at]).select(F.col("q")[0].alias("bar"))  # one row
    return sums.crossJoin(F.broadcast(bar)).filter(F.col(value) > F.col("bar"))


def recent_change(rows: DataFrame, day: Column, as_of: Column, value: str, days: int = 7) -> DataFrame:
    """Mean of the last days against that of the time before, in per cent, by model."""
    recent = day > F.date_sub(as_of, days)
    out = rows.groupBy("model").agg(F.avg(F.when(recent, F.col(value))).alias("recent"), F.avg(F.when(~recent, F.col(value))).alias("before"))
    return out.withColumn("change_percent", 100 * ratio(F.col("recent") - F.col("before"), F.col("before")))


def unit_costs(rows: DataFrame) -> DataFrame:
    """Cost of a success, and entities for a dollar, by model."""
    good = F.sum(F.when(F.col("success"), 1).otherwise(0))
    return rows.groupBy("model").agg(ratio(F.sum("cost"), good).alias("cost_per_success"), ratio(F.sum("entities_found"), F.sum("cost")).alias("entities_per_dollar"))


def histogram(rows: DataFrame, value: str, least: float, most: float, bins: int) -> DataFrame:
    """Equal bins between least and most; most itself is in the last."""
    place = F.least(F.floor((F.col(value) - least) / ((most - least) / bins)), F.lit(bins - 1))
    return rows.filter(F.col(value).between(least, most)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


# --- windows -------------------------------------------------------------------------------------


def rolling_mean(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, width: int = 5) -> DataFrame:
    """Mean of each row's value and those of the width - 1 rows before it, nulls left out."""
    return trailed(rows, by, order, width, lambda w: F.avg(F.col(value).cast("double")).over(w), "rolling_mean")


def average_rank(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rank from the highest value down; ties share the mean of their places."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    peers = F.count("*").over(Window.partitionBy(*by, value))
    return rows.withColumn("rank", F.rank().over(w) + (peers - 1) / 2.0)


def ends_compared(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int = 5, band: float = 0.05) -> DataFrame:
    """Mean of the first n and the last n values of each group, and the trend between them."""
    ends = []
    for end, o in (("first", F.asc), ("last", F.desc)):
        # a limit on the row number is kept by each task before rows are dealt by group, so that a group's task gets n rows of each
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*(o(c) for c in order)))
        ends.append(rows.select(*by, *(c for c in order if c not in by), F.col(value).alias("_v")).withColumn("_n", place).filter(F.col("_n") <= n).select(*by, F.lit(end).alias("_end"), "_v"))
    out = ends[0].unionAll(ends[1]).groupBy(*by).agg(*(F.avg(F.when(F.col("_end") == end, F.col("_v"))).alias(end) for end in ("first", "last")))
    return out.withColumn("trend", F.when(F.col("last") > F.col("first") * (1 + band), "improving").when(F.col("last") < F.col("first") * (1 - band), "declining").otherwise("stable"))


def linear_trend(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Slope over the row number, the next value, and the sum of the next seven."""
    nth = rows.withColumn("x", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    out = nth.groupBy(*by).agg(F.regr_slope(value, "x").alias("slope"), F.regr_intercept(value, "x").alias("intercept"), F.avg(value).alias("mean"), F.count("*").alias("n"))
    return out.select(*by, "slope", (F.col("intercept") + F.col("slope") * F.col("n")).alias("next"), (7 * F.col("mean") + 24.5 * F.col("slope")).alias("week_ahead"), "n")


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order)))).filter("_n = 1").drop("_n")


# --- variance and decisions ----------------------------------------------------------------------


def variance_score(rows: DataFrame, metric: str = "accuracy_score", group: str = "difficulty") -> DataFrame:
    """0.6 of the mean variation within groups and 0.4 of that between group means, each halved and at most 1; stability is the rest to 1."""
    groups = rows.groupBy("model", group).agg(F.avg(metric).alias("m"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("s"))
    out = groups.groupBy("model").agg(F.avg(ratio(F.col("s"), F.col("m"))).alias("within"), ratio(F.stddev_pop("m"), F.avg("m")).alias("between"))
    a, b = VARIANCE_WEIGHTS
    score = a * F.least(F.col("within") / 2, F.lit(1.0)) + b * F.least(F.col("between") / 2, F.lit(1.0))
    return out.select("model", "within", "between", score.alias("variance"), (1 - score).alias("stability"))


def anova(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The F statistic of the groups and its degrees of freedom."""
    g = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    one = g.agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("m")).alias("sum"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("squares"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("inside"))
    between = (F.col("squares") - F.col("sum") * F.col("sum") / F.col("total")) / (F.col("k") - 1)
    return one.select((F.col("k") - 1).alias("df_between"), (F.col("total") - F.col("k")).alias("df_within"), ratio(between, F.col("inside") / (F.col("total") - F.col("k"))).alias("f"))


def effect_size(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the variance that lies between group means."""
    means = rows.groupBy(group).agg(F.avg(value).alias("m")).agg(F.var_pop("m").alias("between"))
    return means.crossJoin(rows.agg(F.var_pop(value).alias("all"))).select(ratio(F.col("between"), F.col("all")).alias("effect"))


def iqr_outliers(rows: DataFrame, by: Sequence[str], value: str, least: int = 4) -> DataFrame:
    """Rows beyond 1.5 interquartile ranges from their group's quartiles; beyond 2.5 they are severe."""
    q = percentiles(rows, by, value, [0.25, 0.75]).filter(F.col("n") >= least)
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    away = F.greatest(F.col("q1") - F.col(value), F.col(value) - F.col("q3"))
    iqr = F.col("q3") - F.col("q1")
    return rows.join(q, list(by)).filter(away > 1.5 * iqr).withColumn("severity", F.when(away > 2.5 * iqr, "high").otherwise("medium"))


def anova_tail(rows: DataFrame, group: str, value: str) -> DataFrame:
    """anova() with p, the probability of an F as large if all groups had one mean."""
    return anova(rows, group, value).withColumn("p", f_tail(F.col("f"), F.col("df_between"), F.col("df_within")))


def two_groups(rows: DataFrame, group: str, value: str) -> DataFrame:
    """t of two groups with one variance, its degrees of freedom, p on both sides, and Cohen's d; no row unless there are two groups.

    The first group is the one whose name comes first.
    """
    g = rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    few = g.orderBy(group).limit(3)  # a third group, if there is any, tells that there are more than two
    one = few.agg(F.array_sort(F.collect_list(F.struct(group, "n", "m", "v"))).alias("s")).filter(F.size("s") == 2)
    a, b = F.col("s")[0], F.col("s")[1]
    df = a["n"] + b["n"] - 2
    pooled = F.sqrt(((a["n"] - 1) * a["v"] + (b["n"] - 1) * b["v"]) / df)
    t = (a["m"] - b["m"]) / (pooled * F.sqrt(1 / a["n"] + 1 / b["n"]))
    out = one.select(a[group].alias("first"), b[group].alias("second"), df.alias("df"), F.when(pooled > 0, t).alias("t"), F.when(pooled > 0, (a["m"] - b["m"]) / pooled).alias("d"))
    return out.withColumn("p", t_tails(F.col("t"), F.col("df")))


def variance_shares(rows: DataFrame, factors: Sequence[str], value: str) -> DataFrame:
    """Shares of the variance of value: of each factor, of each pair of factors beyond its two, and what is left; they add up to 1.

    All means come from one pass over grouping sets. Where factors are not dealt evenly, a pair's share may fall below 0. rank orders the drivers, 1 the
    largest; what is left has none.
    """
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    sets = [[], *([f] for f in factors), *([a, b] for a, b in pairs)]
    known = rows.filter(F.col(value).isNotNull()).select(*(F.col(f).cast("string").alias(f) for f in factors), F.col(value).cast("double").alias("_v"))
    means = known.groupingSets([[F.col(c) for c in x] for x in sets], *map(F.col, factors)).agg(F.grouping_id(*factors).alias("_set"), F.count("*").alias("_n"), F.avg("_v").alias("_m"), F.var_pop("_v").alias("_s"))
    whole = means.filter(F.col("_set") == 2 ** len(factors) - 1).select(F.col("_m").alias("_mean"), (F.col("_s") * F.col("_n")).alias("_total"))
    between = F.sum(F.col("_n") * F.pow(F.col("_m") - F.col("_mean"), F.lit(2.0)))
    own = means.crossJoin(F.broadcast(whole)).groupBy("_set").agg(ratio(between, F.first("_total")).alias("_share"))
    code = lambda x: sum(0 if f in x else 2 ** (len(factors) - 1 - i) for i, f in enumerate(factors))
    wide = own.agg(*(F.coalesce(F.max(F.when(F.col("_set") == code(x), F.col("_share"))), F.lit(0.0)).alias("*".join(x)) for x in sets[1:]))
    shares = [(f, F.col(f)) for f in factors] + [(f"{a}*{b}", F.col(f"`{a}*{b}`") - F.col(a) - F.col(b)) for a, b in pairs]
    left = F.lit(1.0)
    for _, c in shares:
        left = left - c
    long = wide.select(F.inline(F.array(*(F.struct(F.lit(n).alias("source"), c.alias("share")) for n, c in [*shares, ("rest", left)]))))
    rank = F.row_number().over(Window.partitionBy(F.col("source") == "rest").orderBy(F.desc("share"), "source"))  # a row for each share
    return long.withColumn("rank", F.when(F.col("source") != "rest", rank))


def t_interval(rows: DataFrame, by: Sequence[str], value: str, share: float = 0.95, few: int = 30) -> DataFrame:
    """Confidence interval of each group's mean: by t for fewer than `few` values, else by the normal 1.96; null bounds for one value."""
    spark = rows.sparkSession
    quantiles = spark.range(1, few - 1).select(F.col("id").alias("_df"), t_quantile(share, F.col("id")).alias("_t"))  # a row for each degree of freedom below few
    g = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    out = g.join(F.broadcast(quantiles), g["n"] - 1 == quantiles["_df"], "left")
    half = F.when(F.col("n") > 1, F.coalesce("_t", F.lit(1.96)) * F.col("_s") / F.sqrt("n"))
    return out.select(*by, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def interval(rows: DataFrame, by: Sequence[str], value: str, z: float = 1.96) -> DataFrame:
    """Normal confidence interval of the mean."""
    out = rows.groupBy(*by).agg(F.avg(value).alias("mean"), (z * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("half"))
    return out.select(*by, "mean", (F.col("mean") - F.col("half")).alias("low"), (F.col("mean") + F.col("half")).alias("high"))


def stability_ranking(rows: DataFrame, group: str = "difficulty", metric: str = "accuracy_score") -> DataFrame:
    """Mean of 1 / (1 + variation) over a model's groups."""
    g = rows.groupBy("model", group).agg(ratio(F.stddev_samp(metric), F.avg(metric)).alias("cv"))
    return g.groupBy("model").agg(F.avg(1 / (1 + F.coalesce("cv", F.lit(0.0)))).alias("stability"))


def decision_matrix(rows: DataFrame, least: int = 3) -> DataFrame:
    """Models with enough samples: means, min-max norms (cost and latency turned), composite and quality scores, and a front mark."""
    out = summary(rows, ["model"]).filter(F.col("n") >= least)
    every = Window.partitionBy()  # one row for each model

    def norm(c: str, turn: bool) -> Column:
        lo, hi = F.min(c).over(every), F.max(c).over(every)
        x = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)
        return F.when(hi > lo, 1 - x).otherwise(0.5) if turn else x

    out = out.withColumns({"accuracy_norm": norm("accuracy_mean", False), "cost_norm": norm("cost_mean", True), "latency_norm": norm("latency_mean", True)})
    norms = [F.col("accuracy_norm"), F.col("cost_norm"), F.col("latency_norm")]
    front = (F.greatest(*norms) > 0.75) & (F.least(*norms) >= 0.25)
    return out.withColumns({"composite": (norms[0] + norms[1] + norms[2]) / 3, "quality": 0.5 * norms[0] + 0.3 * norms[1] + 0.2 * norms[2], "front": front})


def topsis(matrix: DataFrame, weights: Mapping[str, float], lower_is_better: Sequence[str], key: str = "model") -> DataFrame:
    """Closeness to the ideal alternative after vector normalisation, and the rank by it."""
    every = Window.partitionBy()  # one row for each alternative
    out = matrix.select(key, *weights)
    for c, w in weights.items():
        out = out.withColumn(c, w * F.col(c) / F.nullif(F.sqrt(F.sum(F.col(c) * F.col(c)).over(every)), F.lit(0.0)))
    best, worst = F.lit(0.0), F.lit(0.0)
    for c in weights:
        lo, hi = F.min(c).over(every), F.max(c).over(every)
        good, bad = (lo, hi) if c in lower_is_better else (hi, lo)
        best, worst = best + F.pow(F.coalesce(F.col(c) - good, F.lit(0.0)), F.lit(2.0)), worst + F.pow(F.coalesce(F.col(c) - bad, F.lit(0.0)), F.lit(2.0))
    out = out.withColumns({"to_best": F.sqrt(best), "to_worst": F.sqrt(worst)})
    out = out.select(key, ratio(F.col("to_worst"), F.col("to_best") + F.col("to_worst")).alias("closeness"))
    return average_rank(out, [], "closeness")


def weight_sensitivity(matrix: DataFrame, scenarios: DataFrame, norms: Sequence[str], key: str = "model") -> DataFrame:
    """Rank of each model under each scenario's weights; scenarios has a row for each, with a weight for each norm."""
    score = sum((F.col(n) * F.col(f"w_{n}") for n in norms[1:]), F.col(norms[0]) * F.col(f"w_{norms[0]}"))
    scored = matrix.crossJoin(F.broadcast(scenarios)).withColumn("score", score)
    ranked = average_rank(scored, ["scenario"], "score")
    return ranked.groupBy(key).agg(F.avg("rank").alias("mean_rank"), F.stddev_samp("rank").alias("rank_std"))


def constrained_best(matrix: DataFrame, order: str, **limits: tuple[float | None, float | None]) -> DataFrame:
    """Models within limits (least, most) by column, best first."""
    for c, (lo, hi) in limits.items():
        matrix = matrix.filter((F.col(c) >= lo if lo is not None else F.lit(True)) & (F.col(c) <= hi if hi is not None else F.lit(True)))
    return matrix.orderBy(F.desc(order), "model")
