"""Choosing models: routes, fallbacks, experiments; and the life of batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..sources.sinks import checkpointed
from .analytics import average_rank

#: Weights of accuracy, speed, cost and reliability by strategy.
STRATEGIES = {"accuracy": (0.6, 0.1, 0.1, 0.2), "speed": (0.2, 0.5, 0.1, 0.2), "cost": (0.2, 0.1, 0.5, 0.2), "balanced": (0.35, 0.2, 0.2, 0.25)}


def route_scores(models: DataFrame, strategy: str, max_cost: float | None = None, max_seconds: float | None = None) -> DataFrame:
    """Score of each model: accuracy, speed (30 s are 0), cost (a cent is 0) and reliability by the strategy's weights; halved beyond a limit; 0.5 if never tried."""
    a, s, c, r = STRATEGIES[strategy]
    score = a * F.col("accuracy") + s * (1 - F.least(F.col("seconds") / 30, F.lit(1.0))) + c * (1 - F.least(F.col("cost") / 0.01, F.lit(1.0))) + r * F.col("reliability")
    score = F.when(F.coalesce(F.col("requests"), F.lit(0)) == 0, 0.5).otherwise(score)
    for limit, value in ((max_cost, F.col("cost")), (max_seconds, F.col("seconds"))):
        if limit is not None:
            score = F.when(value > limit, score * 0.5).otherwise(score)
    return models.withColumn("score", score)


def route(models: DataFrame, by: Sequence[str], strategy: str, alternatives: int = 5, **limits: float | None) -> DataFrame:
    """The best model of each group and its alternatives, by place."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "model")
    return route_scores(models, strategy, **limits).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 1 + alternatives)


def first_success(attempts: DataFrame, by: Sequence[str], priority: str = "priority") -> DataFrame:
    """The first attempt in priority that succeeded."""
    w = Window.partitionBy(*by).orderBy(priority)
    return attempts.filter("success").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_value(models: DataFrame, n: int = 10) -> DataFrame:
    return models.withColumn("value", ratio(F.col("quality"), F.col("cost"))).orderBy(F.desc("value"), "model").limit(n)


def extremes(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The fastest, the richest and the cheapest model of each group; ties by name."""
    least = lambda c: F.min_by("model", F.struct(c, F.col("model")))
    return rows.groupBy(*by).agg(least(F.col("latency")).alias("fastest"), least(-F.col("entities_found")).alias("most_entities"), least(F.col("cost")).alias("cheapest"))


def variant(user: Column, experiment: str, split: Mapping[str, float]) -> Column:
    """The variant of a user: an MD5 bucket of ten thousand against the running sum of the split; the last takes what is left."""
    bucket = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{experiment}:"), user)), 1, 8), 16, 10).cast("long"), F.lit(10000)) / 10000
    out, total, names = None, 0.0, list(split)
    for name in names[:-1]:
        total += split[name]
        out = F.when(bucket <= total, name) if out is None else out.when(bucket <= total, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def experiment_summary(rows: DataFrame, metric: str, band: float = 0.05) -> DataFrame:
    """Mean of each variant, its difference to the best other mean, and whether that is more than band."""
    means = rows.groupBy("variant").agg(F.count("*").alias("n"), F.avg(metric).alias("mean"))
    every = Window.partitionBy()  # a row for each variant
    best = F.max("mean").over(every)
    return means.withColumns({"winner": F.col("mean") == best, "behind": ratio(best - F.col("mean"), best), "significant": ratio(best - F.col("mean"), best) > band})


def version_ranking(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rank of each version by each metric."""
    long = metrics.select("version", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names))))
    return average_rank(long, ["metric"], "value")


def metric_comparison(metrics: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """Best, worst and mean of each metric."""
    long = metrics.select(key, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names)))).filter("value is not null")
    return long.groupBy("metric").agg(F.min_by(key, F.struct(-F.col("value"), F.col(key))).alias("best"), F.min_by(key, F.struct("value", key)).alias("worst"), F.avg("value").alias("mean"))


# --- batches -------------------------------------------------------------------------------------


def new_batch(documents: DataFrame, batch_id: str, at: datetime) -> tuple[DataFrame, DataFrame]:
    """The header of a batch and a pending row for each document."""
    rows = documents.select(F.lit(batch_id).alias("batch_id"), "document_id", F.lit("pending").alias("status"), F.lit(0.0).alias("cost"), F.lit(at).alias("created_at"))
    return rows.groupBy("batch_id", "created_at").agg(F.count("*").alias("documents"), F.lit("created").alias("status")), rows


def current(events: DataFrame, by: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Latest state from status events: the last status; of keep, the last value that is set and above 0."""
    seen = F.struct(*order)
    return events.groupBy(*by).agg(F.max_by("status", seen).alias("status"), *(F.max_by(c, F.when(F.col(c) > 0, seen)).alias(c) for c in keep), F.max(F.when(F.col("status").isin("completed", "failed"), F.col(order[0]))).alias("processed_at"))


def cancel(documents: DataFrame, batch_id: Column) -> DataFrame:
    """Pending documents of a batch are cancelled."""
    return documents.withColumn("status", F.when((F.col("batch_id") == batch_id) & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status")))


def retained(parents: DataFrame, children: DataFrame, as_of: datetime, days: int, key: str, at: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """Parents that are not older than days, and the children they still have."""
    old = parents.filter((F.col(at) < F.lit(as_of - timedelta(days=days))) & F.col("status").isin("completed", "failed", "cancelled")).select(key).distinct()
    return parents.join(old, key, "left_anti"), children.join(old, key, "left_anti")


def page(rows: DataFrame, order: Sequence[Column], size: int, number: int) -> DataFrame:
    """A page of rows (number from 0)."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Adds name: each row's place, from 1, in the given order over all rows; rows that tie follow the scan.

    Rows are dealt by range; the number within a partition plus the rows of the partitions before it
    is the place in the whole.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*order, F.col("_scan")]
    # The checkpoint fixes the partition of each row: another pass might sample other range bounds.
    dealt = checkpointed(rows.withColumn("_scan", F.monotonically_increasing_id()).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order)
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.row_number().over(within)).drop("_part", "_scan", "_before")


def split(rows: DataFrame, key: str, shares: Mapping[str, float], salt: str = "split") -> DataFrame:
    """Adds part: rows dealt by the order of a salted hash of key, in the given shares of their number, as whole rows; the last part takes the rest.

    The order is global: rows are dealt by range of their hash and numbered, see numbered().
    """
    total = rows.count()
    names, at, part = list(shares), 0, None
    for n in names[:-1]:
        at += int(total * shares[n])
        part = F.when(F.col("_n") <= at, n) if part is None else part.when(F.col("_n") <= at, n)
    ranked = numbered(rows.withColumn("_hash", F.xxhash64(F.lit(salt), F.col(key))), [F.col("_hash"), F.col(key)], "_n")
    return ranked.withColumn("part", part.otherwise(names[-1]) if part is not None else F.lit(names[0])).drop("_hash", "_n")


def bootstrap(rows: DataFrame, value: str, times: int = 100, seed: int = 7, key: Sequence[str] | None = None) -> DataFrame:
    """Variance of the mean over Poisson bootstrap replicates, which need no second pass: each row counts a Poisson number of times in each.

    A row's draws depend on its key (all its columns if none is named) and not on how rows are dealt. What is
    shuffled is one sum for each task and replicate.
    """
    from math import exp

    def poisson(r: Column) -> Column:
        u = (F.pmod(F.xxhash64(F.col("_row"), r, F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
        total, p, out = 0.0, exp(-1), None
        for k in range(8):
            total += p
            out = F.when(u < total, k) if out is None else out.when(u < total, k)
            p /= k + 1
        return out.otherwise(8)

    drawn = rows.select(F.col(value).alias("v"), F.xxhash64(*(key or rows.columns)).alias("_row")).select("v", "_row", F.explode(F.sequence(F.lit(1), F.lit(times))).alias("r"))
    means = drawn.withColumn("n", poisson(F.col("r"))).groupBy("r").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.var_samp("m").alias("variance"))
