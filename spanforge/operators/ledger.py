"""Usage ledger, budgets and run history as aggregations.

Time-dependent functions take as_of instead of asking the clock. Sums of no rows are 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from .scan import decays, scanned, sums

#: Dollars for a thousand input and output tokens where a price is unknown, and the safety margin of estimates.
FALLBACK_PRICE, MARGIN = (0.001, 0.003), 1.1
DEFAULT_TOKENS = (800, 500)


def total(column: str, digits: int | None = None) -> Column:
    out = F.coalesce(F.sum(column), F.lit(0))
    return out if digits is None else F.round(out, digits)


def _measures() -> list[Column]:
    good = F.sum(F.when(F.col("success"), 1).otherwise(0))
    return [F.count("*").alias("requests"), total("total_tokens").alias("tokens"), total("estimated_cost").alias("cost"), good.alias("successes")]


def session_summary(ledger: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Counts, sums and success rate (per cent) of each session."""
    good = F.sum(F.when(F.col("success"), 1).otherwise(0))
    return ledger.groupBy(*by).agg(
        F.count("*").alias("requests"), total("input_tokens").alias("input_tokens"), total("output_tokens").alias("output_tokens"), total("total_tokens").alias("total_tokens"),
        total("estimated_cost").alias("estimated_cost"), total("actual_cost").alias("actual_cost"), F.avg("processing_time").alias("avg_processing_time"),
        good.alias("successes"), (F.count("*") - good).alias("failures"), (100.0 * good / F.count("*")).alias("success_rate"),
    )


def by_provider(ledger: DataFrame, by: Sequence[str] = ("session_id", "provider")) -> DataFrame:
    return ledger.groupBy(*by).agg(*_measures())


def by_model(ledger: DataFrame) -> DataFrame:
    """Measures of each provider/model."""
    return ledger.groupBy(F.concat_ws("/", "provider", "model").alias("model_key")).agg(*_measures())


def daily_cost(ledger: DataFrame, day: date) -> DataFrame:
    """Cost by provider on a day; provider null is the total."""
    on = ledger.filter((F.col("timestamp") >= F.lit(datetime(day.year, day.month, day.day))) & (F.col("timestamp") < F.lit(datetime(day.year, day.month, day.day) + timedelta(1))))
    return on.rollup("provider").agg(F.count("*").alias("requests"), total("estimated_cost").alias("cost"))


def monthly_cost(ledger: DataFrame, year: int, month: int) -> DataFrame:
    """Cost by provider and day in a month; nulls are totals."""
    first, after = datetime(year, month, 1), datetime(year + month // 12, month % 12 + 1, 1)
    span = ledger.filter((F.col("timestamp") >= F.lit(first)) & (F.col("timestamp") < F.lit(after))).withColumn("day", F.to_date("timestamp"))
    return span.groupingSets([["provider"], ["day"], []], "provider", "day").agg(F.count("*").alias("requests"), total("estimated_cost").alias("cost"))


def since(ledger: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return ledger.filter(F.col("timestamp").between(F.lit(as_of - timedelta(days=days)), F.lit(as_of)))


def cost_trend(ledger: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return since(ledger, as_of, days).groupBy(F.to_date("timestamp").alias("day")).agg(*_measures())


def top_models(ledger: DataFrame, n: int = 10) -> DataFrame:
    """The n models that cost most; ties by name."""
    out = ledger.groupBy("provider", "model").agg(*_measures(), F.avg("estimated_cost").alias("avg_cost"))
    return out.orderBy(F.desc("cost"), "provider", "model").limit(n)


def hourly_pattern(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(F.date_format("timestamp", "HH").alias("hour")).agg(F.count("*").alias("requests"), F.avg("estimated_cost").alias("avg_cost"))


def error_analysis(ledger: DataFrame) -> DataFrame:
    return ledger.filter(~F.col("success")).groupBy("provider", "model", "error_message").agg(F.count("*").alias("errors"))


def overall(ledger: DataFrame) -> DataFrame:
    """Totals, and the mean cost of a request."""
    out = ledger.agg(F.count("*").alias("requests"), total("estimated_cost").alias("cost"), total("total_tokens").alias("tokens"))
    return out.withColumn("avg_cost", F.col("cost") / F.greatest("requests", F.lit(1)))


def batch_status(documents: DataFrame) -> DataFrame:
    """Totals of each batch and its status: processing while some are neither completed nor failed."""
    out = documents.groupBy("batch_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), total("cost").alias("cost"))
    done = F.col("completed") + F.col("failed") >= F.col("total")
    return out.withColumn("batch_status", F.when(~done, "processing").when(F.col("failed") == 0, "completed").otherwise("completed_with_errors"))


def joined(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each result with its run's model and time."""
    own = runs.select(F.col("id").alias("run_id"), F.col("model_used"), F.col("timestamp").alias("run_timestamp"))
    return results.join(own, "run_id")


def model_performance(runs: DataFrame, results: DataFrame, by: Sequence[str] = ("model_used", "day")) -> DataFrame:
    """Runs, documents, sums, means and success rate of each model and day."""
    rows = joined(runs, results).withColumn("day", F.to_date("run_timestamp"))
    return rows.groupBy(*by).agg(
        F.countDistinct("run_id").alias("total_runs"), F.count("*").alias("total_documents"), total("cost").alias("total_cost"), total("entities_found").alias("total_entities"),
        F.avg("processing_time").alias("avg_processing_time"), F.avg("confidence").alias("avg_confidence"),
        F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("success_rate"), ratio(F.sum("cost"), F.count("*")).alias("cost_per_document"),
    )


def run_rollup(results: DataFrame) -> DataFrame:
    """What a run's results add up to; mean confidence is that of successes with any."""
    good = F.col("success")
    out = results.groupBy("run_id").agg(
        F.count("*").alias("documents"), F.count_if(good).alias("successes"), total("cost").alias("cost"), total("entities_found").alias("entities"), total("processing_time").alias("seconds"),
        F.coalesce(F.avg(F.when(good & (F.col("confidence") != 0), F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"), F.sort_array(F.collect_list(F.when(~good, F.col("document_id")))).alias("failed"),
    )
    return out.withColumns({"cost_per_document": F.col("cost") / F.col("documents"), "entities_per_document": F.col("entities") / F.col("documents")})


def realtime(ledger: DataFrame, last: int = 10) -> tuple[DataFrame, DataFrame]:
    """Session totals and the last events."""
    return session_summary(ledger), ledger.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(last)


# --- costs and budgets ---------------------------------------------------------------------------


def estimate_cost(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds estimated_cost from tokens and the price of provider and model for a thousand of them, with margin."""
    priced = requests.join(F.broadcast(prices) if _small(prices) else prices, ["provider", "model"], "left")
    price = [F.coalesce(c, F.lit(p)) for c, p in zip(("input_price", "output_price"), FALLBACK_PRICE, strict=True)]
    tokens = [F.coalesce(c, F.lit(n)) for c, n in zip(("input_tokens", "output_tokens"), DEFAULT_TOKENS, strict=True)]
    cost = (tokens[0] / 1000 * price[0] + tokens[1] / 1000 * price[1]) * MARGIN
    return priced.withColumn("estimated_cost", cost).drop("input_price", "output_price")


def _small(dim: DataFrame, rows: int = 100_000) -> bool:
    return dim.limit(rows + 1).count() <= rows


def budget_state(spent: DataFrame, limits: DataFrame, warn: float = 0.8, stop: float = 1.2) -> DataFrame:
    """Remaining budget of each provider, and its state.

    healthy below warn of the limit, warning up to it, exceeded above, emergency from stop times the
    limit; without a limit, unlimited.
    """
    out = spent.join(limits, "provider", "left")
    used = ratio(F.col("cost"), F.col("limit"))
    state = F.when(F.col("limit").isNull(), "unlimited").when(F.col("cost") >= stop * F.col("limit"), "emergency").when(F.col("cost") > F.col("limit"), "exceeded").when(used >= warn, "warning").otherwise("healthy")
    return out.withColumns({"remaining": F.greatest(F.col("limit") - F.col("cost"), F.lit(0.0)), "used_share": used, "state": state, "can_afford": F.coalesce(F.col("cost") < F.col("limit"), F.lit(True))})


def within_budget(rows: DataFrame, by: Sequence[str], order: Sequence[str], cost: str, budget: Column) -> DataFrame:
    """Rows that are worked on before the running cost has crossed the budget; the row that crosses it is."""
    rule, _ = sums("spent")
    out = scanned(rows, by, order, {"spent": F.coalesce(F.col(cost).cast("double"), F.lit(0.0))}, rule, {"spent": F.lit(0.0)})
    return out.withColumn("spent_before", F.col("_before.spent")).filter(F.col("spent_before") <= budget).drop("_before", "_upto")


def ema(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float = 0.1) -> DataFrame:
    """Exponential moving average from 0 over each group's rows in order; of a group the value after its last row."""
    lift = {"keeps": F.lit(1 - alpha), "value": alpha * F.coalesce(F.col(value).cast("double"), F.lit(0.0)), "n": F.lit(1).cast("long")}
    out = scanned(rows, by, order, lift, decays, {"keeps": F.lit(1.0), "value": F.lit(0.0), "n": F.lit(0).cast("long")})
    return out.groupBy(*by).agg(F.max_by("_upto.value", "_upto.n").alias("ema"), F.count("*").alias("n"))
