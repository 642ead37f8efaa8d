"""Mixing sources to target weights: raked token weights, then calibrated sampling."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import checkpointed, free_name

MARGINS = ("source", "lang", "topic")
#: What a cell table may hold and still be broadcast; a larger one is joined by shuffle.
BROADCAST_CELLS = 100_000

#: How far a margin may be off its target share in silence.
WIDE_GAP = 1e-3

#: Marks of a text's form, the first that is found counts; a text with none is prose.
TOPIC_MARKS = (("licence", "icensed under"), ("table", " | "), ("link", "http"), ("contact", "@"))


def form_topic(text: Column) -> Column:
    """A topic for tables that carry none: the form of the text."""
    topic = F.lit("prose")
    for name, mark in reversed(TOPIC_MARKS):
        topic = F.when(F.contains(text, F.lit(mark)), name).otherwise(topic)
    return topic


def token_count(text: Column) -> Column:
    """Spaces and line ends, and one: the words of a text that parts them by one of these; 0 for an empty or null text."""
    gaps = 2 * F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) > 0, gaps + 1).otherwise(0).cast("long")


def draw(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone; a null key draws as the empty one."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def tempered(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """Target shares in proportion to each value's tokens to the given power: below 1, small values gain."""
    shares = cells.groupBy(margin).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("w"))
    return shares.select(margin, (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = 40, tolerance: float = 1e-9, check_every: int = 5) -> DataFrame:
    """Iterative proportional fitting of cell weights to the target shares of each margin.

    cells: a row for each combination of margin values, with its tokens. targets: for each margin, a
    row for each value with its share. A step scales the cells of each value so that they sum to its
    share. Ends when the last margin's step moves no margin by more than tolerance, or after rounds; if
    a margin is then still off by more than WIDE_GAP, as with targets that no weights of these cells
    can meet, it warns of the gap.
    Cells without tokens keep weight 0; a value that targets doesn't list has share 0.
    """
    names, gap = list(targets), 0.0
    out = cells
    for m in names:
        out = out.join(targets[m].select(m, F.col("target").alias(f"target_{m}")), m, "left").fillna(0.0, [f"target_{m}"])
    out = checkpointed(out.withColumn("weight", F.col("tokens") / F.sum("tokens").over(Window.partitionBy())))
    for done in range(0, rounds, check_every):
        for _ in range(min(check_every, rounds - done)):
            for m in names:
                total = F.sum("weight").over(Window.partitionBy(m))
                out = out.withColumn("weight", F.when(total > 0, F.col("weight") * F.col(f"target_{m}") / total).otherwise(0.0))
        out = checkpointed(out)
        gaps = [out.groupBy(F.lit(m).alias("margin"), m).agg(F.abs(F.sum("weight") - F.max(f"target_{m}")).alias("gap")).agg(F.max("gap")).first()[0] for m in names[:-1]]
        gap = max(g or 0.0 for g in gaps or [0.0])
        if gap <= tolerance:
            break
    if gap > WIDE_GAP:
        warnings.warn(f"raking ended with a margin off its target by {gap:.4f}", stacklevel=2)
    return out.select(*names, "tokens", "weight")


def once_rate(keep: float) -> Column:
    """Rates of cells, none above 1, in proportion to gain but for the cells that stay whole.

    The scale is the one at which the share keep of all tokens stays, so that a rare cell with a large
    gain is kept whole in place of thinning all others; it is larger if more can stay in the target mix.
    The kept tokens as a function of the scale are the least of a line for each number of whole
    cells: ahead (tokens of cells with more gain) and scale * behind (tokens times gain of the rest).
    """
    line = F.when(F.col("behind") > 0, (keep * F.col("all_tokens") - F.col("ahead")) / F.col("behind"))
    every = Window.partitionBy()
    return F.least(F.lit(1.0), F.col("gain") * F.greatest(F.max(line).over(every), 1 / F.greatest(F.max("gain").over(every), F.lit(1e-300))))


def mix_sources(
    docs: DataFrame,
    powers: Mapping[str, float] | None = None,
    targets: Mapping[str, DataFrame] | None = None,
    budget: float | None = 1.0,
    rounds: int = 40,
    text: str = "text",
    key: str = "doc_id",
    keep: float = 0.9,
    prefix: str = "mix_",
) -> DataFrame:
    """Adds topic (unless there), mix_tokens, mix_weight, mix_rate and mix_copies to the rows.

    Token weights of (source, lang, topic) cells are raked to the margins' targets: those given, or
    else shares tempered by powers. mix_weight is the raked share of the row's cell; mix_rate, the
    expected number of copies, is budget * raked share / natural share, so that the expected tokens
    are budget times those of the input, in the target mix; without a budget, no row is wanted more
    than once, see once_rate(), and at least the share keep of all tokens is expected to stay. mix_copies is mix_rate rounded down or
    up by the row's draw, which depends on key and nothing else.

    Nulls of a margin are a value of their own, "". Empty and null texts have no tokens; they take
    the rate of their cell, 0 if the cell has no tokens at all. Rows that repeat draw alike. An empty
    table gives no rows. All columns of docs stay, but earlier ones with the names of the four that are
    added (prefix and tokens, weight, rate, copies) are replaced.
    """
    powers = {m: 0.7 for m in MARGINS} | dict(powers or {})
    body = F.col(text)
    topic = F.col("topic") if "topic" in docs.columns else form_topic(body)
    tokens, weight, rate, copies = (f"{prefix}{x}" for x in ("tokens", "weight", "rate", "copies"))
    docs = docs.drop(tokens, weight, rate, copies)
    cell = {m: free_name(docs, f"cell_{m}") for m in MARGINS}
    values = (("source", F.col("source")), ("lang", F.col("lang")), ("topic", topic))
    rows = docs.select("*", *(F.coalesce(c.cast("string"), F.lit("")).alias(cell[m]) for m, c in values), token_count(body).alias(tokens))
    cells = rows.groupBy(*(F.col(cell[m]).alias(m) for m in MARGINS)).agg(F.sum(tokens).alias("tokens"))
    cells = checkpointed(cells)
    goals = {m: (targets or {}).get(m) for m in MARGINS}
    raked = rake(cells, {m: tempered(cells, m, powers[m]) if goals[m] is None else goals[m] for m in MARGINS}, rounds)
    gain = F.when(F.col("tokens") > 0, F.col("weight") * F.sum("tokens").over(Window.partitionBy()) / F.col("tokens")).otherwise(0.0)
    raked = raked.withColumn("gain", gain)
    if budget is None:
        by_gain = Window.orderBy(F.desc("gain"), *MARGINS)  # a row for each cell
        raked = raked.withColumns({
            "all_tokens": F.sum("tokens").over(Window.partitionBy()),
            "ahead": F.coalesce(F.sum("tokens").over(by_gain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "behind": F.sum(F.col("tokens") * F.col("gain")).over(by_gain.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        })
    raked = raked.withColumn("rate", once_rate(keep) if budget is None else budget * F.col("gain"))
    raked = checkpointed(raked.select(*(F.col(m).alias(cell[m]) for m in MARGINS), F.col("weight").alias(weight), F.col("rate").alias(rate)))
    small = raked.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    out = rows.join(F.broadcast(raked) if small else raked, list(cell.values()))
    whole = F.floor(rate)
    out = out.withColumn(copies, (whole + F.when(draw(F.col(key)) < F.col(rate) - whole, 1).otherwise(0)).cast("int"))
    own = docs.columns if "topic" in docs.columns else [*docs.columns, F.col(cell["topic"]).alias("topic")]
    return out.select(*own, tokens, weight, rate, copies)
