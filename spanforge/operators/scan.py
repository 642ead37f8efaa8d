"""Running values and exact percentiles of groups of any size, none of which one task has to hold.

scanned() is a prefix scan: rows are dealt by range and keep that place, blocks of BLOCK of them are folded, and the totals of blocks are
scanned in the same way until a block holds all that is left of a group. percentiles() narrows brackets by counts: each round deals
the values of a bracket to bins, and the bin that holds the wanted rank is the next bracket. trailed() is for what reaches back a fixed number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.sinks import checkpointed

#: Rows, or totals, that are folded in one place.
BLOCK = 256
#: Rows of a stretch of trailed().
STRETCH = 1 << 16
#: Bins of a bracket, and brackets up to which they are broadcast.
BINS, BROADCAST_BRACKETS = 512, 100_000

State = Mapping[str, Column]


def placed(rows: DataFrame, order: Sequence[Column | str], name: str = "_place") -> DataFrame:
    """Adds each row's place, from 0, in the given order over all rows.

    Rows are dealt by range and sorted there; the checkpoint fixes both, so that a row's number in its partition needs no
    further exchange. One table row for each partition tells what came before it. Rows that tie keep an order of their own.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).select("_part", before.alias("_before"))
    numbered = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_id")


def _struct(state: State) -> Column:
    return F.struct(*(c.alias(k) for k, c in state.items()))


def _fields(state: Column, names: Sequence[str]) -> State:
    return {k: state[k] for k in names}


def _blocks(rows: DataFrame, by: Sequence[str], combine: Callable[[State, State], State], zero: State, block: int) -> DataFrame:
    """From (by, _place, _state, _row): by, _place, _row, and the states before and up to each row of its group."""
    names = list(zero)
    items = F.array_sort(F.collect_list(F.struct("_place", "_state", "_row")))
    grouped = rows.groupBy(*by, F.floor(F.col("_place") / block).alias("_block")).agg(items.alias("_items"))
    kind = rows.schema["_state"].dataType.simpleString()
    whole = F.struct(F.lit(0).cast("long").alias("_place"), _struct(zero).cast(kind).alias("_before"), _struct(zero).cast(kind).alias("_upto"))
    start = F.struct(_struct(zero).cast(kind).alias("state"), F.slice(F.array(whole), 1, 0).alias("out"))

    def fold(acc: Column, item: Column) -> Column:
        after = _struct(combine(_fields(acc["state"], names), _fields(item["_state"], names))).cast(kind)
        one = F.struct(item["_place"].cast("long").alias("_place"), acc["state"].alias("_before"), after.alias("_upto"))
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(one)).alias("out"))

    folded = grouped.select(*by, "_block", "_items", F.aggregate("_items", start, fold).alias("_acc"))
    totals = folded.select(*by, F.col("_block").alias("_place"), F.col("_acc.state").alias("_state"), F.struct(F.col("_block").alias("b")).alias("_row"))
    most = totals.groupBy(*by).count().agg(F.max("count")).first()[0] if by else totals.count()
    out = folded.select(*by, "_block", F.explode(F.arrays_zip(F.col("_items").alias("i"), F.col("_acc.out").alias("o"))).alias("x"))
    out = out.select(*by, "_block", F.col("x.i._place").alias("_place"), F.col("x.i._row").alias("_row"), F.col("x.o._before").alias("_before"), F.col("x.o._upto").alias("_upto"))
    if (most or 0) <= 1:
        return out.drop("_block")
    carried = _blocks(checkpointed(totals), by, combine, zero, block).select(*(F.col(c).alias(f"_c_{c}") for c in by), F.col("_place").alias("_block"), F.col("_before").alias("_carry"))
    same = F.lit(True)
    for c in by:
        same = same & out[c].eqNullSafe(carried[f"_c_{c}"])
    out = out.join(carried, same & (out["_block"] == carried["_block"])).drop(carried["_block"])
    onto = lambda c: _struct(combine(_fields(F.col("_carry"), names), _fields(F.col(c), names))).cast(kind).alias(c)
    return out.select(*by, "_place", "_row", onto("_before"), onto("_upto"))


def scanned(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], lift: State, combine: Callable[[State, State], State], zero: State, block: int = BLOCK) -> DataFrame:
    """Adds _before and _upto: the combined states of the rows of the same group before each row, and up to it.

    lift is a row's state, combine an associative rule for two states of which the first comes first, zero its neutral state. Null keys
    are a group. Rows that tie in order come one after another, in an order that stays.
    """
    kind = F.struct(*(c.alias(k) for k, c in lift.items()))
    laid = placed(rows.withColumn("_state", kind), [*by, *order])
    packed = laid.select(*by, "_place", "_state", F.struct(*rows.columns).alias("_row"))
    return _blocks(packed, by, combine, zero, block).select("_row.*", "_before", "_upto")


def trailed(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], width: int, value: Callable[[WindowSpec], Column], name: str, stretch: int = STRETCH) -> DataFrame:
    """Adds value over each row and the width - 1 rows of its group before it.

    What reaches back a fixed number of rows needs no scan: places are cut into stretches, and a stretch also gets the last width - 1 rows of the one before.
    """
    stretch = max(stretch, width)
    laid = placed(rows, [*by, *order])
    own = F.floor(F.col("_place") / stretch)
    ends = F.col("_place") % stretch >= stretch - (width - 1)
    dealt = laid.withColumn("_stretch", F.explode(F.when(ends, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = Window.partitionBy(*by, "_stretch").orderBy("_place").rowsBetween(1 - width, 0)  # stretch + width - 1 rows at most
    return dealt.withColumn(name, value(frame)).filter(F.col("_stretch") == own).drop("_place", "_stretch")


def sums(*names: str) -> tuple[Callable[[State, State], State], State]:
    """Rule and zero of running sums."""
    return lambda a, b: {k: a[k] + b[k] for k in names}, {k: F.lit(0) for k in names}


def decays(a: State, b: State) -> State:
    """Rule of exponential averages: what a state keeps of those before, its own value, and how many rows it has."""
    return {"keeps": a["keeps"] * b["keeps"], "value": a["value"] * b["keeps"] + b["value"], "n": a["n"] + b["n"]}


def lasts(n: int) -> Callable[[State, State], State]:
    """Rule of the last n values."""
    return lambda a, b: {"last": F.slice(F.concat(a["last"], b["last"]), F.greatest(F.size(a["last"]) + F.size(b["last"]) - n, F.lit(0)) + 1, n)}


def percentiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], name: str = "q") -> DataFrame:
    """Exact percentiles of each group with linear interpolation between ranks, as an array in the order of shares, and the count n.

    Nulls don't count; a group without values has none. Each round a task adds up at most BINS counts for each rank wanted; rounds end when the
    bracket of each rank is one value, which takes as many as its range is powers of BINS wide.
    """
    plain = checkpointed(rows.select(*by, F.col(value).cast("double").alias("_v")).filter("_v is not null"))  # each round reads it again
    base = plain.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    at = [F.floor(F.lit(float(s)) * (F.col("n") - 1)) for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(k, F.least(k + 1, F.col("n") - 1)) for k in at))))
    groups = checkpointed(base.filter("n > 0"))
    wanted = groups.select(*by, F.explode(ranks).alias("_rank"), F.lit(0).cast("long").alias("_done"), "_low", "_high")
    open_, found = checkpointed(wanted), None
    same = lambda a, b, names: [a[c].eqNullSafe(b[f"_g_{c}"]) for c in names]
    while True:
        closed = open_.filter("_low = _high").select(*by, "_rank", F.col("_low").alias("_value"))
        found = closed if found is None else found.unionAll(closed)
        open_ = open_.filter("_low < _high")
        n = open_.count()
        if not n:
            break
        brackets = open_.select(*(F.col(c).alias(f"_g_{c}") for c in by), "_low", "_high").distinct()
        brackets = F.broadcast(brackets) if n <= BROADCAST_BRACKETS else brackets
        inside = plain["_v"].between(brackets["_low"], brackets["_high"])
        for cond in same(plain, brackets, by):
            inside = inside & cond
        bin_ = F.least(F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * BINS), F.lit(BINS - 1)).alias("_bin")
        counts = plain.join(brackets, inside).groupBy(*by, "_low", "_high", bin_).agg(F.count("*").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        before = F.sum("_n").over(Window.partitionBy(*by, "_low", "_high").orderBy("_bin")) - F.col("_n")  # BINS rows at most
        counts = counts.withColumn("_under", before).select(*(F.col(c).alias(f"_g_{c}") for c in by), F.col("_low").alias("_l"), F.col("_high").alias("_h"), "_under", "_n", "_least", "_most")
        left = F.col("_rank") - F.col("_done")
        hit = (open_["_low"] == counts["_l"]) & (open_["_high"] == counts["_h"]) & (left >= F.col("_under")) & (left < F.col("_under") + F.col("_n"))
        for cond in same(open_, counts, by):
            hit = hit & cond
        open_ = checkpointed(open_.join(counts, hit).select(*by, "_rank", (F.col("_done") + F.col("_under")).alias("_done"), F.col("_least").alias("_low"), F.col("_most").alias("_high")))
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_values"))
    # At most two ranks for each share.
    own = groups.select(*by, "n")
    cond = F.lit(True)
    other = values.select(*(F.col(c).alias(f"_g_{c}") for c in by), "_values")
    for c in same(own, other, by):
        cond = cond & c
    out = []
    for s, k in zip(shares, at, strict=True):
        place = F.lit(float(s)) * (F.col("n") - 1)
        low, high = F.col("_values")[k], F.col("_values")[F.least(k + 1, F.col("n") - 1)]
        out.append(F.when(low == high, low).otherwise((k + 1 - place) * low + (place - k) * high))
    return own.join(other, cond).select(*by, "n", F.array(*out).alias(name))
