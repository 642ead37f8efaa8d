"""Spans against ground truth: scores, one-to-one matches, precision and recall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import range_iou, ratio, words_jaccard, words_of

#: Other names of a type.
ALIASES = {
    "person_name": ("name", "person", "individual"),
    "email_address": ("email", "mail", "e-mail"),
    "phone_number": ("phone", "telephone", "tel"),
    "organization": ("org", "company", "institution"),
    "location": ("place", "address", "geo"),
    "date_of_birth": ("dob", "birth_date", "birthdate"),
}
#: A pair counts only above this score.
LEAST = 0.5


def canonical(kind: Column) -> Column:
    """The type that an alias stands for: types match exactly if these are equal. address stands for location."""
    known = F.create_map(*(F.lit(x) for k, names in ALIASES.items() for n in names for x in (n, k)))
    return F.coalesce(F.try_element_at(known, kind), kind)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _side(spans: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The spans of a document and type as one sorted array, each with its words."""
    span = F.struct("start_pos", "end_pos", "text", words_of(F.col("text")).alias("words"))
    return spans.groupBy(*keys, canonical(F.col("pii_type")).alias("kind")).agg(F.array_sort(F.collect_list(span)).alias(name))


def pair_score(p: Column, t: Column) -> Column:
    """0.3 for the type, 0.4 of the ranges' overlap and 0.3 of the words' similarity."""
    return 0.3 + 0.4 * range_iou(p["start_pos"], p["end_pos"], t["start_pos"], t["end_pos"]) + 0.3 * words_jaccard(p["text"], p["words"], t["text"], t["words"])


def _matched(p_side: Column, t_side: Column) -> Column:
    """Predictions by position take the best free truth that scores above LEAST; ties go to the first."""
    some = F.struct(F.lit(0).alias("p"), F.lit(0).alias("t"), F.lit(0.0).alias("score"))
    start = F.filter(F.array(some), lambda x: F.lit(False))

    def step(acc: Column, p: Column, i: Column) -> Column:
        scores = F.transform(t_side, lambda t, k: F.struct((-pair_score(p, t)).alias("least"), k.alias("t")))
        free = F.filter(scores, lambda s: (s["least"] < -LEAST) & ~F.exists(acc, lambda m: m["t"] == s["t"]))
        pair = lambda s: F.struct(i.alias("p"), s["t"].alias("t"), (-s["least"]).alias("score"))
        # one best truth or none, as an array, so that it is computed once
        return F.concat(acc, F.transform(F.array_compact(F.array(F.array_min(free))), pair))

    indexed = F.transform(p_side, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return F.aggregate(indexed, start, lambda acc, x: step(acc, x["p"], x["i"]))


def _sides(predicted: DataFrame, truth: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    return _side(predicted, keys, "p_side").join(_side(truth, keys, "t_side"), [*keys, "kind"], how)


def _sides_in_row(rows: DataFrame, predicted: str, truth: str, keys: Sequence[str]) -> DataFrame:
    """What _sides() gives, from rows that each hold both arrays of spans of one document: nothing is exchanged."""

    def side(c: str) -> Column:
        return F.array_sort(F.transform(c, lambda x: F.struct(x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), x["text"].alias("text"), words_of(x["text"]).alias("words"), canonical(x["pii_type"]).alias("kind"))))

    def of_kind(c: str) -> Column:
        plain = F.transform(F.filter(c, lambda x: x["kind"].eqNullSafe(F.col("kind"))), lambda x: x.dropFields("kind"))
        return F.nullif(plain, F.filter(plain, lambda _: F.lit(False)))

    both = rows.select(*keys, side(predicted).alias("p_all"), side(truth).alias("t_all"))
    kinds = F.array_distinct(F.concat(*(F.coalesce(F.transform(c, lambda x: x["kind"]), F.array().cast("array<string>")) for c in ("p_all", "t_all"))))
    return both.select(*keys, "p_all", "t_all", F.explode(kinds).alias("kind")).select(*keys, "kind", of_kind("p_all").alias("p_side"), of_kind("t_all").alias("t_side"))


def matched_groups(predicted: DataFrame, truth: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """A row for each document and type of either side: the arrays p_side and t_side, and matched, pairs of places in them.

    Each side is grouped once on the columns that the join needs, so that no pair becomes a row. Equal spans of a side stay apart.
    """
    return _with_matched(_sides(predicted, truth, _keys(key), "full"))


def _with_matched(sides: DataFrame) -> DataFrame:
    return sides.withColumn("matched", F.when(F.col("p_side").isNotNull() & F.col("t_side").isNotNull(), _matched(F.col("p_side"), F.col("t_side"))))


def match(predicted: DataFrame, truth: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """One-to-one matches: predictions by position take the best free truth; ties go to the first."""
    keys = _keys(key)
    return _pairs(_sides(predicted, truth, keys, "inner"), keys)


def match_in_row(rows: DataFrame, predicted: str = "spans", truth: str = "truth", key: str | Sequence[str] = "doc_id") -> DataFrame:
    """match() of rows that hold both sides: a row is a document, its columns predicted and truth arrays of spans. Null arrays are empty."""
    keys = _keys(key)
    return _pairs(_sides_in_row(rows, predicted, truth, keys).filter("p_side IS NOT NULL AND t_side IS NOT NULL"), keys)


def _pairs(sides: DataFrame, keys: Sequence[str]) -> DataFrame:
    p, t = F.get(F.col("p_side"), F.col("m.p")), F.get(F.col("t_side"), F.col("m.t"))
    pairs = sides.select(*keys, "kind", "p_side", "t_side", F.explode(_matched(F.col("p_side"), F.col("t_side"))).alias("m"))
    return pairs.select(*keys, "kind", p["start_pos"].alias("p_start"), p["end_pos"].alias("p_end"), p["text"].alias("p_text"), t["start_pos"].alias("t_start"), t["end_pos"].alias("t_end"), t["text"].alias("t_text"), "m.score")


def counts(predicted: DataFrame, truth: DataFrame, by: Sequence[str] = (), key: str | Sequence[str] = "doc_id") -> DataFrame:
    """True and false positives and false negatives of each type (aliases as one)."""
    return _counted(matched_groups(predicted, truth, _keys(key)), by)


def counts_in_row(rows: DataFrame, predicted: str = "spans", truth: str = "truth", by: Sequence[str] = ()) -> DataFrame:
    """counts() of rows that hold both sides, as match_in_row(); only the sums of each type are exchanged."""
    return _counted(_with_matched(_sides_in_row(rows, predicted, truth, by)), by)


def _counted(matched: DataFrame, by: Sequence[str]) -> DataFrame:
    n = lambda c: F.coalesce(F.array_size(c), F.lit(0)).cast("long")
    groups = matched.select(*by, "kind", n("matched").alias("tp"), n("p_side").alias("predicted"), n("t_side").alias("truth"))
    return groups.groupBy(*by, "kind").agg(F.sum("tp").alias("tp"), F.sum(F.col("predicted") - F.col("tp")).alias("fp"), F.sum(F.col("truth") - F.col("tp")).alias("fn"))


def rates(counted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy of counts; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = counted.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp, tp + fp + fn)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall(counted: DataFrame) -> DataFrame:
    """Micro-averaged rates."""
    return rates(counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))))
