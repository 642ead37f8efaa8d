"""Votes of several extractors over the same documents."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import mean_of_millionths, mean_reaches, millionths
from ..functions.text import words_jaccard, words_of


def _alike(seed: Column, span: Column, similarity: float) -> Column:
    """Similar words, and, where both have places, half of their mean length in common."""
    words = words_jaccard(seed["text"], seed["words"], span["text"], span["words"]) >= similarity
    both = F.least(seed["end_pos"], span["end_pos"]) - F.greatest(seed["start_pos"], span["start_pos"])
    mean = (seed["end_pos"] - seed["start_pos"] + span["end_pos"] - span["start_pos"]) / 2
    placed = F.least(seed["start_pos"], seed["end_pos"], span["start_pos"], span["end_pos"]) > 0
    near = F.when(placed, (both > 0) & (both > mean * 0.5)).otherwise(True)
    return F.coalesce(words & near, F.lit(False))


def group_similar(spans: DataFrame, similarity: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Adds grp: each span joins the first group whose first member it is like, in the order of extractors and places.

    The order decides, so a document's spans of one type are one sorted array that is folded once; no
    similarity crosses a type.
    """
    order = ["extractor_rank", "start_pos", "end_pos", "text"]
    rest = ["confidence", "extractor"]
    packed = spans.groupBy(key, "pii_type").agg(F.array_sort(F.collect_list(F.struct(*order, *rest, words_of(F.col("text")).alias("words")))).alias("s"))
    start = F.struct(F.filter("s", lambda x: F.lit(False)).alias("seeds"), F.array().cast("array<int>").alias("grp"))

    def step(acc: Column, span: Column) -> Column:
        like = F.transform(acc["seeds"], lambda seed: _alike(seed, span, similarity))
        at = (F.coalesce(F.array_position(like, F.lit(True)), F.lit(0)) - 1).cast("int")
        # the group's number, as an array, so that it is computed once
        join = lambda k: F.when(k >= 0, F.struct(acc["seeds"].alias("seeds"), F.concat(acc["grp"], F.array(k)).alias("grp"))).otherwise(F.struct(F.concat(acc["seeds"], F.array(span)).alias("seeds"), F.concat(acc["grp"], F.array(F.size(acc["seeds"]))).alias("grp")))
        return F.get(F.transform(F.array(at), join), F.lit(0))

    numbers = F.aggregate("s", start, step, lambda acc: acc["grp"])
    out = packed.select(key, "pii_type", F.explode(F.zip_with("s", numbers, lambda s, g: F.struct(s.alias("s"), g.alias("grp")))).alias("m"))
    return out.select(key, "pii_type", "m.s.text", "m.s.confidence", "m.s.start_pos", "m.s.end_pos", "m.s.extractor", "m.s.extractor_rank", "m.grp")


def vote(grouped: DataFrame, method: str, weights: Mapping[str, float] | None = None, by_confidence: bool = True, least: float = 0.7, consensus: float = 0.8, key: str = "doc_id") -> DataFrame:
    """One span for each group that wins: the likeliest member.

    majority: two members; weighted: mean confidence weighted by extractor (and confidence) of at
    least `least`, which becomes the span's; union: all; consensus: members for each extractor seen
    in the document at least `consensus`.
    """
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("extractor") == name, w).otherwise(weight)
    if by_confidence:
        weight = weight * F.col("confidence")
    best = F.max_by(F.struct("text", "confidence", "start_pos", "end_pos", "extractor"), F.struct("confidence", -F.col("extractor_rank"), -F.col("start_pos"), -F.col("end_pos")))
    out = grouped.groupBy(key, "pii_type", "grp").agg(best.alias("b"), F.count("*").alias("votes"), (F.sum(weight * F.col("confidence")) / F.nullif(F.sum(weight), F.lit(0.0))).alias("mean"))
    if method == "consensus":
        seen = grouped.groupBy(key).agg(F.countDistinct("extractor").alias("extractors"))
        out = out.join(seen, key)
    wins = {"majority": F.col("votes") >= 2, "weighted": F.col("mean") >= least, "union": F.lit(True), "consensus": F.col("votes") / F.col("extractors") >= consensus if method == "consensus" else None}[method]
    confidence = F.col("mean") if method == "weighted" else F.col("b.confidence")
    return out.filter(wins).select(key, "pii_type", "b.text", confidence.alias("confidence"), "b.start_pos", "b.end_pos", "b.extractor", "votes", F.lit(method).alias("method"))


def exact_groups(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Groups of the same lower-cased text and type."""
    return spans.withColumn("grp", F.lower("text"))


def exact_vote(spans: DataFrame, method: str, least: float = 0.7, extractors: int = 2, key: str = "doc_id") -> DataFrame:
    """Votes over exact groups: weighted (a single span passes, more need their mean to), union, or majority of the extractors.

    Confidences count in millionths, so that a mean of just `least` passes in whatever order its members come.
    """
    best = F.max_by(F.struct("text", "confidence", "start_pos", "end_pos"), F.struct("confidence", -F.col("extractor_rank"), -F.col("start_pos"), -F.col("end_pos")))
    out = exact_groups(spans, key).groupBy(key, "grp", "pii_type").agg(best.alias("b"), F.count("*").alias("votes"), F.sum(millionths(F.col("confidence"))).alias("total"), F.count("confidence").alias("n"))
    wins = {"weighted": (F.col("votes") == 1) | mean_reaches(F.col("total"), F.col("n"), least), "union": F.lit(True), "majority": F.col("votes") > extractors / 2}[method]
    confidence = mean_of_millionths(F.col("total"), F.col("n")) if method == "weighted" else F.col("b.confidence")
    return out.filter(wins).select(key, "pii_type", "b.text", confidence.alias("confidence"), "b.start_pos", "b.end_pos", "votes")
