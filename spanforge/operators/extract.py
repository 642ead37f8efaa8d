"""Span generators: one row of text to any number of spans, without a shuffle.

Every generator takes a table of documents and returns a row for each span: the document's key,
text, pii_type, confidence, start_pos, end_pos (half open, in characters), context and extractor.
All rules are applied in one projection over one scan; duplicates are dropped inside the row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import groupby
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text as X


class Extractor(Protocol):
    """Documents in, spans out."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


def effective_text(raw: Column, ocr: Column | None = None) -> Column:
    """The raw text; OCR text is added on a new line if the raw one is empty or shorter than 50 characters."""
    raw = F.nullif(raw, F.lit(""))
    if ocr is None:
        return F.coalesce(raw, F.lit(""))
    ocr = F.nullif(ocr, F.lit(""))
    return F.when(F.coalesce(F.length(raw), F.lit(0)) < 50, F.concat_ws("\n", raw, ocr)).otherwise(raw)


def _need(kind: str) -> str:
    """SQL for what a text must hold before the rules of a type search it; cheap tests come first."""
    need = fixed.RULE_NEEDS.get(kind, r"\d")
    if need == "@":
        return "contains(_text, '@')"
    first = fixed.RULE_NEEDS_FIRST.get(kind, "_digit")
    return f"({first}) AND _text rlike {X.sql_text(need)}"


def _by_rules(rules: Sequence[tuple[str, bool, str]]) -> str:
    """SQL for the matches of all rules; rules of a type that follow one another are tried behind one test."""
    runs = []
    for kind, own in groupby(rules, key=lambda r: r[0]):
        every = ", ".join(X.find_all("_text", X.pattern_of(p, i), k) for k, i, p in own)
        runs.append(X.guarded(_need(kind), f"concat({every})"))
    return f"array_distinct(concat({', '.join(runs) or X.NOTHING_FOUND}))"


def _leading(pattern: str) -> str:
    """The plain letters a pattern starts with."""
    return re.match(r"[a-z]*", pattern)[0]


def _surrounded(body: Column, m: Column) -> list[Column]:
    """The span's fields, its text without outer space, and its surroundings."""
    bare = F.trim(m["text"])
    near = F.lower(X.around(body, m["start_pos"], m["start_pos"] + F.length(bare), 100))
    return [m["pii_type"].alias("pii_type"), bare.alias("text"), m["start_pos"].alias("start_pos"), m["end_pos"].alias("end_pos"), near.alias("near"), X.context(body, m["start_pos"], m["end_pos"]).alias("context")]


def rule_confidence(kind: Column, text: Column, near: Column) -> Column:
    """Score by type, 0.1 more near a keyword of the type; 0.2 for placeholder names."""
    base = X.by_value(kind, fixed.RULE_SCORES, F.lit(fixed.DEFAULT_RULE_SCORE))
    helped = F.lit(False)
    for k, words in fixed.RULE_KEYWORDS.items():
        helped = helped | ((kind == k) & X.any_of(near, words))
    score = F.when(helped, F.least(base + 0.1, F.lit(1.0))).otherwise(base)
    return F.when((kind == "person_name") & text.isin(*fixed.PLACEHOLDER_NAMES), 0.2).otherwise(score)


def rule_valid(kind: Column, text: Column) -> Column:
    """What a span of some types must look like."""
    n = F.length(X.digits(text))
    card = n.isin(13, 14, 15, 16, 19) & F.call_function("luhn_check", X.digits(text))
    return (
        F.when(kind == "email_address", F.contains(F.substring_index(text, "@", -1), F.lit(".")) & F.contains(text, F.lit("@")))
        .when(kind == "phone_number", n.between(10, 15))
        .when(kind == "credit_card_number", card)
        .when(kind == "social_security_number", n.between(9, 10))
        .otherwise(True)
    )


def sane(text: Column, confidence: Column, kind: Column) -> Column:
    """Not blank, a confidence from 0 to 1, a known type."""
    return (F.trim(text) != "") & confidence.between(0, 1) & kind.isin(*fixed.SPAN_TYPES)


def _readied(docs: DataFrame, text: str) -> DataFrame:
    """docs with the text as it is searched, and whether it holds a digit."""
    return docs.withColumn("_text", X.searchable(F.col(text))).withColumn("_digit", F.expr("_text rlike '[0-9]'"))


def _rule_spans(rules: Sequence[tuple[str, bool, str]], emit_postal: bool) -> Column:
    """The spans of all rules in a readied row."""
    chosen = [r for r in rules if emit_postal or r[0] in fixed.SPAN_TYPES]
    body = F.col("_text")
    found = F.transform(F.expr(_by_rules(chosen)), lambda m: F.struct(*_surrounded(body, m)))
    good = F.filter(found, lambda m: (F.length(m["text"]) >= 2) & rule_valid(m["pii_type"], m["text"]))
    return F.transform(good, lambda m: F.struct(m["text"].alias("text"), m["pii_type"].alias("pii_type"), rule_confidence(m["pii_type"], m["text"], m["near"]).alias("confidence"), m["start_pos"].alias("start_pos"), m["end_pos"].alias("end_pos"), m["context"].alias("context"), F.lit("rule_based").alias("extractor")))


def with_rule_spans(docs: DataFrame, text: str = "text", spans: str = "spans", rules: Sequence[tuple[str, bool, str]] = fixed.RULES, emit_postal: bool = False) -> DataFrame:
    """Adds an array of the spans of all rules to each row, for what works on a text and its spans together."""
    return _readied(docs, text).withColumn(spans, _rule_spans(rules, emit_postal)).drop("_text", "_digit")


def rule_spans(docs: DataFrame, text: str = "text", key: Sequence[str] = ("doc_id",), rules: Sequence[tuple[str, bool, str]] = fixed.RULES, emit_postal: bool = False) -> DataFrame:
    """Spans of all rules, a row for each. Postal and zip codes are known to the rules but are no span type unless emit_postal."""
    # inline() of the expression: of a column, Spark would add a filter on its size and search twice
    return _readied(docs.select(*key, F.col(text).alias("_body")), "_body").select(*key, F.inline(_rule_spans(rules, emit_postal)))


def dictionary_confidence(base: Column, text: Column, near: Column, keywords: tuple[str, ...]) -> Column:
    """0.1 more near a keyword; a fifth less for text of digits, of ASCII letters or of symbols alone."""
    score = F.when(X.any_of(near, keywords), F.least(base + 0.1, F.lit(1.0))).otherwise(base)
    return F.when(F.rlike(text, F.lit(r"^[0-9]+$|^[a-zA-Z]+$|(?U)^[^\w\s]+$")), score * 0.8).otherwise(score)


def dictionary_valid(kind: Column, text: Column) -> Column:
    """Two characters or more, three tenths of them no signs; digits for record numbers and accounts."""
    plain = F.length(F.regexp_replace(text, r"(?U)[^\w\s]", ""))
    return (F.length(text) >= 2) & (plain >= F.length(text) * 0.3) & F.when(kind == "medical_record_number", F.rlike(text, F.lit(r"\d"))).when(kind == "financial_account", F.rlike(text, F.lit(r"\d{4,}"))).otherwise(True)


def dictionary_spans(docs: DataFrame, text: str = "text", key: Sequence[str] = ("doc_id",), dictionaries: Sequence[tuple] = fixed.DICTIONARIES, types: Sequence[str] | None = fixed.SPAN_TYPES) -> DataFrame:
    """Spans of dictionary terms and patterns; types (None: all) are those that may pass. A pattern is tried on texts that hold its first letters."""
    chosen = [d for d in dictionaries if types is None or d[1] in types]
    rows = docs.select(*key, X.searchable(F.col(text)).alias("_text"))
    rows = rows.select("*", F.lower("_text").alias("_low"))
    body = F.col("_text")
    every = []
    for _, kind, _, terms, patterns, _ in chosen:
        for start, p in [*((t.lower(), X.term_pattern(t)) for t in terms), *((_leading(p), f"(?iUu){p}") for p in patterns)]:
            every.append(X.guarded(f"contains(_low, {X.sql_text(start)})", X.find_all("_text", p, kind)))
    found = F.expr(f"array_distinct(concat({', '.join(every)}))")
    out = rows.select(*key, F.inline(F.transform(found, lambda m: F.struct(*_surrounded(body, m))))).filter(F.length("text") >= 2)
    kind, score, name = F.col("pii_type"), None, None
    for title, k, base, _, _, keywords in chosen:
        own = dictionary_confidence(F.lit(base), F.col("text"), F.col("near"), keywords)
        score, name = (F.when(kind == k, x) if y is None else y.when(kind == k, x) for y, x in ((score, own), (name, F.lit(title))))
    out = out.withColumns({"confidence": score, "dictionary": name}).filter(dictionary_valid(kind, F.col("text")))
    return out.select(*key, "text", "pii_type", "confidence", "start_pos", "end_pos", "context", F.lit("dictionary").alias("extractor"), "dictionary")


def model_spans(docs: DataFrame, model: Callable[[list[str]], list[list[tuple[str, str, float, int, int]]]], name: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Spans of a model given as a function from texts to (text, type, confidence, start, end) tuples, batch by batch."""
    import pyarrow as pa

    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows = [(k, *s) for k, spans in zip(batch.column("key").to_pylist(), model(texts), strict=True) for s in spans]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (batch.column("key").type, pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "text", "pii_type", "confidence", "start_pos", "end_pos"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"{key} {kind}, text string, pii_type string, confidence double, start_pos int, end_pos int")
    return out.withColumns({"context": F.lit(""), "extractor": F.lit(name)})
