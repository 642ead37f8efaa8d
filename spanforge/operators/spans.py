"""Spans after extraction: dedup, gates, role rules, statistics and corrections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import mean_of_millionths, mean_reaches, millionths
from ..functions.text import digits

#: Category of each type, identity if unknown; and what a role may see.
CATEGORIES = {
    "PERSON": "identity", "EMAIL": "contact", "PHONE": "contact", "ADDRESS": "contact", "ID_NUMBER": "identity", "SSN": "identity",
    "BANK_ACCOUNT": "financial", "CREDIT_CARD": "financial", "MEDICAL_RECORD": "medical", "EMPLOYEE_ID": "employment", "ORGANIZATION": "identity",
}
EVERY = ("identity", "contact", "financial", "medical", "legal", "employment")
#: Fixed values: (role, categories, least confidence, redaction).
ROLES = (
    ("hr_manager", ("identity", "contact", "employment"), 0.75, "partial"),
    ("finance_manager", ("identity", "contact", "financial", "employment"), 0.80, "partial"),
    ("legal_counsel", ("identity", "contact", "legal", "financial"), 0.85, "none"),
    ("compliance_officer", EVERY, 0.90, "none"),
    ("data_analyst", ("identity", "contact"), 0.70, "full"),
    ("general_user", ("contact",), 0.80, "partial"),
    ("admin", EVERY, 0.70, "none"),
)
#: The upper-case name of a type that text extractors give in lower case.
UPPER_TYPES = {
    "person_name": "PERSON", "email_address": "EMAIL", "phone_number": "PHONE", "address": "ADDRESS", "social_security_number": "SSN", "credit_card_number": "CREDIT_CARD",
    "iban": "BANK_ACCOUNT", "medical_record_number": "MEDICAL_RECORD", "employee_id": "EMPLOYEE_ID", "organization": "ORGANIZATION", "driver_license": "ID_NUMBER",
}


def upper_type(kind: Column) -> Column:
    """The canonical upper-case type."""
    known = F.create_map(*(F.lit(x) for kv in UPPER_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, kind), F.upper(kind))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """The spans of several extractors in one table; extractor_rank is the place of each."""
    ranked = [p.withColumn("extractor_rank", F.lit(k)) for k, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def first_of_each(spans: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The first span of each text and type of a document, in the order of extractors and positions; case matters."""
    w = Window.partitionBy(*key, "text", "pii_type").orderBy("extractor_rank", "start_pos", "end_pos")
    return spans.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def best_of_each(spans: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The likeliest span of each lower-cased text and type, at the place of the first."""
    order = ["extractor_rank", "start_pos", "end_pos"]
    best = F.max_by(F.struct("text", "confidence", "extractor"), F.struct("confidence", *(-F.col(c) for c in order)))
    first = F.min_by(F.struct("start_pos", "end_pos"), F.struct(*order))
    out = spans.groupBy(*key, F.lower(F.trim("text")).alias("low"), "pii_type").agg(best.alias("b"), first.alias("f"), F.count("*").alias("votes"))
    return out.select(*key, "pii_type", "b.text", "b.confidence", "b.extractor", "f.start_pos", "f.end_pos", "votes")


def dedup_counts(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of each document before and after."""
    both = before.select(key, F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after.select(key, F.lit(0), F.lit(1)))
    return both.groupBy(key).agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


def quality_gate(kind: Column, text: Column) -> Column:
    """Two characters or more; an e-mail has @ and a dot, a phone ten digits, a person two parts and four fifths of them letters."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    alpha = F.size(F.filter(parts, lambda p: F.rlike(p, F.lit(r"^\p{L}+$"))))
    rule = F.when(kind == "EMAIL", F.contains(text, F.lit("@")) & F.contains(text, F.lit("."))).when(kind == "PHONE", F.length(digits(text)) >= 10).when(kind == "PERSON", (F.size(parts) >= 2) & (alpha >= F.size(parts) * 0.8))
    return (F.length(F.trim(text)) >= 2) & rule.otherwise(True)


#: Confidence of a type that a model names without one, and of types that are not listed.
MODEL_CONFIDENCE = {"EMAIL": 0.95, "PHONE": 0.90, "PERSON": 0.85, "ADDRESS": 0.80, "ID_NUMBER": 0.90, "ORGANIZATION": 0.75, "DATE": 0.70}
OTHER_CONFIDENCE = 0.70
#: What is added, and at most reached, if the content looks like its type; what is taken away, and at least left, if not.
CONTENT_STEPS = {"EMAIL": (0.1, 0.98, 0.3, 0.3), "PHONE": (0.05, 0.95, 0.2, 0.4), "PERSON": (0.05, 0.90, 0.15, 0.5)}


def content_confidence(kind: Column, text: Column, base: Column | None = None) -> Column:
    """Confidence by what the text holds: an e-mail an @ and a dot, a phone ten digits, a person two words of letters alone.

    base is the type's own confidence unless given; other types keep it. A null text looks like nothing.
    """
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    fits = {"EMAIL": F.contains(text, F.lit("@")) & F.contains(text, F.lit(".")), "PHONE": F.length(digits(text)) >= 10, "PERSON": (F.size(words) >= 2) & F.rlike(F.replace(text, F.lit(" "), F.lit("")), F.lit(r"^\p{L}+$"))}
    own = F.create_map(*(F.lit(x) for kv in MODEL_CONFIDENCE.items() for x in kv))
    base = F.coalesce(F.try_element_at(own, kind), F.lit(OTHER_CONFIDENCE)) if base is None else base
    out = base
    for k, (more, most, less, least) in CONTENT_STEPS.items():
        good = F.coalesce(fits[k], F.lit(False))
        out = F.when(kind == k, F.when(good, F.least(F.lit(most), base + more)).otherwise(F.greatest(F.lit(least), base - less))).otherwise(out)
    return out


def for_role(spans: DataFrame, role: str, roles: Sequence[tuple] = ROLES) -> DataFrame:
    """Spans that a role may see, with redaction saying how; a role without rules sees all."""
    rule = next((r for r in roles if r[0] == role), None)
    if rule is None:
        return spans.withColumn("redaction", F.lit("none"))
    known = F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv))
    category = F.coalesce(F.try_element_at(known, upper_type(F.col("pii_type"))), F.lit("identity"))
    return spans.filter(category.isin(*rule[1]) & (F.col("confidence") >= rule[2])).withColumn("redaction", F.lit(rule[3]))


def role_text(kind: Column, text: Column, redaction: Column) -> Column:
    """A span's text as a role sees it."""
    name, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    stars = lambda n: F.repeat(F.lit("*"), n.cast("int"))
    email = F.when((F.length(text) - F.length(F.replace(text, F.lit("@"), F.lit(""))) == 1) & (F.length(name) > 2), F.concat(F.substring(name, 1, 1), stars(F.length(name) - 2), F.substring(name, -1, 1), F.lit("@"), domain)).otherwise(text)
    number = digits(text)
    phone = F.when(F.length(number) >= 10, F.replace(text, F.substring(number, 4, 4), F.lit("****"))).otherwise(text)
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    last = F.element_at(parts, -1)
    person = F.when(F.size(parts) >= 2, F.concat_ws(" ", F.slice(parts, 1, F.size(parts) - 1), F.concat(F.substring(last, 1, 1), stars(F.length(last) - 1)))).otherwise(text)
    partial = F.when(kind == "EMAIL", email).when(kind == "PHONE", phone).when(kind == "PERSON", person).otherwise(text)
    return F.when(redaction == "partial", partial).when(redaction == "full", F.concat(F.lit("[REDACTED_"), kind, F.lit("]"))).otherwise(text)


def statistics(spans: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Spans, types and confidence of each document."""
    return spans.groupBy(*key).agg(F.count("*").alias("spans"), F.countDistinct("pii_type").alias("types"), F.avg("confidence").alias("avg_confidence"), F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"))


def type_histogram(spans: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return spans.groupBy(*by, "pii_type").agg(F.count("*").alias("spans"), F.avg("confidence").alias("avg_confidence"))


def threshold_sweep(spans: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Spans that pass each threshold, counted in one pass."""
    one = spans.agg(*(F.count_if(F.col("confidence") >= t).alias(str(k)) for k, t in enumerate(thresholds)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(str(k)).alias("spans")) for k, t in enumerate(thresholds)))).alias("s")).select("s.*")


def apply_corrections(spans: DataFrame, corrections: DataFrame, key: Sequence[str] = ("doc_id", "start_pos", "end_pos", "pii_type")) -> DataFrame:
    """Spans after corrections: action remove, recategorise (new_type) or retext (new_text)."""
    out = spans.join(corrections.select(*key, "action", "new_type", "new_text"), list(key), "left").filter(F.coalesce(F.col("action"), F.lit("")) != "remove")
    return out.withColumns({"pii_type": F.when(F.col("action") == "recategorise", F.col("new_type")).otherwise(F.col("pii_type")), "text": F.when(F.col("action") == "retext", F.col("new_text")).otherwise(F.col("text"))}).drop("action", "new_type", "new_text")


def accept(spans: DataFrame, least: float = 0.7, key: str = "doc_id", flags: Mapping[str, str] | None = None) -> DataFrame:
    """Documents whose spans are taken as they are: any, with at least the mean confidence asked for. Confidences count in millionths."""
    out = spans.groupBy(key).agg(F.count("*").alias("spans"), F.sum(millionths(F.col("confidence"))).alias("_total"), F.count("confidence").alias("_n"))
    total, n = F.col("_total"), F.col("_n")
    return out.select(key, "spans", mean_of_millionths(total, n).alias("mean"), ((F.col("spans") > 0) & mean_reaches(total, n, least)).alias("accepted"))


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)
