"""Quality of spans, labels and documents, as column expressions and aggregations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, by_value, digits, ratio
from .scan import percentiles

#: Weights of the confidence factors.
FACTORS = {"model": 0.25, "format": 0.20, "context": 0.15, "cross": 0.15, "pattern": 0.10, "domain": 0.10, "extraction": 0.05}
#: What a span of a type looks like from end to end.
FORMATS = {
    "EMAIL": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "PHONE": r"^[\+]?[1-9][\d\s\-\(\)\.]{8,15}$",
    "SSN": r"^\d{3}-?\d{2}-?\d{4}$",
    "CREDIT_CARD": r"^(?:\d{4}[\s\-]?){3}\d{4}$",
    "POSTAL_CODE": r"^[A-Z]\d[A-Z]\s?\d[A-Z]\d$",
    "ZIP_CODE": r"^\d{5}(-\d{4})?$",
    "DATE": r"^\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}$|^\d{4}[\/\-\.]\d{1,2}[\/\-\.]\d{1,2}$",
}
#: Words near a span of a type.
INDICATORS = {
    "EMAIL": ("email", "e-mail", "contact", "@", "send to"),
    "PHONE": ("phone", "telephone", "cell", "mobile", "call", "number"),
    "ADDRESS": ("address", "located", "residence", "street", "city"),
    "PERSON": ("name", "mr.", "mrs.", "ms.", "dr.", "contact"),
    "DATE": ("date", "born", "birth", "on", "signed", "effective"),
}
COMMON_DOMAINS = ("gmail.com", "yahoo.com", "hotmail.com", "outlook.com")
#: Bounds of confidence levels, of difficulty levels and of grades.
LEVELS = (("very_low", 0.3), ("low", 0.5), ("medium", 0.7), ("high", 0.9), ("very_high", None))
DIFFICULTY = (("easy", 0.25), ("medium", 0.5), ("hard", 0.75), ("very_hard", None))
GRADES = (("A", 0.9), ("B", 0.8), ("C", 0.7), ("D", 0.6))
DIFFICULTY_WEIGHTS = {"image_quality": 0.25, "text_complexity": 0.20, "layout_complexity": 0.20, "content_type": 0.15, "special_elements": 0.20}
#: What a factor adds to the difficulty by file type.
TYPE_DIFFICULTY = {"txt": 0.1, "docx": 0.3, "pdf": 0.4, "xlsx": 0.5, "png": 0.6, "jpg": 0.6}


def level(score: Column, bounds: Sequence[tuple[str, float | None]]) -> Column:
    """The first name whose bound is above the score; the last has none."""
    out = None
    for name, top in bounds[:-1]:
        out = F.when(score < top, name) if out is None else out.when(score < top, name)
    return out.otherwise(bounds[-1][0])


def grade(score: Column) -> Column:
    out = None
    for name, least in GRADES:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("F")


def format_factor(kind: Column, text: Column) -> Column:
    """1 for a text of the type's format, less for a near miss; heuristics for people and addresses; 0.5 for other types."""
    text = F.trim(text)
    known, fits = F.lit(False), F.lit(False)
    for k, pattern in FORMATS.items():
        known = known | (kind == k)
        fits = fits | ((kind == k) & F.rlike(text, F.lit(pattern)))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    alpha = F.forall(words, lambda w: F.rlike(w, F.lit(r"^\p{L}+$")))
    near = F.when((kind == "EMAIL") & F.contains(text, F.lit("@")) & F.contains(text, F.lit(".")), 0.6).when((kind == "PHONE") & (F.length(digits(text)) > 0) & (F.length(text) >= 10), 0.7).otherwise(0.2)
    person = F.when((F.size(words) >= 2) & alpha, 0.9).when(F.size(words) >= 2, 0.6).otherwise(0.3)
    place = F.when(any_of(F.lower(text), ("street", "st", "avenue", "ave", "road", "rd")), 0.8).when(F.size(words) >= 3, 0.6).otherwise(0.4)
    return F.when(fits, 1.0).when(known, near).when(kind == "PERSON", person).when(kind == "ADDRESS", place).otherwise(0.5)


def context_factor(kind: Column, near: Column) -> Column:
    """0.5 and 0.05 for each word near the span that points to its type, 0.2 at most; 0 without surroundings."""
    hits = F.lit(0)
    for k, words in INDICATORS.items():
        for w in words:
            hits = hits + F.when((kind == k) & F.contains(near, F.lit(w)), 1).otherwise(0)
    return F.when(near.isNull(), 0.0).otherwise(0.5 + F.least(hits * 0.05, F.lit(0.2)))


def with_cross_factor(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """cross: 0.5; 0.2 more for a text found again, 0.1 for an e-mail domain, 0.05 for an area code found again in the document."""
    n = lambda *c: F.count("*").over(Window.partitionBy(key, "kind", *c))
    out = spans.withColumns({"_domain": F.when(F.contains(F.col("text"), F.lit("@")), F.substring_index("text", "@", -1)), "_area": F.substring(digits(F.col("text")), 1, 3)})
    again = F.when(n("text") > 1, 0.2).otherwise(0.0)
    domain = F.when((F.col("kind") == "EMAIL") & F.col("_domain").isNotNull() & (F.col("_domain") != "") & (n("_domain") > 1), 0.1).otherwise(0.0)
    area = F.when((F.col("kind") == "PHONE") & (n("_area") > 1), 0.05).otherwise(0.0)
    return out.withColumn("cross", F.least(0.5 + again + domain + area, F.lit(1.0))).drop("_domain", "_area")


def pattern_factor(kind: Column, text: Column) -> Column:
    low = F.lower(text)
    email = F.when(any_of(low, COMMON_DOMAINS), 0.9).otherwise(0.7)
    return F.when(kind == "EMAIL", email).when(kind == "PERSON", F.when(any_of(low, ("mr.", "mrs.", "ms.", "dr.")), 0.9).otherwise(0.6)).otherwise(0.7)


def assess(spans: DataFrame, key: str = "doc_id", least: float = 0.7) -> DataFrame:
    """Adds the factors, their weighted sum adjusted, level, validity and flags to spans with kind, text, confidence and near (lower-case surroundings)."""
    kind, text = F.col("kind"), F.col("text")
    out = with_cross_factor(spans, key).withColumns({"model": F.col("confidence"), "format": format_factor(kind, text), "context": context_factor(kind, F.col("near")), "pattern": pattern_factor(kind, text), "domain": F.lit(0.5), "extraction": F.lit(0.7)})
    adjusted = sum((w * F.col(f) for f, w in list(FACTORS.items())[1:]), FACTORS["model"] * F.col("model"))
    valid, there = F.col("format") > 0.5, F.contains(F.coalesce("near", F.lower("text")), F.lower("text"))
    flags = F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in ((F.col("format") <= 0.5, "format_issues"), (F.col("context") < 0.4, "poor_context_consistency"), (adjusted < least, "low_confidence")))), lambda x: x.isNotNull())
    return out.withColumns({"adjusted": adjusted, "level": level(adjusted, LEVELS), "validity": F.when(valid & there, "valid").when(valid | there, "uncertain").otherwise("format_error"), "flags": flags})


def document_quality(assessed: DataFrame, key: str = "doc_id", least: float = 0.7) -> DataFrame:
    """Mean confidence, share of confident spans, quality and whether a person must look, for each document."""
    out = assessed.groupBy(key).agg(F.count("*").alias("spans"), F.avg("adjusted").alias("mean"), F.avg(F.when(F.col("adjusted") >= least, 1.0).otherwise(0.0)).alias("sure"), F.avg(F.when(F.size("flags") > 0, 1.0).otherwise(0.0)).alias("flagged"))
    both = lambda x: (F.col("mean") >= x) & (F.col("sure") >= x)
    quality = F.when(both(0.8), "excellent").when(both(0.7), "good").when(both(0.5), "questionable").when(F.col("flagged") > 0.5, "suspicious").otherwise("poor")
    return out.withColumn("quality", quality).withColumn("review", ~quality.isin("excellent", "good") | (F.col("flagged") > 0) | (F.col("mean") < least))


def label_scores(spans: DataFrame, expected: Mapping[str, Sequence[str]], key: str = "doc_id", doc_type: str = "doc_type") -> DataFrame:
    """confidence: mean; consistency: 1 less the mean population variance by type (0.8 for single spans); completeness: found of the types that the document type should have."""
    types = spans.groupBy(key, doc_type, "pii_type").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"), F.var_pop("confidence").alias("v"))
    per = types.groupBy(key, doc_type).agg((F.sum("s") / F.sum("n")).alias("confidence"), F.avg(F.when(F.col("n") > 1, 1 - F.col("v")).otherwise(0.8)).alias("consistency"), F.collect_set("pii_type").alias("found"))
    wanted = by_value(F.col(doc_type), {k: F.array(*map(F.lit, v)) for k, v in expected.items()}, F.array().cast("array<string>"))
    missing = F.array_except(wanted, "found")
    return per.withColumns({"missing": F.array_sort(missing), "completeness": F.when(F.size(wanted) > 0, 1 - F.size(missing) / F.size(wanted)).otherwise(1.0)}).drop("found")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two annotators and Cohen's kappa, from one aggregation of their answers."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    total = Window.partitionBy()  # a row for each pair of answers
    share = cells.withColumn("p", F.col("n") / F.sum("n").over(total))
    rows, columns = share.groupBy(F.col(a).alias("k")).agg(F.sum("p").alias("pa")), share.groupBy(F.col(b).alias("k")).agg(F.sum("p").alias("pb"))
    expected = rows.join(columns, "k").agg(F.coalesce(F.sum(F.col("pa") * F.col("pb")), F.lit(0.0)).alias("expected"))
    observed = share.agg(F.coalesce(F.sum(F.when(F.col(a) == F.col(b), F.col("p"))), F.lit(0.0)).alias("observed"))
    return observed.crossJoin(expected).withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))).otherwise(1.0))


def annotator_pairs(annotations: DataFrame, key: Sequence[str] = ("doc_id", "start_pos", "end_pos")) -> DataFrame:
    """Pairs of annotators at the same place, and whether type and text agree."""
    a, b = (annotations.select(*key, F.col("annotator").alias(f"annotator_{x}"), F.col("pii_type").alias(f"type_{x}"), F.lower("text").alias(f"text_{x}")) for x in "ab")
    out = a.join(b, list(key)).filter("annotator_a < annotator_b")
    return out.groupBy("annotator_a", "annotator_b").agg(F.count("*").alias("places"), F.avg(F.when(F.col("type_a") == F.col("type_b"), 1.0).otherwise(0.0)).alias("type_agreement"), F.avg(F.when(F.col("text_a") == F.col("text_b"), 1.0).otherwise(0.0)).alias("text_agreement"))


def validation_report(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean, median, population deviation and grade of validation scores."""
    out = scores.agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return _with_median(out, scores, score).withColumn("grade", grade(F.col("mean")))


def _with_median(one: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Adds the exact median of rows to their one row of totals."""
    median = percentiles(rows, [], value, [0.5]).select(F.col("q")[0].alias("median"))
    return one.join(F.broadcast(median), F.lit(True), "left")


def review_queue(rows: DataFrame) -> DataFrame:
    """Minutes a review takes and its priority, from score, entities, issues, high issues, document_priority (1 to 3), complexity and sensitive."""
    minutes = (5 + 0.5 * F.col("entities") + 2 * F.col("issues") + F.greatest(F.lit(0), 2 * (F.col("complexity") - 3))).cast("int")
    priority = (1 - F.col("score")) * 10 + 5 * F.col("high_issues") + 2 * F.col("document_priority") + F.when(F.col("sensitive"), 3).otherwise(0)
    return rows.withColumns({"minutes": F.least(F.greatest(minutes, F.lit(5)), F.lit(30)), "priority": priority})


def difficulty(rows: DataFrame) -> DataFrame:
    """Weighted score of the five factor columns, its level, and the confidence 1 less four times their variance."""
    factors = [F.coalesce(F.col(c), F.lit(0.5)) for c in DIFFICULTY_WEIGHTS]
    score = sum((w * f for w, f in list(zip(DIFFICULTY_WEIGHTS.values(), factors, strict=True))[1:]), 0.25 * factors[0])
    mean = sum(factors[1:], factors[0]) / len(factors)
    variance = sum(((f - mean) * (f - mean) for f in factors[1:]), (factors[0] - mean) * (factors[0] - mean)) / len(factors)
    return rows.withColumns({"score": score, "level": level(score, DIFFICULTY), "confidence": F.greatest(F.lit(0.0), 1 - 4 * variance)})


def text_complexity(text: Column) -> Column:
    """0 to 1 from length, mean word length and share of signs."""
    words = F.size(F.split(F.trim(text), r"\s+"))
    return (F.least(F.length(text) / 5000, F.lit(1.0)) + F.least(ratio(F.length(text), words) / 12, F.lit(1.0)) + F.least(F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / F.greatest(F.length(text), F.lit(1)) * 5, F.lit(1.0))) / 3


def auto_tags(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each tag: format, size (small below 1 MB, medium below 10 MB), ground_truth."""
    size = F.when(F.col("bytes") < 1 << 20, "small").when(F.col("bytes") < 10 << 20, "medium").otherwise("large")
    tags = F.array(*(F.struct(F.lit(n).alias("tag"), v.cast("string").alias("value")) for n, v in (("format", F.col("format")), ("size_category", size), ("ground_truth", F.coalesce(F.col("has_truth"), F.lit(False))))))
    return rows.select(key, F.inline(tags))


def tag_statistics(tags: DataFrame, key: str = "doc_id") -> DataFrame:
    return tags.groupBy("tag", "value").agg(F.countDistinct(key).alias("documents"))


def with_tags(docs: DataFrame, tags: DataFrame, tag: str, value: str | None = None, key: str = "doc_id") -> DataFrame:
    """Documents that carry a tag (with a value)."""
    wanted = tags.filter((F.col("tag") == tag) & (F.lit(True) if value is None else F.col("value") == value))
    return docs.join(wanted.select(key).distinct(), key, "left_semi")


def check_schema(rows: DataFrame, required: Sequence[str] = (), lengths: Mapping[str, tuple[int | None, int | None]] | None = None, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """errors: what a row lacks of required fields, length limits and patterns; rows that lack nothing have none."""
    found = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    for c, (lo, hi) in (lengths or {}).items():
        found += [F.when(F.length(c) < lo, F.lit(f"{c} too short"))] if lo is not None else []
        found += [F.when(F.length(c) > hi, F.lit(f"{c} too long"))] if hi is not None else []
    found += [F.when(~F.rlike(F.col(c), F.lit(p)), F.lit(f"{c} does not match")) for c, p in (patterns or {}).items()]
    return rows.withColumn("errors", F.filter(F.array(*found), lambda x: x.isNotNull()))


def domain_boost(text: Column, keywords: Sequence[str]) -> Column:
    """0.05 for each keyword of the domain in the text, 0.2 at most."""
    hits = F.lit(0)
    for w in keywords:
        hits = hits + F.contains(F.lower(text), F.lit(w)).cast("int")
    return F.least(0.05 * hits, F.lit(0.2))


def labelled_statistics(docs: DataFrame, labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Documents and labelled ones, and completeness, by group; groups without labels stay."""
    out = docs.join(labels, "doc_id", "left")
    return out.groupBy(*by).agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.avg(F.when(F.col("quality").isNotNull(), 1.0).otherwise(0.0)).alias("completeness"))


def dataset_quality(scores: DataFrame, completeness: Column, score: str = "confidence", low: float = 0.7) -> DataFrame:
    """Moments of confidence, the share of low ones, issues above a tenth, and 0.4 completeness and 0.6 mean."""
    out = scores.agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("least"), F.max(score).alias("most"), F.avg(F.when(F.col(score) < low, 1.0).otherwise(0.0)).alias("low_share"), F.avg(completeness).alias("completeness"))
    return _with_median(out, scores, score).withColumns({"low_confidence_issue": F.col("low_share") > 0.1, "overall": 0.4 * F.col("completeness") + 0.6 * F.col("mean")})


def error_patterns(errors: DataFrame, n: int = 10, examples: int = 5) -> DataFrame:
    """The n most frequent pairs of type and error, with mean non-zero confidence and examples: the first texts in order."""
    sure = F.nullif("confidence", F.lit(0.0))
    # One row for each pattern and text, so that a frequent pattern's texts are never gathered in one task.
    texts = errors.groupBy(F.struct("pii_type", "error").alias("of"), "text").agg(F.count("*").alias("n"), F.sum(sure).alias("sure"), F.count(sure).alias("n_sure"))
    top = texts.groupBy("of").agg(F.sum("n").alias("n"), (F.sum("sure") / F.nullif(F.sum("n_sure"), F.lit(0))).alias("avg_confidence"))
    top = top.withColumn("pattern", F.concat_ws("_", "of.pii_type", "of.error")).orderBy(F.desc("n"), "pattern").limit(n)
    first = texts.filter("text is not null").select("of", "text", F.row_number().over(Window.partitionBy("of").orderBy("text")).alias("nth")).filter(F.col("nth") <= examples)
    first = first.groupBy("of").agg(F.array_sort(F.collect_list("text")).alias("examples"))  # a few for each pattern
    none = F.array().cast("array<string>")
    return top.join(first, "of", "left").select("n", "avg_confidence", F.coalesce("examples", none).alias("examples"), "pattern")


def confidence_bins(spans: DataFrame) -> DataFrame:
    return spans.groupBy(level(F.col("confidence"), (("0-0.3", 0.3), ("0.3-0.6", 0.6), ("0.6-0.8", 0.8), ("0.8-1", None))).alias("bin")).agg(F.count("*").alias("n"))


#: Words of an error message that give its category, in order.
ERROR_WORDS = (
    ("timeout", ("timeout", "timed out")), ("authentication", ("auth", "api key", "unauthorized")), ("rate_limit", ("rate limit", "quota", "429")), ("network", ("network", "connection", "dns")),
    ("file_access", ("permission", "not found", "no such file")), ("format", ("format", "parse", "decode")), ("memory", ("memory", "oom")),
)


def error_category(message: Column) -> Column:
    low, out = F.lower(message), None
    for name, words in ERROR_WORDS:
        out = F.when(any_of(low, words), name) if out is None else out.when(any_of(low, words), name)
    return out.otherwise("other")


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds before the next attempt."""
    wait = F.least(base * F.pow(F.lit(2.0), attempt), F.lit(most))
    return wait if jitter is None else wait * jitter


def health(checks: DataFrame) -> DataFrame:
    """The worst status of all checks, their mean response and the failed ones."""
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    out = checks.agg(F.max(rank).alias("r"), F.avg("response").alias("avg_response"), F.array_sort(F.collect_set(F.when(rank == 2, F.col("name")))).alias("failed"))
    return out.select(F.element_at(F.array(*map(F.lit, ("healthy", "degraded", "unhealthy"))), F.col("r") + 1).alias("status"), "avg_response", "failed")
