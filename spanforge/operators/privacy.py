"""Protection of spans in text: redaction, tokens, noise and checklists."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import by_value, digits

#: What stands for a span of a type without its form; other types are their upper-case name in brackets.
LABELS = {
    "person_name": "[NAME]", "email_address": "[EMAIL]", "phone_number": "[PHONE]", "address": "[ADDRESS]", "date_of_birth": "[DOB]",
    "social_security_number": "[SSN]", "credit_card_number": "[CARD]", "organization": "[ORG]", "location": "[LOCATION]", "misc_pii": "[PII]",
}
BLOCK = "█"


def label(kind: Column) -> Column:
    return by_value(kind, LABELS, F.concat(F.lit("["), F.upper(kind), F.lit("]")))


def replacement(kind: Column, text: Column, preserve_format: bool = True) -> Column:
    """What stands in place of a span: its label, or blocks that keep its form.

    E-mails keep their @, phones what is no digit, cards their last four digits and what is no
    digit; others become as many blocks as they have characters, unless the label is as long.
    """
    if not preserve_format:
        return label(kind)
    blocks = lambda n: F.repeat(F.lit(BLOCK), n.cast("int"))
    parts = F.split(text, "@")
    email = F.concat(blocks(F.length(parts[0])), F.lit("@"), blocks(F.length(F.get(parts, F.lit(1)))))
    default = F.when(F.length(label(kind)) == F.length(text), label(kind)).otherwise(blocks(F.length(text)))
    hidden = F.length(digits(text)) - 4
    # every digit that at least four digits follow becomes a block
    card = F.regexp_replace(text, r"\d(?=(?:\D*\d){4})", BLOCK)
    return (
        F.when((kind == "email_address") & (F.size(parts) == 2), email)
        .when(kind == "phone_number", F.regexp_replace(text, r"\d", BLOCK))
        .when((kind == "credit_card_number") & (hidden >= 0), card)
        .otherwise(default)
    )


def clear_of_overlaps(spans: Column) -> Column:
    """An array of spans without those that overlap a better one: the likelier, then the longer, then the earlier stays; in order of place.

    Offsets refer to the original text, so overlapping spans could not both be replaced.
    """
    real = F.filter(spans, lambda x: (x["start_pos"] >= 0) & (x["end_pos"] > x["start_pos"]))
    rank = lambda x: F.struct((-x["confidence"]).alias("c"), (x["start_pos"] - x["end_pos"]).alias("n"), x["start_pos"].alias("at"), x["pii_type"].alias("kind"), x.alias("x"))
    best = F.array_sort(F.transform(real, rank))
    free = lambda kept, r: ~F.exists(kept, lambda k: (k["at"] < r["x"]["end_pos"]) & (r["at"] < k["at"] - k["n"]))
    kept = F.aggregate(best, F.filter(best, lambda x: F.lit(False)), lambda acc, r: F.when(free(acc, r), F.concat(acc, F.array(r))).otherwise(acc))
    by_place = F.array_sort(F.transform(kept, lambda r: F.struct(r["at"].alias("at"), r["x"].alias("x"))))
    return F.transform(by_place, lambda r: r["x"])


def without_overlaps(spans: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Spans none of which overlaps a better one: the likelier, then the longer, then the earlier stays."""
    own = [c for c in spans.columns if c not in key]
    packed = spans.groupBy(*key).agg(F.collect_list(F.struct(*own)).alias("_s"))
    return packed.select(*key, F.inline(clear_of_overlaps(F.col("_s")))).select(*spans.columns)


Put = Callable[[Column, Column], Column]


def rewritten(body: Column, spans: Column, put: Put) -> Column:
    """body with each span of an array replaced by put(type, text); spans are in order and do not overlap."""

    def piece(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(spans, i - 1)["end_pos"], F.lit(0))
        return F.concat(F.substring(body, before + 1, x["start_pos"] - before), put(x["pii_type"], x["text"]))

    last = F.coalesce(F.get(spans, F.size(spans) - 1)["end_pos"], F.lit(0))
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(body, last + 1, F.length(body)))


def rewrite(docs: DataFrame, spans: DataFrame | str, put: Put, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Texts with each span replaced by put(type, text); where spans overlap, the better one.

    spans is the name of an array column of docs, which needs no shuffle and is dropped, or a table that is
    grouped by key and joined.
    """
    if isinstance(spans, str):
        rows = docs.withColumnRenamed(spans, "_spans")
    else:
        span = F.struct("start_pos", "end_pos", "pii_type", "text", "confidence")
        rows = docs.join(spans.groupBy(key).agg(F.collect_list(span).alias("_spans")), key, "left")
    rows = rows.withColumn("_spans", clear_of_overlaps(F.col("_spans")))
    body, found = F.coalesce(F.col(text), F.lit("")), F.size("_spans") > 0
    return rows.withColumn(text, F.when(found, rewritten(body, F.col("_spans"), put)).otherwise(F.col(text))).drop("_spans")


def redact(docs: DataFrame, spans: DataFrame | str, preserve_format: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    return rewrite(docs, spans, lambda kind, value: replacement(kind, value, preserve_format), text, key)


def token(kind: Column, text: Column, secret: str, prefix: str = "TOK_") -> Column:
    """The token of a value: the same for the same type, text and secret."""
    return F.concat(F.lit(prefix), F.upper(kind), F.lit("_"), F.substring(F.sha2(F.concat(F.lit(secret), kind, F.lit("|"), text), 256), 1, 16))


def shaped_token(text: Column, secret: str) -> Column:
    """Digits and letters replaced by others of their kind, drawn from a keyed hash of the text; the rest stays."""
    chars = F.split(text, "")
    seed = F.sha2(F.concat(F.lit(secret), text), 512)
    draw = lambda i, n: F.conv(F.substring(F.sha2(F.concat(seed, i.cast("string")), 256), 1, 8), 16, 10).cast("long") % n
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), (draw(i, len(alphabet)) + 1).cast("int"), F.lit(1))
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_join(F.transform(chars, lambda c, i: F.when(F.rlike(c, F.lit("[0-9]")), pick("0123456789", i)).when(F.rlike(c, F.lit("[a-z]")), pick(low, i)).when(F.rlike(c, F.lit("[A-Z]")), pick(up, i)).otherwise(c)), "")


def token_vault(spans: DataFrame, secret: str, key_hex: str | None = None) -> DataFrame:
    """A row for each token with its value, sealed if a key is given."""
    t = token(F.col("pii_type"), F.col("text"), secret)
    out = spans.select(t.alias("token"), "pii_type", "text").distinct()
    return out if key_hex is None else out.select("token", "pii_type", F.base64(F.aes_encrypt("text", F.unhex(F.lit(key_hex)))).alias("sealed"))


def tokenize(docs: DataFrame, spans: DataFrame | str, secret: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    return rewrite(docs, spans, lambda kind, value: token(kind, value, secret), text, key)


def detokenize(docs: DataFrame, vault: DataFrame, text: str = "text", key: str = "doc_id", prefix: str = "TOK_") -> DataFrame:
    """Texts with the tokens that the vault knows put back; tokens of a text are looked up by join."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"({prefix}[A-Z_]+_[0-9a-f]{{16}})"), F.lit(1))
    used = docs.select(key, F.explode(F.array_distinct(found)).alias("token")).join(vault.select("token", F.col("text").alias("value")), "token")
    known = used.groupBy(key).agg(F.collect_list(F.struct("token", "value")).alias("known"))
    back = F.aggregate("known", F.col(text), lambda acc, k: F.replace(acc, k["token"], k["value"]))
    return docs.join(known, key, "left").withColumn(text, F.when(F.col("known").isNull(), F.col(text)).otherwise(back)).drop("known")


def mixed(docs: DataFrame, spans: DataFrame | str, secret: str, redacted: Sequence[str] = ("social_security_number", "credit_card_number"), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Some types are redacted, the rest gets tokens, in one pass over one list of spans."""
    return rewrite(docs, spans, lambda kind, value: F.when(kind.isin(*redacted), replacement(kind, value)).otherwise(token(kind, value, secret)), text, key)


def laplace_counts(counts: DataFrame, key: Sequence[str], n: str, epsilon: float, salt: str) -> DataFrame:
    """Counts with Laplace noise of scale 1 / epsilon, whole and not below 0; the noise depends on key and salt."""
    seed = F.md5(F.concat_ws("|", F.lit(salt), *key))
    u = (F.conv(F.substring(seed, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48) - 0.5
    noise = -(1 / epsilon) * F.signum(u) * F.log(1 - 2 * F.abs(u))
    return counts.withColumn("noisy", F.greatest((F.col(n) + noise).cast("long"), F.lit(0)))


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    from math import log, sqrt

    return sensitivity * sqrt(2 * log(1.25 / delta)) / epsilon


#: Fixed values: (requirement, column of the record that meets it).
GDPR = (("data_minimization", "purpose_defined"), ("purpose_limitation", "purpose_defined"), ("storage_limitation", "retention_policy"), ("accuracy", "validation_enabled"), ("security", "security_measures"), ("accountability", "processing_documented"))
SECURITY = ("encryption", "access_control")
LAW25 = (("consent", "consent_obtained"), ("notification", "privacy_policy_available"), ("data_protection_officer", "dpo_designated"), ("privacy_impact_assessment", "pia_completed"), ("breach_notification", "breach_procedures"))


def checklist(records: DataFrame, needs: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds a flag for each requirement, and compliant if all are met; an array of measures must hold all of SECURITY."""
    kinds = dict(records.dtypes)
    enough = lambda c: F.size(F.array_except(F.array(*map(F.lit, SECURITY)), c)) == 0
    met = {name: F.coalesce(enough(F.col(c)) if kinds[c].startswith("array") else F.col(c), F.lit(False)) for name, c in needs}
    every = F.lit(True)
    for flag in met.values():
        every = every & flag
    return records.withColumns(met | {"compliant": every})


def highlight(docs: DataFrame, spans: DataFrame | str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Texts with each span in a marked element."""
    return rewrite(docs, spans, lambda kind, value: F.concat(F.lit('<mark data-type="'), kind, F.lit('">'), value, F.lit("</mark>")), text, key)
