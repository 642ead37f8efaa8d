"""What stands around external models: chunks for them, spans from their tags, and models over spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..sources.sinks import checkpointed

#: Type of each label of a tagger, words that are no names.
LABELS = {"PER": "person_name", "ORG": "organization", "LOC": "location", "MISC": "misc_pii"}
NO_NAMES = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "before", "after", "above", "below", "between", "among",
    "le", "la", "les", "un", "une", "des", "du", "de", "et", "ou", "mais", "dans", "sur", "avec",
)
#: One-hot columns of the span features.
FEATURE_TYPES = ("person_name", "email_address", "phone_number", "address", "date_of_birth", "social_security_number", "credit_card_number", "organization", "location", "misc_pii")
FEATURE_EXTRACTORS = ("rule_based", "layoutlm", "donut", "ner_model")


def chunks(text: Column, most: int = 512) -> Column:
    """Sentences packed into chunks of at most `most` characters, joined by ". "; a sentence too long for a chunk of its own is packed word by word."""
    none = F.array().cast("array<string>")

    def full(acc: Column, piece: Column) -> Column:
        return F.length(acc["now"]) + F.length(piece) + 1 > most

    def push(acc: Column, piece: Column, glue: str) -> Column:
        fits = F.when(acc["now"] == "", piece).otherwise(F.concat(acc["now"], F.lit(glue), piece))
        return F.when(~full(acc, piece), F.struct(acc["done"].alias("done"), fits.alias("now"))).when(acc["now"] != "", F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), piece.alias("now")))

    def word(acc: Column, w: Column) -> Column:
        return F.coalesce(push(acc, w, " "), F.struct(F.concat(acc["done"], F.array(w)).alias("done"), acc["now"].alias("now")))

    def sentence(acc: Column, s: Column) -> Column:
        by_word = F.aggregate(F.filter(F.split(s, r"\s+"), lambda w: w != ""), acc, word)
        return F.coalesce(push(acc, s, ". "), by_word)

    sentences = F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    start = F.struct(none.alias("done"), F.lit("").alias("now"))
    packed = F.aggregate(sentences, start, sentence, lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
    return F.when(F.size(packed) > 0, packed).otherwise(F.array(F.substring(text, 1, most)))


def tagger_valid(kind: Column, text: Column) -> Column:
    """Two characters or more with a letter among them; a name has a capital and is no common word."""
    letter = F.rlike(text, F.lit("[a-zA-ZÀ-ÿ]"))
    name = ~F.lower(text).isin(*NO_NAMES) & F.rlike(text, F.lit("[A-ZÀ-Ÿ]"))
    return (F.length(F.trim(text)) >= 2) & letter & F.when(kind == "person_name", name).otherwise(True)


def bio_spans(tags: DataFrame, least: float = 0.85, key: str = "doc_id") -> DataFrame:
    """Spans from tagged tokens (position, token, tag, confidence): B opens a span, I goes on with it; each I halves the way of the confidence to its own.

    Tokens below least and I tags with no span open are passed over.
    """
    sure = tags.filter((F.col("confidence") >= least) & F.rlike("tag", F.lit("^[BI]-")))
    order = Window.partitionBy(key).orderBy("position")
    opened = F.sum(F.when(F.col("tag").startswith("B-"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    spans = sure.withColumn("span", opened).filter("span > 0").groupBy(key, "span").agg(F.array_sort(F.collect_list(F.struct("position", "token", "tag", "confidence"))).alias("t"))
    first = F.col("t")[0]
    confidence = F.aggregate(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), first["confidence"], lambda acc, x: (acc + x["confidence"]) / 2)
    label = F.substring(first["tag"], 3, 100)
    kinds = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return spans.select(key, F.array_join(F.transform("t", lambda x: x["token"]), " ").alias("text"), F.coalesce(F.try_element_at(kinds, label), F.lit("unknown")).alias("pii_type"), confidence.alias("confidence"), first["position"].alias("start_token"))


def quality_grade(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "A").when(confidence >= 0.8, "B").when(confidence >= 0.7, "C").otherwise("D")


def span_features(spans: DataFrame) -> DataFrame:
    """Adds f: 25 numbers of a span: 3 measures, 10 types, 4 extractors, 2 of place and 6 of its letters."""
    text, placed = F.col("text"), (F.col("start_pos") > 0) & (F.col("end_pos") > 0)
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    letters = F.rlike(text, F.lit(r"\p{L}"))
    numbers = [F.col("confidence"), F.length(text).cast("double"), F.length("context").cast("double")]
    numbers += [yes(F.col("pii_type") == t) for t in FEATURE_TYPES] + [yes(F.contains(F.lower("extractor"), F.lit(x))) for x in FEATURE_EXTRACTORS]
    numbers += [F.when(placed, F.col("start_pos")).otherwise(0).cast("double"), F.when(placed, F.col("end_pos") - F.col("start_pos")).otherwise(0).cast("double")]
    numbers += [yes(letters & (F.upper(text) == text)), yes(letters & (F.lower(text) == text)), yes(F.rlike(text, F.lit(r"^\d+$"))), *(yes(F.contains(text, F.lit(c))) for c in "@.-")]
    return spans.withColumn("f", F.array(*(F.coalesce(n, F.lit(0.0)) for n in numbers)))


def labelled(spans: DataFrame, truth: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds label: 1 if the document's truth has the same type and lower-cased text."""
    known = truth.select(key, "pii_type", F.lower(F.trim("text")).alias("_low"), F.lit(1.0).alias("label")).distinct()
    return spans.withColumn("_low", F.lower(F.trim("text"))).join(known, [key, "pii_type", "_low"], "left").fillna(0.0, ["label"]).drop("_low")


def _vector(rows: DataFrame, n: int) -> DataFrame:
    return rows.select("*", *(F.col("f")[k].alias(f"_f{k}") for k in range(n)))


def train_meta(spans: DataFrame, n: int = 25) -> PipelineModel:
    """A classifier of spans (features f, label), for meta()."""
    columns = [f"_f{k}" for k in range(n)]
    steps = [VectorAssembler(inputCols=columns, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="label", probabilityCol="_p", predictionCol="_q", rawPredictionCol="_r", regParam=0.01)]
    rows = _vector(spans.select("f", "label"), n).persist()  # each step of the fit reads them again
    try:
        return Pipeline(stages=steps).fit(rows)
    finally:
        rows.unpersist()


def meta(grouped: DataFrame, model: PipelineModel, least: float = 0.5, key: str = "doc_id", n: int = 25) -> DataFrame:
    """The likeliest member of each group by the classifier, with its probability as confidence."""
    scored = model.transform(_vector(grouped, n)).withColumn("p", vector_to_array("_p")[1])
    best = F.max_by(F.struct("text", "start_pos", "end_pos", "extractor"), F.struct("p", "confidence", -F.col("start_pos")))
    return scored.groupBy(key, "pii_type", "grp").agg(best.alias("b"), F.max("p").alias("confidence"), F.count("*").alias("votes")).filter(F.col("confidence") >= least).select(key, "pii_type", "b.*", "confidence", "votes")


def weighted_rates(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Accuracy, and precision, recall and F1 averaged over classes by their share, of pairs of labels."""
    cells = pairs.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    parts = cells.select(F.inline(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("support"), F.lit(0).alias("found"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("support"), F.col("n").cast("int").alias("found"), F.lit(0).cast("long").alias("hit")))))
    per = parts.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("support", "found", "hit")))
    p, r = ratio(F.col("hit"), F.col("found")), ratio(F.col("hit"), F.col("support"))
    share = F.col("support")
    out = per.withColumns({"p": p, "r": r}).withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    return out.agg((F.sum("hit") / F.sum(share)).alias("accuracy"), *((F.sum(share * F.col(c)) / F.sum(share)).alias(n) for c, n in (("p", "precision"), ("r", "recall"), ("f", "f1"))))


def model_profiles(summary: DataFrame, columns: Sequence[str], k: int = 3, seed: int = 7) -> DataFrame:
    """Clusters of models by their standardised measures, at most k and no more than there are models."""
    summary = checkpointed(summary)  # a row for each model; every step of the fit reads them again
    n = min(k, summary.count())
    if n < 2:
        return summary.withColumn("profile", F.lit(0))
    steps = [VectorAssembler(inputCols=list(columns), outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_x", withMean=True), KMeans(k=n, seed=seed, featuresCol="_x", predictionCol="profile")]
    return Pipeline(stages=steps).fit(summary).transform(summary).drop("_v", "_x")
