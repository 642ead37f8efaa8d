"""Estimates, suggestions and report rules as column expressions and rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, by_value, ratio

#: Output tokens for each input token by task.
TASK_OUTPUT = {"basic_text_extraction": 0.8, "structured_data_extraction": 1.2, "handwriting_recognition": 0.9, "table_extraction": 1.5, "document_analysis": 2.0}
#: Complexity of file types, sizes of models from small to large, file types of documents.
TYPE_COMPLEXITY = {"pdf": 0.7, "png": 0.4, "jpg": 0.3, "jpeg": 0.3, "tiff": 0.6}
SIZES = ("tiny", "small", "medium", "large", "xlarge")
#: Seconds and dollars that a document of a level takes.
LEVEL_SECONDS = {"easy": 5, "medium": 10, "hard": 18, "very_hard": 30}


def image_tokens(width: Column, height: Column, has_text: Column) -> Column:
    """Tokens of an image: 85 and 50 for each megapixel, half as many again with text."""
    return ((85 + (width * height / (1024 * 1024) * 50).cast("int")) * F.when(has_text, 1.5).otherwise(1.0)).cast("int")


def output_tokens(task: Column, inputs: Column) -> Column:
    return F.least(F.greatest(F.lit(50), (inputs * by_value(task, TASK_OUTPUT, F.lit(1.0))).cast("int")), F.lit(2000))


def document_cost(inputs: Column, outputs: Column, input_price: Column, output_price: Column) -> Column:
    return inputs / 1000 * input_price + outputs / 1000 * output_price


def local_model_scores(models: DataFrame, largest: str = "large") -> DataFrame:
    """Score of the available models up to a size: 0.3 if loaded, 0.2 of smallness, and, if tried, 0.3 of the success rate and 0.2 of the confidence."""
    place = F.array_position(F.array(*map(F.lit, SIZES)), F.col("size")) - 1
    tried = F.when(F.col("requests") > 0, 0.3 * F.col("successes") / F.col("requests") + 0.2 * F.col("confidence")).otherwise(0.0)
    score = F.when(F.col("loaded"), 0.3).otherwise(0.0) + 0.2 * (len(SIZES) - place) / len(SIZES) + tried
    return models.filter(F.col("available") & (place <= SIZES.index(largest))).withColumn("score", score)


def cheapest_able(models: DataFrame, most_price: float | None = None, prefer: tuple[str, ...] = (), best: bool = False) -> DataFrame:
    """The first preferred model, else the cheapest or (best) the one of highest quality, of the able ones below a price."""
    able = models.filter(F.col("vision") & F.col("available") & (F.col("price") <= most_price if most_price is not None else F.lit(True)))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, prefer)).cast("array<string>"), F.col("model")), F.lit(0)), F.lit(len(prefer) + 1))
    return able.orderBy(rank, F.desc("quality") if best else F.col("price"), "model").limit(1)


def suggest_tags(docs: DataFrame) -> DataFrame:
    """difficulty by the number of entities; domain by their types and the file's name (entities: array of types)."""
    n, types, name = F.size("entities"), F.col("entities"), F.lower("name")
    has = lambda t: F.array_contains(types, t)
    by_type = F.when(has("SSN") | has("ID_NUMBER"), "HR").when(has("ORGANIZATION") & has("ADDRESS"), "Finance").otherwise("General")
    by_name = F.when(any_of(name, ("medical", "health", "patient")), "Healthcare").when(any_of(name, ("legal", "contract", "agreement")), "Legal").when(any_of(name, ("financial", "bank", "invoice")), "Finance")
    return docs.withColumns({"difficulty": F.when(n > 10, "High").when(n > 5, "Medium").otherwise("Low"), "domain": F.coalesce(by_name, by_type)})


def content_factor(kind: Column, size: Column, color: Column) -> Column:
    """Mean of the complexities of file type, size (10 MB are 1) and colour."""
    megabytes = F.when(size > 0, size / (1024 * 1024)).otherwise(1.0)
    return (by_value(F.lower(kind), TYPE_COMPLEXITY, F.lit(0.5)) + F.least(megabytes / 10, F.lit(1.0)) + color) / 3


def seconds_estimate(level: Column, special: Column, image: Column) -> Column:
    return by_value(level, LEVEL_SECONDS) * F.when(special > 0.8, 1.3).otherwise(1.0) * F.when(image > 0.8, 1.2).otherwise(1.0)


def insights(overview: DataFrame, by_model: DataFrame) -> DataFrame:
    """A row for each rule that holds: rule, severity and value. overview has one row; by_model one for each model."""
    models = by_model.agg(F.max("accuracy_mean").alias("top"), F.min("accuracy_mean").alias("bottom"), ratio(F.stddev_samp("cost_mean"), F.avg("cost_mean")).alias("cost_cv"), F.count("*").alias("k"), F.max("cost_mean").alias("dearest"))
    rules = (
        ("high_accuracy", "info", F.col("accuracy") >= 0.9, F.col("accuracy")), ("low_accuracy", "high", F.col("accuracy") < 0.7, F.col("accuracy")), ("success_rate", "high", F.col("success_rate") < 0.95, F.col("success_rate")),
        ("accuracy_gap", "medium", F.col("top") - F.col("bottom") > 0.2, F.col("top") - F.col("bottom")), ("cost_variation", "medium", F.col("cost_cv") > 0.5, F.col("cost_cv")), ("expensive_model", "medium", F.col("dearest") > 0.05, F.col("dearest")), ("many_models", "info", F.col("k") > 5, F.col("k").cast("double")),
    )
    found = F.filter(F.array(*(F.when(test, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), v.alias("value"))) for n, s, test, v in rules)), lambda x: x.isNotNull())
    return overview.crossJoin(models).select(F.inline(found))


def backups(inventory: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Number, bytes and expired backups of each kind."""
    old = F.col("created_at") < as_of - F.expr(f"INTERVAL {days} DAYS")
    return inventory.groupBy("kind").agg(F.count("*").alias("backups"), F.sum("bytes").alias("bytes"), F.count_if(old).alias("expired"))
