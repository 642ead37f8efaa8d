"""Files as tables: discovery, metadata, text, and plug-in handlers by format.

Files are listed and read by Spark's binaryFile source, so any store that Spark reads will do, and
columns that are not asked for (the content above all) are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Content type of each file ending.
CONTENT_TYPES = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xls": "application/vnd.ms-excel", "txt": "text/plain", "csv": "text/csv", "json": "application/json",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "tiff": "image/tiff",
}
Handler = Callable[[bytes], str]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def discover(spark: SparkSession, folder: str, endings: Sequence[str] = tuple(CONTENT_TYPES), keep: Column | None = None, most_bytes: int | None = None) -> DataFrame:
    """path, modificationTime, length and content of the files below folder with one of the endings, in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.filter(extension(F.col("path")).isin(*endings))
    if most_bytes is not None:
        files = files.filter(F.col("length") <= most_bytes)
    return files if keep is None else files.filter(keep)


def not_processed(files: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """Files without a marker."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def metadata(files: DataFrame) -> DataFrame:
    """Name, ending, size, SHA-256 and content type of each file."""
    kinds = F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))
    ending = extension(F.col("path"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), ending.alias("file_type"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.coalesce(F.try_element_at(kinds, ending), F.lit("application/octet-stream")).alias("content_type"), "modificationTime")


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or have another hash than in an earlier snapshot of metadata()."""
    return now.join(before.select("path", "sha256"), ["path", "sha256"], "left_anti")


def enrich(texts: DataFrame, text: str = "text", name: str = "file_name") -> DataFrame:
    """Words, pages of 2000 characters (one at least), and whether the name speaks of ground truth."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    truth = F.rlike(F.lower(name), F.lit("ground_truth|labeled|annotated"))
    return texts.withColumns({"estimated_words": words, "estimated_pages": F.greatest(F.lit(1), F.floor(F.length(text) / 2000).cast("int")), "is_ground_truth": truth})


def read_text(files: DataFrame) -> DataFrame:
    """raw_text of text files (what is no UTF-8 is left out), the same as ocr_text, and counts."""
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    out = files.filter(extension(F.col("path")).isin("txt", "csv", "json")).select("path", text.alias("raw_text"))
    return out.withColumns({"ocr_text": F.col("raw_text"), "char_count": F.length("raw_text"), "line_count": F.size(F.split("raw_text", "\n", -1)), "word_count": F.size(F.filter(F.split("raw_text", r"\s+"), lambda w: w != ""))})


def read_with(files: DataFrame, handlers: Mapping[str, Handler]) -> DataFrame:
    """path, text and error of files whose ending has a handler (bytes to text); a handler's failure is that row's error.

    This is how PDF, word-processor, spreadsheet and image readers are plugged in.
    """
    schema = "path string, text string, error string"

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    out.append((path, handlers[path.rpartition(".")[2].lower()](content), None))
                except Exception as e:  # noqa: BLE001  any handler's failure belongs to its file
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["path", "text", "error"])

    return files.filter(extension(F.col("path")).isin(*handlers)).select("path", "content").mapInArrow(run, schema)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored extraction results (a JSON object for each document) as one row for each span."""
    schema = """document_id string, extraction_result struct<error:string, processing_time:double, pii_entities:array<struct<text:string, type:string, pii_type:string, confidence:double, start_pos:int, end_pos:int, context:string, extractor:string>>>"""
    rows = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)
    spans = rows.select("document_id", F.explode_outer("extraction_result.pii_entities").alias("e"))
    return spans.select("document_id", "e.text", F.coalesce("e.pii_type", "e.type").alias("pii_type"), "e.confidence", "e.start_pos", "e.end_pos", "e.context", "e.extractor")


def read_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """Dictionaries from JSON files, each an object or a list of them."""
    schema = "name string, description string, pii_type string, terms array<string>, patterns array<string>, case_sensitive boolean, word_boundaries boolean, confidence_score double"
    return spark.read.schema(schema).json(path, multiLine=True).filter("name is not null")


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of text and entities."""
    return spark.read.schema("id string, text string, entities array<struct<text:string, label:string, start:int, end:int>>").json(path)


def coerced(entities: DataFrame, column: str = "json") -> DataFrame:
    """Spans from JSON objects under any of the names that tools give the fields."""
    g = lambda *names: F.coalesce(*(F.get_json_object(column, f"$.{n}") for n in names))
    return entities.withColumns({"text": g("text", "value"), "pii_type": g("type", "pii_type", "label"), "start_pos": g("start_pos", "start").cast("int"), "end_pos": g("end_pos", "end").cast("int"), "confidence": F.coalesce(g("confidence", "score").cast("double"), F.lit(1.0))})


def json_block(text: Column) -> Column:
    """The JSON in a model's answer: inside a fence, or from the first brace to the last."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def model_answer_spans(answers: DataFrame, text: str = "answer", key: str = "doc_id") -> DataFrame:
    """Spans from answers of the form {"extracted_information": {field: value or [values]}}."""
    info = F.from_json(F.get_json_object(json_block(F.col(text)), "$.extracted_information"), "map<string,string>")
    rows = answers.select(key, F.explode(info).alias("field", "value"))
    many = F.from_json("value", "array<string>")
    rows = rows.select(key, "field", F.explode(F.when(F.col("value").startswith("["), many).otherwise(F.array("value"))).alias("text"))
    kind = F.create_map(*(F.lit(x) for kv in FIELD_TYPES.items() for x in kv))
    return rows.filter("text is not null and trim(text) <> ''").select(key, "text", F.coalesce(F.try_element_at(kind, F.lower("field")), F.upper("field")).alias("pii_type"), F.lit("llm").alias("extractor"))


#: Type of each field of a model's answer.
FIELD_TYPES = {
    "names": "PERSON", "emails": "EMAIL", "phone_numbers": "PHONE", "phones": "PHONE", "addresses": "ADDRESS", "dates": "DATE", "id_numbers": "ID_NUMBER", "organizations": "ORGANIZATION",
    "financial_information": "FINANCIAL", "medical_information": "MEDICAL", "employee_ids": "EMPLOYEE_ID",
}
