"""Spans from the nested JSON of a model's answer, placed in the text that the model was shown.

All of it happens inside the answer's own row: the JSON becomes a VARIANT, its leaves an array with their paths, each leaf a typed
span, and each span takes the next place in the text where its value stands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import FIELD_TYPES, json_block

#: Containers inside containers that are followed; what lies deeper is one value, as JSON.
DEPTH = 6

#: Confidence of a value by its type.
ANSWER_SCORES = {"EMAIL": 0.95, "PHONE": 0.90, "PERSON": 0.85, "ADDRESS": 0.80, "ID_NUMBER": 0.90, "ORGANIZATION": 0.75, "DATE": 0.70}
DEFAULT_ANSWER_SCORE = 0.70

_LEAF = "array<struct<keys:array<string>,path:string,value:variant>>"
_ENTRIES = "array<struct<key:string,step:string,value:variant>>"


def _leaves(keys: str, path: str, value: str, depth: int) -> str:
    """SQL for the leaves under a VARIANT: the keys that lead there, the path, the value. Null values and empty containers have none."""
    leaf = f"CASE WHEN {value} IS NULL OR is_variant_null({value}) THEN cast(array() AS {_LEAF}) ELSE cast(array(named_struct('keys', {keys}, 'path', {path}, 'value', {value})) AS {_LEAF}) END"
    if not depth:
        return leaf
    kind = f"schema_of_variant({value})"
    of_object = f"transform(map_entries(try_variant_get({value}, '$', 'map<string,variant>')), o{depth} -> named_struct('key', o{depth}.key, 'step', concat('.', o{depth}.key), 'value', o{depth}.value))"
    of_array = f"transform(try_variant_get({value}, '$', 'array<variant>'), (a{depth}, i{depth}) -> named_struct('key', cast(null AS string), 'step', concat('[', i{depth}, ']'), 'value', a{depth}))"
    entries = f"CASE WHEN {kind} LIKE 'OBJECT%' THEN cast({of_object} AS {_ENTRIES}) ELSE cast({of_array} AS {_ENTRIES}) END"
    e = f"e{depth}"
    inner = _leaves(f"CASE WHEN {e}.key IS NULL THEN {keys} ELSE concat({keys}, array({e}.key)) END", f"concat({path}, {e}.step)", f"{e}.value", depth - 1)
    return f"CASE WHEN {kind} LIKE 'OBJECT%' OR {kind} LIKE 'ARRAY%' THEN flatten(transform({entries}, {e} -> {inner})) ELSE {leaf} END"


def leaves(value: str, depth: int = DEPTH) -> Column:
    """The leaves of a VARIANT column: an array of (keys, path, value)."""
    return F.expr(_leaves("cast(array() AS array<string>)", "'$'", value, depth))


def field_type(keys: Column, types: dict[str, str] = FIELD_TYPES) -> Column:
    """The type of the last key that has one; else the last key in capitals."""
    known = F.create_map(*(F.lit(x) for kv in types.items() for x in kv))
    found = F.filter(F.transform(keys, lambda k: F.try_element_at(known, F.lower(k))), lambda t: t.isNotNull())
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.upper(F.try_element_at(keys, F.lit(-1))))


def placed(text: Column, value: Column, nth: Column) -> Column:
    """Where value stands in text for the nth time, from 0, each behind the one before; null if it doesn't. Case counts unless only another case is there."""
    width = F.greatest(F.length(value), F.lit(1))

    def at(body: Column, what: Column) -> Column:
        last = F.aggregate(F.sequence(F.lit(1), nth), F.lit(0), lambda p, k: F.when((k > 1) & (p == 0), 0).otherwise(F.call_function("locate", what, body, F.when(k == 1, 1).otherwise(p + width))))
        return F.when(last > 0, last - 1)

    return F.coalesce(at(text, value), at(F.lower(text), F.lower(value)))


def answer_spans(answers: DataFrame, text: str = "text", answer: str = "answer", key: Sequence[str] = ("doc_id",), depth: int = DEPTH) -> DataFrame:
    """Spans of answers such as {"extracted_information": {"names": [..], "contact_info": {"emails": [..]}}}, in a fence or not.

    Each leaf below extracted_information, at any depth up to `depth`, is a span: pii_type that of the nearest key that has one, field the key, path its
    place in the answer, text its value without outer space. start_pos and end_pos are where the value stands in the text: equal values take
    one place after another; null if the text lacks it. Blank values, null values and answers that are no JSON give none; a null text places nothing.
    """
    parsed = F.try_parse_json(json_block(F.col(answer)))
    rows = answers.select(*key, F.col(text).alias("_body"), parsed.alias("_json"))
    rows = rows.select(*key, "_body", F.expr("try_variant_get(_json, '$.extracted_information', 'variant')").alias("_info"))
    rows = rows.withColumn("_leaf", leaves("_info", depth)).select(*key, "_body", F.transform("_leaf", lambda x: F.struct(x["keys"].alias("keys"), x["path"].alias("path"), F.trim(_as_text(x["value"])).alias("text"))).alias("_leaf"))
    rows = rows.withColumn("_leaf", F.filter("_leaf", lambda x: (x["text"] != "") & (F.size(x["keys"]) > 0)))
    nth = F.transform("_leaf", lambda x, i: F.size(F.filter(F.slice("_leaf", F.lit(1), i + 1), lambda y: y["text"] == x["text"])))
    rows = rows.select(*key, "_body", F.explode(F.arrays_zip(F.col("_leaf").alias("leaf"), nth.alias("nth"))).alias("x"))
    value = F.col("x.leaf.text")
    rows = rows.select(*key, value.alias("text"), field_type(F.col("x.leaf.keys")).alias("pii_type"), F.try_element_at(F.col("x.leaf.keys"), F.lit(-1)).alias("field"), F.col("x.leaf.path").alias("path"), placed(F.col("_body"), value, F.col("x.nth")).alias("start_pos"))
    score = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ANSWER_SCORES.items() for x in kv)), F.col("pii_type")), F.lit(DEFAULT_ANSWER_SCORE))
    return rows.select("*", (F.col("start_pos") + F.length("text")).alias("end_pos"), score.alias("confidence"), F.lit("llm").alias("extractor"))


def _as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")
