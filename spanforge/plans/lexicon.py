"""Queries of dictionaries as tables, of the tagger and of nested answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as W
from ..operators import extract as E
from ..operators import shaped as H
from ..operators import tagger as G
from ..operators import terms as T
from ..sources.files import FIELD_TYPES
from .ledger import rounded
from .spans import RULE_SPANS_SQL, q
from .tables import documents, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dictionaries of the words of the benchmark, as read_dictionaries gives them: pairs of words in any case, long words as written."""
    items = table(spark, sf_dir, "benchmark")
    pairs = F.array_distinct(F.flatten(F.collect_list(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+ \p{L}+"), F.lit(0)), lambda w: F.substring_index(w, " ", 1) != F.substring_index(w, " ", -1)))))
    long = F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit(r"\p{L}{9,}"), F.lit(0)))))
    both = items.agg(pairs.alias("pairs"), long.alias("long"))
    one = lambda name, terms, score, exact: F.struct(F.lit(name).alias("name"), F.lit(f"{name} of the benchmark").alias("description"), F.lit("organization").alias("pii_type"), terms.alias("terms"), F.array().cast("array<string>").alias("patterns"), F.lit(exact).alias("case_sensitive"), F.lit(True).alias("word_boundaries"), F.lit(score).alias("confidence_score"))
    return both.select(F.inline(F.array(one("pairs", F.col("pairs"), 0.8, False), one("long", F.col("long"), 0.7, True))))


_LISTED = r"""items AS (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+ \p{L}+')) AS term, 'pairs' AS dictionary FROM benchmark UNION ALL SELECT unnest(regexp_extract_all(text, '\p{L}{9,}')), 'long' FROM benchmark),
terms AS (SELECT DISTINCT * FROM items WHERE dictionary = 'long' OR split_part(term, ' ', 1) <> split_part(term, ' ', 2))"""
#: The signs of a text as words and what stands between, with their places.
_WORDS = r"""parts AS (SELECT doc_id, unnest(w) AS w, unnest(range(0, len(w))) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]') AS w FROM documents)),
words AS (SELECT *, sum(length(w)) OVER p - length(w) AS pos, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM parts WINDOW p AS (PARTITION BY doc_id ORDER BY k))"""


@query(f"""WITH {_LISTED}, {_WORDS},
found AS (SELECT doc_id, w || w1 || w2 AS text, pos, dictionary FROM words JOIN terms ON dictionary = 'pairs' AND lower(w) = split_part(term, ' ', 1) AND w1 = ' ' AND lower(w2) = split_part(term, ' ', 2)
  UNION ALL SELECT doc_id, w, pos, dictionary FROM words JOIN terms ON dictionary = 'long' AND w = term),
placed AS (SELECT f.doc_id, f.text, dictionary, pos::INT AS start_pos, (pos + length(f.text))::INT AS end_pos, lower(substr(d.text, greatest(pos - 100, 0)::INT + 1, (pos + length(f.text) + 100 - greatest(pos - 100, 0))::INT)) AS near FROM found f JOIN documents d USING (doc_id))
SELECT doc_id, text, start_pos, end_pos, dictionary, 'organization' AS pii_type,
  round((CASE WHEN contains(near, 'ment') THEN 1::DOUBLE + CASE dictionary WHEN 'pairs' THEN -0.1::DOUBLE ELSE -0.2::DOUBLE END ELSE CASE dictionary WHEN 'pairs' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END END) * CASE WHEN regexp_full_match(text, '[a-zA-Z]+') THEN 0.8::DOUBLE ELSE 1::DOUBLE END, 6) AS confidence FROM placed""")
def o206_term_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of dictionaries that are tables, near the keyword 'ment' a tenth surer."""
    terms = T.term_table(dictionaries(spark, sf_dir)).withColumn("keywords", F.array(F.lit("ment")))
    return rounded(T.term_spans(documents(spark, sf_dir), terms).drop("context", "extractor"))


@query(f"""WITH {_LISTED} SELECT dictionary AS name, dictionary || ' of the benchmark' AS description, 'organization' AS pii_type, count(*)::INT AS terms_count, 0 AS patterns_count, CASE dictionary WHEN 'pairs' THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS confidence_score, dictionary = 'long' AS case_sensitive, true AS word_boundaries FROM terms GROUP BY dictionary""")
def o206_dictionary_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.dictionary_info(dictionaries(spark, sf_dir))


@query("""WITH w AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, greatest(length(text) - 128 - 1, 0) + 1, 384)) AS pos FROM documents WHERE length(text) > 0)
SELECT doc_id, (pos // 384)::INT AS "window", pos::INT AS "at", substr(text, pos::INT + 1, 512) AS text, pos = 0 AS first, pos + 512 >= n AS last FROM w""")
def o120_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.windows(documents(spark, sf_dir))


def _held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def _tagged(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Spans of a tagger that has learnt the rules' spans of two thirds of the documents."""
    learnt = E.with_rule_spans(documents(spark, sf_dir).select("doc_id", "text").filter(~_held_out()))
    return G.stitched(G.tagged(G.windows(docs), G.fitted(G.counted(learnt))))


@query()
def o120_tagged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rounded(G.with_text(_tagged(spark, sf_dir, docs), docs).drop("context"))


@query()
def o120_tagger_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact agreement with the rules on the third of the documents not learnt from, by type. Of rule spans that overlap, the likelier counts."""
    docs = documents(spark, sf_dir).select("doc_id", "text").filter(_held_out())
    said = _tagged(spark, sf_dir, docs).select("doc_id", "pii_type", "start_pos", "end_pos", F.lit(1).alias("said"))
    ordered = F.array_sort("spans", lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(F.signum(a["start_pos"] - b["start_pos"]).cast("int")))
    kept = F.aggregate(ordered, F.slice("spans", 1, 0), lambda acc, s: F.when(F.exists(acc, lambda x: (x["start_pos"] < s["end_pos"]) & (s["start_pos"] < x["end_pos"])), acc).otherwise(F.concat(acc, F.array(s))))
    truth = E.with_rule_spans(docs).select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.pii_type", "s.start_pos", "s.end_pos", F.lit(1).alias("true"))
    both = said.join(truth, ["doc_id", "pii_type", "start_pos", "end_pos"], "full")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rows = both.groupBy("pii_type").agg(n((F.col("said") == 1) & (F.col("true") == 1)).alias("tp"), n(F.col("true").isNull()).alias("fp"), n(F.col("said").isNull()).alias("fn"))
    return rounded(rows.withColumn("f1", 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's spans as a model would tell them: nested JSON in a fence."""
    rows = E.with_rule_spans(documents(spark, sf_dir).select("doc_id", "text"))
    # out of a generator, so that the test of its size is not a second search
    rows = rows.select("doc_id", "text", F.explode(F.filter(F.array("spans"), lambda s: F.size(s) > 0)).alias("spans"))
    rows = rows.withColumn("spans", F.sort_array(F.transform("spans", lambda s: F.struct(s["start_pos"].alias("a"), s["end_pos"].alias("b"), s["pii_type"].alias("kind"), s["text"].alias("text")))))
    of = lambda kind: F.transform(F.filter("spans", lambda s: s["kind"] == kind), lambda s: s["text"])
    others = F.transform(F.filter("spans", lambda s: ~s["kind"].isin("person_name", "email_address", "phone_number")), lambda s: F.struct(s["text"].alias("id_numbers"), F.struct(s["kind"].alias("kind")).alias("about")))
    info = F.struct(of("person_name").alias("names"), F.struct(of("email_address").alias("emails"), of("phone_number").alias("phones")).alias("contact_info"), others.alias("records"))
    return rows.select("doc_id", "text", F.concat(F.lit("I found:\n```json\n"), F.to_json(F.struct(info.alias("extracted_information"))), F.lit("\n```\n")).alias("answer"))


_NTH = """CASE WHEN len(string_split({t}, {v})) > nth THEN list_sum(list_transform(list_slice(string_split({t}, {v}), 1, nth), lambda x: length(x))) + (nth - 1) * length({v}) END"""
_TYPED = "CASE " + " ".join(f"WHEN field = {q(k)} THEN {q(v)}" for k, v in FIELD_TYPES.items()) + " ELSE upper(field) END"


@query(f"""WITH {RULE_SPANS_SQL},
listed AS (SELECT doc_id, trim(text) AS text, pii_type, CASE pii_type WHEN 'person_name' THEN 1 WHEN 'email_address' THEN 2 WHEN 'phone_number' THEN 3 ELSE 4 END AS list, start_pos, end_pos, row_number() OVER (PARTITION BY doc_id, list ORDER BY start_pos, end_pos, pii_type, text) - 1 AS k FROM spans),
leaf AS (SELECT doc_id, text, list, k, 0 AS part, CASE list WHEN 1 THEN 'names' WHEN 2 THEN 'emails' WHEN 3 THEN 'phones' ELSE 'id_numbers' END AS field,
    CASE list WHEN 1 THEN '$.names[' || k || ']' WHEN 2 THEN '$.contact_info.emails[' || k || ']' WHEN 3 THEN '$.contact_info.phones[' || k || ']' ELSE '$.records[' || k || '].id_numbers' END AS path FROM listed
  UNION ALL SELECT doc_id, pii_type, list, k, -1, 'kind', '$.records[' || k || '].about.kind' FROM listed WHERE list = 4),
own AS (SELECT l.*, d.text AS body, row_number() OVER (PARTITION BY l.doc_id, l.text ORDER BY CASE list WHEN 1 THEN 3 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 4 END, k, part) AS nth FROM leaf l JOIN documents d USING (doc_id)),
placed AS (SELECT *, {_TYPED} AS pii_type, coalesce({_NTH.format(t="body", v="text")}, {_NTH.format(t="lower(body)", v="lower(text)")})::INT AS start_pos FROM own)
SELECT doc_id, text, pii_type, field, path, start_pos, start_pos + length(text)::INT AS end_pos,
  CASE pii_type WHEN 'EMAIL' THEN 0.95 WHEN 'PHONE' THEN 0.9 WHEN 'PERSON' THEN 0.85 WHEN 'ADDRESS' THEN 0.8 WHEN 'ID_NUMBER' THEN 0.9 WHEN 'ORGANIZATION' THEN 0.75 ELSE 0.7 END::DOUBLE AS confidence FROM placed""")
def o122_answer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.answer_spans(answers(spark, sf_dir)).drop("extractor")


_SECRET = "spring"
_DRAWN = f"""('0x' || substr(sha256('{_SECRET}|' || kind || '|0|0|' || @i || '|' || b), 1, 15))::BIGINT % pow(10, length(a))::BIGINT"""
_ROUNDS = ",\n".join(f"r{i + 1} AS (SELECT doc_id, start_pos, kind, text, b AS a, CASE WHEN a = '' THEN '' ELSE lpad(((a::BIGINT + {_DRAWN.replace('@i', str(i))}) % pow(10, length(a))::BIGINT)::VARCHAR, length(a)::INT, '0') END AS b FROM r{i})" for i in range(H.ROUNDS))


@query(f"""WITH {RULE_SPANS_SQL},
digits AS (SELECT doc_id, start_pos, pii_type AS kind, text, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM spans WHERE NOT regexp_matches(text, '[a-zA-Z]') AND regexp_matches(text, '[0-9].*[0-9]')),
r0 AS (SELECT doc_id, start_pos, kind, text, substr(d, 1, length(d) // 2) AS a, substr(d, length(d) // 2 + 1) AS b FROM digits),
{_ROUNDS}
SELECT doc_id, start_pos, kind AS pii_type, text, array_to_string(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN regexp_matches(substr(text, i::INT, 1), '[0-9]') THEN substr(a || b, length(regexp_replace(substr(text, 1, i::INT), '[^0-9]', '', 'g'))::INT, 1) ELSE substr(text, i::INT, 1) END), '') AS token, text AS back FROM r{H.ROUNDS}""")
def o150_shaped_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of spans as other numbers of their shape, and the numbers that these give back."""
    spans = E.rule_spans(documents(spark, sf_dir)).filter("NOT text rlike '[a-zA-Z]' AND text rlike '[0-9].*[0-9]'").select("doc_id", "start_pos", "pii_type", "text")
    tokens = H.shaped_spans(spans, _SECRET)
    return tokens.withColumn("back", H.shaped(F.col("token"), F.col("pii_type"), _SECRET, undo=True))
