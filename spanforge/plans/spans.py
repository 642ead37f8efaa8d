"""Queries over spans: extraction, post-processing, votes, evaluation and protection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import ensemble as N
from ..operators import evaluate as V
from ..operators import extract as E
from ..operators import privacy as P
from ..operators import spans as S
from ..sources.sinks import checkpointed
from .tables import documents as docs
from .tables import spread, table

SCORE = {"confidence": 6}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines that add in another order agree."""
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def o118_rule_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.rule_spans(docs(spark, sf_dir), key=("doc_id", "lang", "source")).drop("context"))


def o119_dictionary_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a card for each customer, as no document holds any of the dictionaries' terms."""
    card = F.concat(F.lit("Account number: "), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(" of "), "c_name", F.lit(". Contact by e-mail or phone; badge "), (F.col("c_nationkey") + 1000).cast("string"), F.lit(", MRN: "), (F.col("c_custkey") + 7000000).cast("string"), F.lit(", numéro d'employé "), "c_mktsegment", F.lit("."))
    cards = spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("doc_id"), card.alias("text"))
    return rounded(E.dictionary_spans(cards, types=None).drop("context"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rule_spans(docs(spark, sf_dir))


def _with_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each with the array of its rule spans."""
    return E.with_rule_spans(docs(spark, sf_dir).select("doc_id", "text"))


def _stored_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule spans written once, for queries that hold them against others made of them: texts are searched a single time."""
    return checkpointed(_spans(spark, sf_dir))


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubled(_spans(spark, sf_dir))


def _doubled(one: DataFrame) -> DataFrame:
    """Rule spans, and a second extractor that has missed every third and is less sure of the others."""
    own = F.struct("confidence", "extractor", F.lit(0).alias("extractor_rank"))
    less = F.struct((F.col("confidence") - 0.25).alias("confidence"), F.lit("second").alias("extractor"), F.lit(1).alias("extractor_rank"))
    found = F.array_compact(F.array(own, F.when((F.col("doc_id") + F.col("start_pos")) % 3 != 0, less)))
    both = one.withColumn("found", F.explode(found))
    return both.withColumns({c: F.col(f"found.{c}") for c in ("confidence", "extractor", "extractor_rank")}).select(*one.columns, "extractor_rank")


def o026_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.threshold_sweep(_spans(spark, sf_dir), [0.5, 0.6, 0.7, 0.8, 0.9])


def o027_role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = S.for_role(_spans(spark, sf_dir), "hr_manager")
    return rounded(seen.select("doc_id", "start_pos", "pii_type", "text", "confidence", "redaction"))


def o061_extraction_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.statistics(_spans(spark, sf_dir)))


def o118_type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans and confidence by language and type."""
    return rounded(S.type_histogram(E.rule_spans(docs(spark, sf_dir), key=("doc_id", "lang")), ["lang"]))


def o131_first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.first_of_each(_two(spark, sf_dir)).select("doc_id", "text", "pii_type", "confidence", "start_pos", "extractor"))


def o131_dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _two(spark, sf_dir)
    return S.dedup_counts(both, S.first_of_each(both))


def o132_best_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.best_of_each(_two(spark, sf_dir)).select("doc_id", "pii_type", "text", "confidence", "start_pos", "votes"))


def o134_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).withColumn("kind", S.upper_type(F.col("pii_type")))
    return spans.groupBy("kind").agg(F.count("*").alias("spans"), F.count_if(S.quality_gate(F.col("kind"), F.col("text"))).alias("good"))


def o135_content_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans as a model that gives no confidence would name them, with the one that their content allows."""
    kind = S.upper_type(F.col("pii_type"))
    spans = _spans(spark, sf_dir).select("doc_id", "start_pos", kind.alias("kind"), "text")
    return rounded(spans.withColumn("confidence", S.content_confidence(F.col("kind"), F.col("text"))))


def o136_similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.group_similar(_two(spark, sf_dir)))


def _vote(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        voted = N.vote(N.group_similar(_two(spark, sf_dir)), method, {"second": 0.5})
        return rounded(voted.select("doc_id", "pii_type", "text", "confidence", "start_pos", "votes"))

    run.__name__ = f"o137_vote_{method}"
    return run


def _exact_vote(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(N.exact_vote(_two(spark, sf_dir), method).select("doc_id", "pii_type", "text", "confidence", "start_pos", "votes"))

    run.__name__ = f"o138_exact_{method}"
    return run


def _truth_of(spans: DataFrame) -> DataFrame:
    """Ground truth: rule spans with some left out, some moved by a character and some under another name."""
    h = F.pmod(F.col("doc_id") * 7 + F.col("start_pos"), F.lit(10))
    spans = spans.filter(h != 0)
    return spans.withColumns({"start_pos": F.when(h == 1, F.col("start_pos") + 1).otherwise(F.col("start_pos")), "pii_type": F.when((h == 2) & (F.col("pii_type") == "person_name"), "individual").otherwise(F.col("pii_type"))})


def _with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their rule spans and, made of these, the ground truth of _truth_of(): one extraction, both in the row."""

    def true(s: Column) -> Column:
        h = F.pmod(F.col("doc_id") * 7 + s["start_pos"], F.lit(10))
        start = F.when(h == 1, s["start_pos"] + 1).otherwise(s["start_pos"])
        kind = F.when((h == 2) & (s["pii_type"] == "person_name"), "individual").otherwise(s["pii_type"])
        return F.struct(start.alias("start_pos"), s["end_pos"].alias("end_pos"), s["text"].alias("text"), kind.alias("pii_type"))

    known = F.filter("spans", lambda s: F.pmod(F.col("doc_id") * 7 + s["start_pos"], F.lit(10)) != 0)
    return _with_spans(spark, sf_dir).select("doc_id", "spans", F.transform(known, true).alias("truth"))


def o142_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.match_in_row(_with_truth(spark, sf_dir)))


def o143_rates_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.rates(V.counts_in_row(_with_truth(spark, sf_dir))))


def o145_overall_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.overall(V.counts_in_row(_with_truth(spark, sf_dir))))


def o148_redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.redact(_with_spans(spark, sf_dir), "spans")


def o148_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, text = F.col("pii_type"), F.col("text")
    return _spans(spark, sf_dir).select("doc_id", "start_pos", "pii_type", P.replacement(kind, text).alias("blocks"), P.replacement(kind, text, False).alias("label"))


def o149_role_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir).withColumn("kind", S.upper_type(F.col("pii_type")))
    views = (S.role_text(F.col("kind"), F.col("text"), F.lit(r)).alias(r) for r in ("partial", "full"))
    return spans.select("doc_id", "start_pos", "kind", "text", *views)


def o150_token_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.token_vault(_spans(spark, sf_dir), "pepper")


def o150_tokenized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.tokenize(_with_spans(spark, sf_dir), "spans", "pepper")


def o151_mixed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mixed(_with_spans(spark, sf_dir), "spans", "pepper")


def o152_noisy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _spans(spark, sf_dir).groupBy("pii_type").agg(F.count("*").alias("spans"))
    return P.laplace_counts(n, ["pii_type"], "spans", 1.0, "salt")


def o214_highlighted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.highlight(_with_spans(spark, sf_dir), "spans")


def o215_corrected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    h = F.pmod(F.col("doc_id") + F.col("start_pos"), F.lit(5))
    fixes = spans.filter(h < 3).select("doc_id", "start_pos", "end_pos", "pii_type", F.when(h == 0, "remove").when(h == 1, "recategorise").otherwise("retext").alias("action"), F.lit("organization").alias("new_type"), F.upper("text").alias("new_text"))
    return rounded(S.apply_corrections(spans, fixes).select("doc_id", "start_pos", "end_pos", "pii_type", "text", "confidence"))


def o216_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.accept(_spans(spark, sf_dir)))


# --- SQL -----------------------------------------------------------------------------------------


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _ascii(x: str) -> str:
    """RE2 knows ASCII words only: each other letter stands as _ in the searched copy and in patterns."""
    return re.sub(r"[^\x00-\x7f]", "_", x)


def _found(patterns: list[tuple[int, str, str]]) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, {n} AS pid, {q(k)} AS pii_type, string_split(regexp_replace(shadow, {q(_ascii(p))}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM s" for n, k, p in patterns)
    return f"""s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '_', 'g') AS shadow FROM documents),
p AS ({parts}),
u AS (SELECT doc_id, pid, pii_type, parts[i] AS part, i FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM p WHERE len(parts) > 1)),
w AS (SELECT *, coalesce(sum(length(part) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, pid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start_pos FROM u),
found AS (SELECT w.doc_id, d.text AS whole, d.lang, d.source, pid, pii_type, start_pos, (start_pos + length(split_part(part, chr(2), 1)))::INT AS end_pos, substr(d.text, start_pos + 1, length(split_part(part, chr(2), 1))) AS text
  FROM w JOIN documents d USING (doc_id) WHERE i > 1)"""


def _near(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(near, {q(w)})" for w in words) + ")"


_DIGITS = "regexp_replace(text, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN substr({_DIGITS}, i, 1)::INT ELSE (2 * substr({_DIGITS}, i, 1)::INT) // 10 + (2 * substr({_DIGITS}, i, 1)::INT) % 10 END)) % 10 = 0"
_RULES = [(n, k, ("(?i)" if i else "") + p) for n, (k, i, p) in enumerate(fixed.RULES) if k in fixed.SPAN_TYPES]
_BASE = "CASE pii_type " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in fixed.RULE_SCORES.items()) + " END"
_HELP = " OR ".join(f"(pii_type = {q(k)} AND {_near(w)})" for k, w in fixed.RULE_KEYWORDS.items())
RULE_SPANS_SQL = f"""{_found(_RULES)},
near AS (SELECT DISTINCT doc_id, lang, source, pii_type, text, start_pos, end_pos, lower(substr(whole, greatest(start_pos - 100, 0) + 1, (start_pos + length(text) + 100 - greatest(start_pos - 100, 0)))) AS near FROM found WHERE length(text) >= 2),
scored AS (SELECT *, CASE WHEN pii_type = 'person_name' AND text IN ({", ".join(map(q, fixed.PLACEHOLDER_NAMES))}) THEN 0.2::DOUBLE WHEN {_HELP} THEN least({_BASE} + 0.1::DOUBLE, 1::DOUBLE) ELSE {_BASE} END AS confidence FROM near),
spans AS (SELECT doc_id, lang, source, text, pii_type, round(confidence, 6) AS confidence, start_pos, end_pos, 'rule_based' AS extractor FROM scored WHERE CASE pii_type
  WHEN 'email_address' THEN contains(text, '@') AND contains(regexp_extract(text, '[^@]*$'), '.')
  WHEN 'phone_number' THEN length({_DIGITS}) BETWEEN 10 AND 15
  WHEN 'credit_card_number' THEN length({_DIGITS}) IN (13, 14, 15, 16, 19) AND {_LUHN}
  WHEN 'social_security_number' THEN length({_DIGITS}) BETWEEN 9 AND 10 ELSE true END)"""

_TERMS = [(n, k, p) for n, (k, p) in enumerate((d[1], p) for d in fixed.DICTIONARIES for p in [*(rf"(?i)\b{re.escape(t)}\b" for t in d[3]), *(f"(?i){p}" for p in d[4])])]
_DSCORE = "CASE pii_type " + " ".join(f"WHEN {q(d[1])} THEN CASE WHEN {_near(d[5])} THEN least({d[2]}::DOUBLE + 0.1::DOUBLE, 1::DOUBLE) ELSE {d[2]}::DOUBLE END" for d in fixed.DICTIONARIES) + " END"
_DNAME = "CASE pii_type " + " ".join(f"WHEN {q(d[1])} THEN {q(d[0])}" for d in fixed.DICTIONARIES) + " END"
DICTIONARY_SPANS_SQL = f"""{_found(_TERMS)},
near AS (SELECT DISTINCT doc_id, pii_type, trim(text) AS text, start_pos, end_pos, lower(substr(whole, greatest(start_pos - 100, 0) + 1, (start_pos + length(trim(text)) + 100 - greatest(start_pos - 100, 0)))) AS near FROM found WHERE length(trim(text)) >= 2),
spans AS (SELECT doc_id, text, pii_type, start_pos, end_pos, 'dictionary' AS extractor, {_DNAME} AS dictionary,
  round({_DSCORE} * CASE WHEN regexp_matches(text, '^[0-9]+$|^[a-zA-Z]+$') THEN 0.8::DOUBLE ELSE 1::DOUBLE END, 6) AS confidence FROM near
  WHERE CASE pii_type WHEN 'medical_record_number' THEN regexp_matches(text, '[0-9]') WHEN 'financial_account' THEN regexp_matches(text, '[0-9]{{4,}}') ELSE true END)"""

R = f"WITH {RULE_SPANS_SQL} "
_BOTH = """, two AS (SELECT *, 0 AS rank FROM spans UNION ALL SELECT * REPLACE (confidence - 0.25::DOUBLE AS confidence, 'second' AS extractor), 1 FROM spans WHERE (doc_id + start_pos) % 3 <> 0)"""
_UPPER = "CASE pii_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in S.UPPER_TYPES.items()) + " ELSE upper(pii_type) END"
_CATEGORY = f"CASE {_UPPER} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in S.CATEGORIES.items()) + " ELSE 'identity' END"
_LABEL = "CASE pii_type " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in P.LABELS.items()) + " ELSE '[' || upper(pii_type) || ']' END"
_PARTS = "regexp_extract_all(text, '\\S+')"
_FIRST_OF = f"{R}{_BOTH}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, pii_type ORDER BY rank, start_pos, end_pos) AS n FROM two)"
_EXACT = f"""{R}{_BOTH}, g AS (SELECT doc_id, pii_type, arg_max({{'t': text, 'c': confidence, 's': start_pos}}, row(confidence, -rank, -start_pos, -end_pos)) AS b, count(*) AS votes, avg(confidence) AS mean FROM two GROUP BY doc_id, lower(text), pii_type)
SELECT doc_id, pii_type, b.t AS text, round(@score, 6) AS confidence, b.s AS start_pos, votes FROM g WHERE @wins"""
#: Confidences in millionths, whose sum is exact in any order, and their mean, halves rounded away from 0.
_TOTAL = "sum(round(confidence * 1000000)::BIGINT)::BIGINT"
_MEAN = "(sign(total) * ((2 * abs(total) + {n}) // (2 * {n})) / 1000000::DOUBLE)"
# Steps that depend on those before are recursions in SQL: a row for each step of a group, with lists of what was taken so far.
_R = "WITH RECURSIVE " + RULE_SPANS_SQL.replace("round(confidence, 6) AS confidence", "confidence")


def _words(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> ''))"


def _jaccard(a: str, b: str) -> str:
    """Of two structs or rows with text and words."""
    union = f"len(list_distinct(list_concat({a}.words, {b}.words)))"
    return f"CASE WHEN trim(lower({a}.text)) = trim(lower({b}.text)) OR {union} = 0 THEN 1::DOUBLE ELSE len(list_intersect({a}.words, {b}.words))::DOUBLE / {union} END"


_LIKE = f"""({_jaccard("x", "q")}) >= 0.8::DOUBLE AND (least(x.start_pos, x.end_pos, q.start_pos, q.end_pos) <= 0 OR
  (least(x.end_pos, q.end_pos) > greatest(x.start_pos, q.start_pos) AND least(x.end_pos, q.end_pos) - greatest(x.start_pos, q.start_pos) > (x.end_pos - x.start_pos + q.end_pos - q.start_pos) / 2::DOUBLE * 0.5::DOUBLE))"""
_GROUPED = f"""{_R}{_BOTH},
q AS (SELECT *, {_words("text")} AS words, row_number() OVER (PARTITION BY doc_id, pii_type ORDER BY rank, start_pos, end_pos, text) AS n FROM two),
walk AS (SELECT DISTINCT doc_id, pii_type, 0::BIGINT AS n, []::STRUCT(text VARCHAR, words VARCHAR[], start_pos INT, end_pos INT)[] AS seeds, -1::BIGINT AS grp FROM q
  UNION ALL SELECT doc_id, pii_type, n, CASE WHEN spot = 0 THEN list_append(seeds, {{'text': text, 'words': words, 'start_pos': start_pos, 'end_pos': end_pos}}) ELSE seeds END, CASE WHEN spot = 0 THEN len(seeds) ELSE spot - 1 END
  FROM (SELECT q.*, walk.seeds, coalesce(list_position(list_transform(walk.seeds, lambda x: {_LIKE}), true), 0) AS spot FROM walk JOIN q ON q.doc_id = walk.doc_id AND q.pii_type = walk.pii_type AND q.n = walk.n + 1)),
g AS (SELECT q.*, walk.grp::INT AS grp FROM q JOIN walk USING (doc_id, pii_type, n))"""
_VOTED = f"""{_GROUPED}, seen AS (SELECT doc_id, count(DISTINCT extractor) AS extractors FROM g GROUP BY doc_id),
v AS (SELECT doc_id, pii_type, grp, arg_max({{'t': text, 'c': confidence, 's': start_pos}}, row(confidence, -rank, -start_pos, -end_pos)) AS b, count(*) AS votes,
  sum(weight * confidence) / sum(weight) AS mean FROM (SELECT *, CASE WHEN extractor = 'second' THEN 0.5::DOUBLE ELSE 1::DOUBLE END * confidence AS weight FROM g) GROUP BY ALL)
SELECT doc_id, pii_type, b.t AS text, round(@score, 6) AS confidence, b.s AS start_pos, votes FROM v JOIN seen USING (doc_id) WHERE @wins"""

_KIND = "CASE pii_type WHEN 'address' THEN 'location' ELSE pii_type END"
_PLACE = "row_number() OVER (PARTITION BY doc_id, kind ORDER BY start_pos, end_pos, text)"
_IOU = "coalesce(greatest(least(p.end_pos, t.end_pos) - greatest(p.start_pos, t.start_pos), 0)::DOUBLE / nullif(p.end_pos - p.start_pos + t.end_pos - t.start_pos - greatest(least(p.end_pos, t.end_pos) - greatest(p.start_pos, t.start_pos), 0), 0), 0)"
_MATCHED = f"""{_R},
said AS (SELECT *, {_PLACE} AS i FROM (SELECT doc_id, {_KIND} AS kind, start_pos, end_pos, text, {_words("text")} AS words FROM spans)),
true_ AS (SELECT *, {_PLACE} AS j FROM (SELECT doc_id, {_KIND} AS kind, start_pos + CASE WHEN (doc_id * 7 + start_pos) % 10 = 1 THEN 1 ELSE 0 END AS start_pos, end_pos, text, {_words("text")} AS words FROM spans WHERE (doc_id * 7 + start_pos) % 10 <> 0)),
pair AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY i, score DESC, j) AS n FROM (
  SELECT p.doc_id, p.kind, i, j, 0.3::DOUBLE + 0.4::DOUBLE * {_IOU} + 0.3::DOUBLE * ({_jaccard("p", "t")}) AS score FROM said p JOIN true_ t ON p.doc_id = t.doc_id AND p.kind = t.kind) WHERE score > 0.5::DOUBLE),
walk AS (SELECT DISTINCT doc_id, kind, 0::BIGINT AS n, []::BIGINT[] AS ps, []::BIGINT[] AS ts FROM pair
  UNION ALL SELECT pair.doc_id, pair.kind, pair.n, CASE WHEN list_contains(ps, i) OR list_contains(ts, j) THEN ps ELSE list_append(ps, i) END, CASE WHEN list_contains(ps, i) OR list_contains(ts, j) THEN ts ELSE list_append(ts, j) END
  FROM walk JOIN pair ON pair.doc_id = walk.doc_id AND pair.kind = walk.kind AND pair.n = walk.n + 1),
m AS (SELECT doc_id, kind, unnest(ps) AS i, unnest(ts) AS j FROM (SELECT doc_id, kind, arg_max(ps, n) AS ps, arg_max(ts, n) AS ts FROM walk GROUP BY ALL))"""
_COUNTED = f"""{_MATCHED},
c AS (SELECT kind, sum(tp)::BIGINT AS tp, sum(p - tp)::BIGINT AS fp, sum(t - tp)::BIGINT AS fn FROM (SELECT kind, 0 AS tp, 1 AS p, 0 AS t FROM said UNION ALL SELECT kind, 0, 0, 1 FROM true_ UNION ALL SELECT kind, 1, 0, 0 FROM m) GROUP BY kind)"""
_RATES = "round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tp::DOUBLE / nullif(tp + fp + fn, 0), 0), 6) AS accuracy, round(coalesce(2::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"

_BLOCKS = f"""CASE
  WHEN pii_type = 'email_address' AND len(string_split(text, '@')) = 2 THEN repeat('█', length(split_part(text, '@', 1))) || '@' || repeat('█', length(split_part(text, '@', 2)))
  WHEN pii_type = 'phone_number' THEN regexp_replace(text, '[0-9]', '█', 'g')
  WHEN pii_type = 'credit_card_number' THEN list_aggregate(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN regexp_matches(substr(text, i, 1), '[0-9]') AND length(regexp_replace(substr(text, i + 1), '[^0-9]', '', 'g')) >= 4 THEN '█' ELSE substr(text, i, 1) END), 'string_agg', '')
  WHEN length({_LABEL}) = length(text) THEN {_LABEL} ELSE repeat('█', length(text)) END"""
_TOKEN = "'TOK_' || upper(pii_type) || '_' || substr(sha256('pepper' || pii_type || '|' || text), 1, 16)"


def _rewritten(put: str) -> str:
    """Texts with the spans that stay where they overlap replaced."""
    return f"""{_R},
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, end_pos - start_pos DESC, start_pos, pii_type) AS n FROM spans WHERE end_pos > start_pos),
walk AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, []::STRUCT(s INT, e INT, n BIGINT)[] AS kept FROM q
  UNION ALL SELECT q.doc_id, q.n, CASE WHEN len(list_filter(kept, lambda k: k.s < q.end_pos AND q.start_pos < k.e)) > 0 THEN kept ELSE list_append(kept, {{'s': q.start_pos, 'e': q.end_pos, 'n': q.n}}) END
  FROM walk JOIN q ON q.doc_id = walk.doc_id AND q.n = walk.n + 1),
k AS (SELECT doc_id, unnest(arg_max(kept, n)).n AS n FROM walk GROUP BY doc_id),
cut AS (SELECT doc_id, start_pos, end_pos, {put} AS put, coalesce(lag(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos), 0) AS before FROM q JOIN k USING (doc_id, n)),
whole AS (SELECT doc_id, string_agg(substr(d.text, before + 1, start_pos - before) || put, '' ORDER BY start_pos) || substr(any_value(d.text), max(end_pos) + 1) AS text FROM cut JOIN documents d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(whole.text, d.text) AS text FROM documents d LEFT JOIN whole USING (doc_id)"""


QUERIES = {
    f.__name__: f
    for f in (
        o118_rule_spans, o119_dictionary_spans, o026_threshold_sweep, o027_role_filter, o061_extraction_statistics, o118_type_histogram, o131_first_of_each, o131_dedup_counts, o132_best_of_each, o134_quality_gate, o135_content_confidence,
        o136_similar_groups, *map(_vote, ("majority", "weighted", "union", "consensus")), *map(_exact_vote, ("weighted", "union", "majority")), o142_matches, o143_rates_by_type, o145_overall_rates,
        o148_redacted_text, o148_replacements, o149_role_text, o150_token_vault, o150_tokenized_text, o151_mixed_text, o152_noisy_counts, o214_highlighted_text, o215_corrected_spans, o216_accepted,
    )
}
ORACLE_SQL = {
    "o026_threshold_sweep": R + "SELECT t::DOUBLE AS threshold, count(*) FILTER (WHERE confidence >= t::DOUBLE) AS spans FROM spans, (VALUES (0.5), (0.6), (0.7), (0.8), (0.9)) v(t) GROUP BY t",
    "o027_role_filter": R + f"SELECT doc_id, start_pos, pii_type, text, confidence, 'partial' AS redaction FROM spans WHERE confidence >= 0.75::DOUBLE AND {_CATEGORY} IN ('identity', 'contact', 'employment')",
    "o061_extraction_statistics": R + "SELECT doc_id, count(*) AS spans, count(DISTINCT pii_type) AS types, round(avg(confidence), 6) AS avg_confidence, round(min(confidence), 6) AS min_confidence, round(max(confidence), 6) AS max_confidence FROM spans GROUP BY doc_id",
    "o118_type_histogram": R + "SELECT lang, pii_type, count(*) AS spans, round(avg(confidence), 6) AS avg_confidence FROM spans GROUP BY ALL",
    "o131_first_of_each": _FIRST_OF + " SELECT doc_id, text, pii_type, round(confidence, 6) AS confidence, start_pos, extractor FROM f WHERE n = 1",
    "o131_dedup_counts": _FIRST_OF + " SELECT doc_id, count(*) AS before, count(*) FILTER (WHERE n = 1) AS after FROM f GROUP BY doc_id",
    "o132_best_of_each": R + _BOTH + """, g AS (SELECT doc_id, pii_type, arg_max({'t': text, 'c': confidence}, row(confidence, -rank, -start_pos, -end_pos)) AS b, min(row(rank, start_pos)) AS f, count(*) AS votes FROM two GROUP BY doc_id, lower(trim(text)), pii_type)
SELECT doc_id, pii_type, b.t AS text, round(b.c, 6) AS confidence, f[2] AS start_pos, votes FROM g""",
    "o134_quality_gate": R + f"""SELECT {_UPPER} AS kind, count(*) AS spans, count(*) FILTER (WHERE length(trim(text)) >= 2 AND CASE {_UPPER} WHEN 'EMAIL' THEN contains(text, '@') AND contains(text, '.') WHEN 'PHONE' THEN length({_DIGITS}) >= 10
  WHEN 'PERSON' THEN len({_PARTS}) >= 2 AND len(list_filter({_PARTS}, lambda p: regexp_matches(p, '^\\p{{L}}+$'))) >= len({_PARTS}) * 0.8 ELSE true END) AS good FROM spans GROUP BY ALL""",
    "o135_content_confidence": R + f"""SELECT doc_id, start_pos, kind, text, round(CASE kind
  WHEN 'EMAIL' THEN CASE WHEN contains(text, '@') AND contains(text, '.') THEN 0.98 ELSE 0.65 END
  WHEN 'PHONE' THEN CASE WHEN length({_DIGITS}) >= 10 THEN 0.95 ELSE 0.7 END
  WHEN 'PERSON' THEN CASE WHEN len({_PARTS}) >= 2 AND regexp_matches(replace(text, ' ', ''), '^\\p{{L}}+$') THEN 0.9 ELSE 0.7 END
  WHEN 'ADDRESS' THEN 0.8 WHEN 'ID_NUMBER' THEN 0.9 WHEN 'ORGANIZATION' THEN 0.75 ELSE 0.7 END::DOUBLE, 6) AS confidence
FROM (SELECT *, {_UPPER} AS kind FROM spans)""",
    "o138_exact_weighted": _EXACT.replace("avg(confidence) AS mean", f"{_TOTAL} AS total").replace("@score", _MEAN.format(n="votes")).replace("@wins", "votes = 1 OR total >= 700000 * votes"),
    "o138_exact_union": _EXACT.replace("@score", "b.c").replace("@wins", "true"),
    "o138_exact_majority": _EXACT.replace("@score", "b.c").replace("@wins", "votes > 1"),
    "o136_similar_groups": _GROUPED + " SELECT doc_id, pii_type, text, round(confidence, 6) AS confidence, start_pos, end_pos, extractor, rank AS extractor_rank, grp FROM g",
    "o137_vote_majority": _VOTED.replace("@score", "b.c").replace("@wins", "votes >= 2"),
    "o137_vote_weighted": _VOTED.replace("@score", "mean").replace("@wins", "mean >= 0.7::DOUBLE"),
    "o137_vote_union": _VOTED.replace("@score", "b.c").replace("@wins", "true"),
    "o137_vote_consensus": _VOTED.replace("@score", "b.c").replace("@wins", "votes::DOUBLE / extractors >= 0.8::DOUBLE"),
    "o142_matches": _MATCHED + """ SELECT m.doc_id, m.kind, p.start_pos AS p_start, p.end_pos AS p_end, p.text AS p_text, t.start_pos AS t_start, t.end_pos AS t_end, t.text AS t_text, round(score, 6) AS score
FROM m JOIN said p USING (doc_id, kind, i) JOIN true_ t USING (doc_id, kind, j) JOIN pair USING (doc_id, kind, i, j)""",
    "o143_rates_by_type": _COUNTED + f" SELECT kind, tp, fp, fn, {_RATES} FROM c",
    "o145_overall_rates": _COUNTED + f" SELECT tp, fp, fn, {_RATES} FROM (SELECT coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp, coalesce(sum(fn), 0)::BIGINT AS fn FROM c)",
    "o148_redacted_text": _rewritten(_BLOCKS),
    "o150_tokenized_text": _rewritten(_TOKEN),
    "o151_mixed_text": _rewritten(f"CASE WHEN pii_type IN ('social_security_number', 'credit_card_number') THEN {_BLOCKS} ELSE {_TOKEN} END"),
    "o214_highlighted_text": _rewritten("""'<mark data-type="' || pii_type || '">' || text || '</mark>'"""),
    "o148_replacements": R + f"SELECT doc_id, start_pos, pii_type, {_LABEL} AS label, {_BLOCKS} AS blocks FROM spans",
    "o149_role_text": R + f"""SELECT doc_id, start_pos, {_UPPER} AS kind, text, '[REDACTED_' || {_UPPER} || ']' AS "full", CASE {_UPPER}
  WHEN 'EMAIL' THEN CASE WHEN len(string_split(text, '@')) = 2 AND length(split_part(text, '@', 1)) > 2 THEN substr(text, 1, 1) || repeat('*', length(split_part(text, '@', 1)) - 2) || right(split_part(text, '@', 1), 1) || '@' || split_part(text, '@', 2) ELSE text END
  WHEN 'PHONE' THEN CASE WHEN length({_DIGITS}) >= 10 THEN replace(text, substr({_DIGITS}, 4, 4), '****') ELSE text END
  WHEN 'PERSON' THEN CASE WHEN len({_PARTS}) >= 2 THEN array_to_string({_PARTS}[1:len({_PARTS}) - 1], ' ') || ' ' || substr({_PARTS}[-1], 1, 1) || repeat('*', length({_PARTS}[-1]) - 1) ELSE text END ELSE text END AS partial FROM spans""",
    "o150_token_vault": R + "SELECT DISTINCT 'TOK_' || upper(pii_type) || '_' || substr(sha256('pepper' || pii_type || '|' || text), 1, 16) AS token, pii_type, text FROM spans",
    "o152_noisy_counts": R + """, n AS (SELECT pii_type, count(*) AS spans, (('0x' || substr(md5('salt|' || pii_type), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE - 0.5::DOUBLE AS u FROM spans GROUP BY ALL)
SELECT pii_type, spans, greatest(trunc(spans - sign(u) * ln(1 - 2 * abs(u)))::BIGINT, 0) AS noisy FROM n""",
    "o215_corrected_spans": R + """SELECT doc_id, start_pos, end_pos, CASE WHEN (doc_id + start_pos) % 5 = 1 THEN 'organization' ELSE pii_type END AS pii_type, CASE WHEN (doc_id + start_pos) % 5 = 2 THEN upper(text) ELSE text END AS text, confidence FROM spans WHERE (doc_id + start_pos) % 5 <> 0""",
    "o216_accepted": R + f", g AS (SELECT doc_id, count(*) AS spans, {_TOTAL} AS total FROM spans GROUP BY doc_id) SELECT doc_id, spans, round({_MEAN.format(n='spans')}, 6) AS mean, total >= 700000 * spans AS accepted FROM g",
    "o118_rule_spans": f"WITH {RULE_SPANS_SQL} SELECT * FROM spans",
    "o119_dictionary_spans": f"""WITH documents AS (SELECT c_custkey AS doc_id, 'Account number: ' || lpad(c_custkey::VARCHAR, 9, '0') || ' of ' || c_name || '. Contact by e-mail or phone; badge ' || (c_nationkey + 1000)::VARCHAR || ', MRN: ' || (c_custkey + 7000000)::VARCHAR || ', numéro d''employé ' || c_mktsegment || '.' AS text, NULL AS lang, NULL AS source FROM customer), {DICTIONARY_SPANS_SQL} SELECT doc_id, text, pii_type, confidence, start_pos, end_pos, extractor, dictionary FROM spans""",
}
