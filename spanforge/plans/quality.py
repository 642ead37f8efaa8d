"""Queries of quality, data sets, routing, batches and lookups."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analytics as A
from ..operators import extract as E
from ..operators import quality as Q
from ..operators import routing as R
from ..operators import spans as S
from .ledger import batch_documents, rounded
from .spans import RULE_SPANS_SQL, _UPPER
from .tables import LEDGER_SQL, PERFORMANCE_SQL, documents, ledger, performance, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


P = f"WITH {PERFORMANCE_SQL} "
RS = f"WITH {RULE_SPANS_SQL} "


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule spans with upper-case types and lower-case surroundings."""
    docs = documents(spark, sf_dir)
    spans = E.rule_spans(docs, key=("doc_id", "source"))
    return spans.withColumns({"kind": S.upper_type(F.col("pii_type")), "near": F.lower("context")})


# --- sources and predicates ----------------------------------------------------------------------


@query("""SELECT page_id, sha256(coalesce(html, '')) AS sha256, octet_length(encode(coalesce(html, ''))) AS bytes, CASE WHEN lower(html) LIKE '<!doctype html%' OR lower(html) LIKE '<html%' THEN 'text/html' WHEN html LIKE '{%' OR html LIKE '[%' THEN 'application/json' ELSE 'text/plain' END AS content_type FROM pages""")
def o002_page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, low = table(spark, sf_dir, "pages"), F.lower("html")
    kind = F.when(low.startswith("<!doctype html") | low.startswith("<html"), "text/html").when(F.col("html").startswith("{") | F.col("html").startswith("["), "application/json").otherwise("text/plain")
    body = F.coalesce("html", F.lit(""))
    return p.select("page_id", F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("long").alias("bytes"), kind.alias("content_type"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS words, greatest(1, length(text) // 2000) AS pages, length(text) AS chars, len(string_split(text, chr(10))) AS lines FROM documents")
def o003_text_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    words = F.size(F.filter(F.split("text", r"[ \t\n\r\f]+"), lambda w: w != "")).cast("long")
    return d.select("doc_id", words.alias("words"), F.greatest(F.lit(1), F.floor(F.length("text") / 2000)).cast("long").alias("pages"), F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))


@query("SELECT doc_id, i - 1 AS line, lines[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def o004_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


@query("SELECT d.doc_id, CASE WHEN length(coalesce(d.text, '')) < 50 THEN concat_ws(chr(10), nullif(d.text, ''), nullif(c.text, '')) ELSE d.text END AS text FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id AND c.turn = 0")
def o025_effective_whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its whole text, and the first turn of the conversation of its number where the text is short."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw"))
    c = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("ocr"))
    return d.join(c, "doc_id", "left").select("doc_id", E.effective_text(F.col("raw"), F.col("ocr")).alias("text"))


@query(P + "SELECT document_id, model, difficulty, round(cost, 6) AS cost FROM performance WHERE timestamp BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AND difficulty IN ('Easy', 'Hard') AND success AND cost BETWEEN 0.01 AND 0.05")
def o028_report_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = performance(spark, sf_dir).filter(F.col("timestamp").between(F.lit(datetime(1995, 1, 1)), F.lit(datetime(1996, 1, 1))) & F.col("difficulty").isin("Easy", "Hard") & F.col("success") & F.col("cost").between(0.01, 0.05))
    return rounded(p.select("document_id", "model", "difficulty", "cost"), 6)


@query(RS + "SELECT doc_id, start_pos, pii_type FROM spans WHERE trim(text) <> '' AND confidence BETWEEN 0.75 AND 1")
def o032_sane_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.rule_spans(documents(spark, sf_dir))
    return s.filter(E.sane(F.col("text"), F.col("confidence"), F.col("pii_type")) & (F.col("confidence") >= 0.75)).select("doc_id", "start_pos", "pii_type")


@query(f"WITH {LEDGER_SQL} SELECT error_message, provider, count(*) AS errors, count(*) FILTER (WHERE timestamp >= TIMESTAMP '2024-01-25') AS recent FROM ledger WHERE NOT success GROUP BY ALL")
def o033_recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).filter("not success").groupBy("error_message", "provider").agg(F.count("*").alias("errors"), F.count_if(F.col("timestamp") >= F.lit(datetime(2024, 1, 25))).alias("recent"))


@query("SELECT d.doc_id, l.quality FROM documents d JOIN (SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) = 1) l USING (doc_id)")
def o036_first_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("l"))
    return table(spark, sf_dir, "documents").select("doc_id").join(first, "doc_id").select("doc_id", "l.quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def o039_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT doc_id, 'format' AS tag, lang AS value FROM documents UNION ALL SELECT doc_id, 'size_category', CASE WHEN n_chars * 1000 < 1048576 THEN 'small' WHEN n_chars * 1000 < 10485760 THEN 'medium' ELSE 'large' END FROM documents UNION ALL SELECT doc_id, 'ground_truth', (doc_id IN (SELECT doc_id FROM labels))::VARCHAR FROM documents")
def o164_auto_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.auto_tags(tagged_rows(spark, sf_dir))


def tagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has_truth")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("format"), (F.col("n_chars") * 1000).alias("bytes")).join(marks, "doc_id", "left")


@query("SELECT doc_id, lang FROM documents WHERE n_chars * 1000 >= 1048576 AND n_chars * 1000 < 10485760")
def o040_with_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_tags(table(spark, sf_dir, "documents"), Q.auto_tags(tagged_rows(spark, sf_dir)), "size_category", "medium").select("doc_id", "lang")


@query("SELECT 'format' AS tag, lang AS value, count(DISTINCT doc_id) AS documents FROM documents GROUP BY lang UNION ALL SELECT 'size_category', CASE WHEN n_chars * 1000 < 1048576 THEN 'small' WHEN n_chars * 1000 < 10485760 THEN 'medium' ELSE 'large' END, count(DISTINCT doc_id) FROM documents GROUP BY ALL UNION ALL SELECT 'ground_truth', (doc_id IN (SELECT doc_id FROM labels))::VARCHAR, count(DISTINCT doc_id) FROM documents GROUP BY ALL")
def o068_tag_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.tag_statistics(Q.auto_tags(tagged_rows(spark, sf_dir)))


@query("SELECT n.n_name AS nation, r.r_name AS region, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY ALL")
def o042_dimension_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    counts = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))  # before the joins: the fact side shrinks to a row a nation
    return counts.join(n, counts["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.sum("customers").alias("customers"))


@query("SELECT o_orderpriority AS model, item_id FROM (SELECT DISTINCT o_orderpriority FROM orders), (SELECT item_id FROM benchmark)")
def o043_models_by_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model")).distinct()
    return table(spark, sf_dir, "benchmark").select("item_id").crossJoin(F.broadcast(models)).select("model", "item_id")


@query("SELECT a.m AS a, b.m AS b FROM (SELECT DISTINCT o_orderpriority AS m FROM orders) a JOIN (SELECT DISTINCT o_orderpriority AS m FROM orders) b ON a.m < b.m")
def o044_model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("m")).distinct()
    return m.select(F.col("m").alias("a")).join(m.select(F.col("m").alias("b")), F.col("a") < F.col("b"))


# --- data sets -----------------------------------------------------------------------------------


@query("SELECT lang AS format, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes, round(sum(octet_length(encode(text))) / 1048576.0::DOUBLE, 2) AS megabytes, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS with_truth FROM documents GROUP BY lang")
def o062_loader_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").cast("long").alias("n"))
    marks = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("m")).distinct()
    return d.join(marks, "doc_id", "left").groupBy(F.col("lang").alias("format")).agg(F.count("*").alias("documents"), F.sum("n").alias("bytes"), F.round(F.sum("n") / 1048576, 2).alias("megabytes"), F.count("m").alias("with_truth"))


@query(P + "SELECT model, round(sum(latency), 4) AS seconds, round(avg(latency), 4) AS mean_seconds, round(avg(accuracy_score) FILTER (WHERE success AND accuracy_score > 0), 6) AS confidence, round(count(*) / sum(latency), 6) AS per_second FROM performance GROUP BY model")
def o063_batch_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = performance(spark, sf_dir).groupBy("model").agg(F.round(F.sum("latency"), 4).alias("seconds"), F.round(F.avg("latency"), 4).alias("mean_seconds"), F.round(F.avg(F.when(F.col("success") & (F.col("accuracy_score") > 0), F.col("accuracy_score"))), 6).alias("confidence"), F.round(X.ratio(F.count("*"), F.sum("latency")), 6).alias("per_second"))
    return out


@query("SELECT source, count(*) AS documents, count(quality) AS labelled, round(avg((quality IS NOT NULL)::INT), 6) AS completeness FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def o065_labelled_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.labelled_statistics(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["source"]), 6)


@query(P + """, q AS (SELECT avg(accuracy_score) AS m, quantile_cont(accuracy_score, 0.5) AS md, stddev_pop(accuracy_score) AS s, min(accuracy_score) AS lo, max(accuracy_score) AS hi, avg((accuracy_score < 0.92::DOUBLE)::INT) AS l, avg(success::INT) AS c FROM performance)
SELECT round(m, 6) AS mean, round(md, 6) AS median, round(s, 6) AS std, round(lo, 6) AS least, round(hi, 6) AS most, round(l, 6) AS low_share, round(c, 6) AS completeness, l > 0.1 AS low_confidence_issue, round(0.4::DOUBLE * c + 0.6::DOUBLE * m, 6) AS overall FROM q""")
def o066_dataset_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.dataset_quality(performance(spark, sf_dir), F.when(F.col("success"), 1.0).otherwise(0.0), "accuracy_score", 0.92), 6)


@query("SELECT lang AS split, quality AS status, count(*) AS n, round(avg(toxic), 6) AS avg_toxic, min(toxic) AS least, max(toxic) AS most FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def o067_truth_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy(F.col("lang").alias("split"), F.col("quality").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("avg_toxic"), F.min("toxic").alias("least"), F.max("toxic").alias("most"))


@query(P + ", m AS (SELECT model, avg(accuracy_score) AS a, avg(cost) AS c FROM performance GROUP BY model), l AS (SELECT model, 'a' AS metric, a AS v FROM m UNION ALL SELECT model, 'c', c FROM m) SELECT metric, arg_max(model, v) AS best, arg_min(model, v) AS worst, round(avg(v), 6) AS mean FROM l GROUP BY metric")
def o069_metric_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = performance(spark, sf_dir).groupBy("model").agg(F.avg("accuracy_score").alias("a"), F.avg("cost").alias("c"))
    return rounded(R.metric_comparison(m, ["a", "c"], "model"), 6)


@query(RS + """, e AS (SELECT *, CASE WHEN (doc_id + start_pos) % 3 = 0 THEN 'false_positive' ELSE 'wrong_type' END AS error FROM spans)
SELECT pii_type || '_' || error AS pattern, count(*) AS n, round(avg(nullif(confidence, 0)), 6) AS avg_confidence, array_to_string(list_sort(list_distinct(list(text)))[1:5], '|') AS examples FROM e GROUP BY ALL ORDER BY n DESC, pattern LIMIT 10""")
def o070_error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = E.rule_spans(documents(spark, sf_dir)).withColumn("error", F.when((F.col("doc_id") + F.col("start_pos")) % 3 == 0, "false_positive").otherwise("wrong_type"))
    return rounded(Q.error_patterns(s).withColumn("examples", F.array_join("examples", "|")), 6)


@query(P + "SELECT CASE WHEN accuracy_score < 0.3::DOUBLE THEN '0-0.3' WHEN accuracy_score < 0.6::DOUBLE THEN '0.3-0.6' WHEN accuracy_score < 0.8::DOUBLE THEN '0.6-0.8' ELSE '0.8-1' END AS bin, count(*) AS n FROM performance GROUP BY ALL")
def o070_confidence_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.confidence_bins(performance(spark, sf_dir).withColumnRenamed("accuracy_score", "confidence"))


def factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    share = lambda k: (F.col("n_chars") * k % 100 / 100.0)
    return d.select("doc_id", share(1).alias("image_quality"), share(3).alias("text_complexity"), share(7).alias("layout_complexity"), share(11).alias("content_type"), share(13).alias("special_elements"))


_F = "f AS (SELECT doc_id, n_chars % 100 / 100.0::DOUBLE AS a, n_chars * 3 % 100 / 100.0::DOUBLE AS b, n_chars * 7 % 100 / 100.0::DOUBLE AS c, n_chars * 11 % 100 / 100.0::DOUBLE AS d, n_chars * 13 % 100 / 100.0::DOUBLE AS e FROM documents), g AS (SELECT doc_id, 0.25::DOUBLE * a + 0.2::DOUBLE * b + 0.2::DOUBLE * c + 0.15::DOUBLE * d + 0.2::DOUBLE * e AS score, greatest(0, 1 - 4 * list_var_pop([a, b, c, d, e])) AS confidence FROM f)"


@query(f"WITH {_F} SELECT doc_id, round(score, 6) AS score, CASE WHEN round(score, 9) < 0.25::DOUBLE THEN 'easy' WHEN round(score, 9) < 0.5::DOUBLE THEN 'medium' WHEN round(score, 9) < 0.75::DOUBLE THEN 'hard' ELSE 'very_hard' END AS level, round(confidence, 6) AS confidence FROM g")
def o168_difficulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.difficulty(factor_rows(spark, sf_dir))
    return rounded(out.select("doc_id", "score", Q.level(F.round("score", 9), Q.DIFFICULTY).alias("level"), "confidence"), 6)


@query(f"WITH {_F} SELECT count(*) AS n, round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, round(min(score), 6) AS least, round(max(score), 6) AS most FROM g")
def o071_difficulty_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.difficulty(factor_rows(spark, sf_dir)).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("least"), F.max("score").alias("most")), 6)


@query(P + """SELECT model, round(avg(coalesce(accuracy_score, 0)), 6) AS f1, round(1 - stddev_pop(accuracy_score) / avg(accuracy_score), 6) AS consistency, round(3600 / avg(latency), 4) AS documents_per_hour, round(sum(cost) / sum(entities_found), 8) AS cost_per_entity, round(avg((entities_found > 0)::INT), 6) AS detection_rate FROM performance GROUP BY model""")
def o072_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = performance(spark, sf_dir)
    score = F.coalesce(F.nanvl("accuracy_score", F.lit(0.0)), F.lit(0.0))
    out = p.groupBy("model").agg(F.avg(score).alias("f1"), (1 - X.ratio(F.stddev_pop(score), F.avg(score))).alias("consistency"), X.ratio(F.lit(3600.0), F.avg("latency")).alias("documents_per_hour"), X.ratio(F.sum("cost"), F.sum("entities_found")).alias("cost_per_entity"), F.avg(F.when(F.col("entities_found") > 0, 1.0).otherwise(0.0)).alias("detection_rate"))
    digits = {"documents_per_hour": 4, "cost_per_entity": 8}
    return out.select("model", *(F.round(c, digits.get(c, 6)).alias(c) for c in out.columns[1:]))


@query(P + ", m AS (SELECT domain, model, avg(accuracy_score) AS f1, count(*) AS n FROM performance GROUP BY ALL) SELECT domain, round(sum(f1 * n) / sum(n), 6) AS f1, arg_max(model, f1) AS best_model, sum(n)::BIGINT AS n FROM m GROUP BY domain")
def o073_domain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = performance(spark, sf_dir).groupBy("domain", "model").agg(F.avg("accuracy_score").alias("f1"), F.count("*").alias("n"))
    return rounded(m.groupBy("domain").agg((F.sum(F.col("f1") * F.col("n")) / F.sum("n")).alias("f1"), F.max_by("model", "f1").alias("best_model"), F.sum("n").alias("n")), 6)


@query(RS + "SELECT pii_type, count(*) AS n, count(*) FILTER (WHERE confidence > 0.5::DOUBLE) AS tp, count(*) FILTER (WHERE NOT confidence > 0.5::DOUBLE) AS fp, round(avg((confidence > 0.5::DOUBLE)::INT), 6) AS precision FROM spans GROUP BY pii_type")
def o075_confidence_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = F.col("confidence") > 0.5
    return E.rule_spans(documents(spark, sf_dir)).groupBy("pii_type").agg(F.count("*").alias("n"), F.count_if(sure).alias("tp"), F.count_if(~sure).alias("fp"), F.round(F.avg(F.when(sure, 1.0).otherwise(0.0)), 6).alias("precision"))


@query("SELECT conv_id, max(turn) + 1 AS turns, count(*) FILTER (WHERE length(text) > 80) AS long, count(*) FILTER (WHERE length(text) BETWEEN 50 AND 80) AS middle, count(*) FILTER (WHERE length(text) < 50) AS short, round(avg(length(text)), 4) AS mean, min(length(text)) AS least, max(length(text)) AS most FROM conversations GROUP BY conv_id")
def o076_box_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text").cast("long")
    out = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("turns"), F.count_if(n > 80).alias("long"), F.count_if(n.between(50, 80)).alias("middle"), F.count_if(n < 50).alias("short"), F.round(F.avg(n), 4).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))
    return out


@query("WITH t AS (SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN length(coalesce(b, '')) > length(coalesce(a, '')) THEN b ELSE a END AS text FROM t")
def o077_longer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*(F.max(F.when(F.col("turn") == k, F.col("text"))).alias(c) for k, c in enumerate("ab")))
    size = lambda c: F.length(F.coalesce(c, F.lit("")))
    return t.select("conv_id", F.when(size(F.col("b")) > size(F.col("a")), F.col("b")).otherwise(F.col("a")).alias("text"))


@query(f"WITH {LEDGER_SQL}, m AS (SELECT provider || CASE WHEN event_id % 2 = 0 THEN '/' || model ELSE '' END AS name, success, CASE WHEN event_id % 3 = 0 THEN [] ELSE [processing_time / 10, 0.5::DOUBLE] END AS scores, event_id FROM ledger) SELECT event_id, round(CASE WHEN NOT success THEN 0 WHEN len(scores) > 0 THEN list_avg(scores) ELSE 0.8 END::DOUBLE, 6) AS accuracy, CASE WHEN contains(name, '/') THEN split_part(name, '/', 1) ELSE 'unknown' END AS provider FROM m")
def o078_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ledger(spark, sf_dir).select("event_id", "success", F.when(F.col("event_id") % 2 == 0, F.concat_ws("/", "provider", "model")).otherwise(F.col("provider")).alias("name"), F.when(F.col("event_id") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(F.col("processing_time") / 10, F.lit(0.5))).alias("scores"))
    return rounded(A.enrich(m, "scores", "success", "name").select("event_id", "accuracy", "provider"), 6)


# --- order, pages, samples -----------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50 OFFSET 100")
def o107_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], 50, 2).select("o_orderkey")


@query("SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def o108_pending_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_documents(spark, sf_dir).filter("status = 'pending'").orderBy("created_at", "document_id").limit(100).select("document_id")


@query("SELECT o_orderkey, priority, row_number() OVER (ORDER BY priority DESC, o_orderkey) AS place FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 3 WHEN '2-HIGH' THEN 2 ELSE 1 END AS priority FROM orders)")
def o109_priority_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its place."""
    p = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 2).otherwise(1)
    return R.numbered(table(spark, sf_dir, "orders").select("o_orderkey", p.alias("priority")), [F.desc("priority"), F.col("o_orderkey")], "place")


@query("SELECT c_nationkey, arg_max(c_custkey, row(c_acctbal, -c_custkey)) AS richest, arg_min(c_custkey, row(c_acctbal, c_custkey)) AS poorest FROM customer GROUP BY c_nationkey")
def o111_extreme_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("richest"), F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("poorest"))


@query()
def o113_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", {"train": 0.7, "validation": 0.15, "test": 0.15})


@query()
def o114_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bootstrap(performance(spark, sf_dir), "latency", 50)


@query("SELECT doc_id AS id, text FROM documents UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations")
def o115_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(c)


@query(RS + ", t AS (SELECT source, list_distinct(list(pii_type)) AS found FROM spans GROUP BY source) SELECT source, array_to_string(list_sort(list_filter(['email_address', 'person_name', 'phone_number'], lambda x: NOT list_contains(found, x))), ',') AS missing FROM t")
def o117_missing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = E.rule_spans(documents(spark, sf_dir), key=("doc_id", "source")).groupBy("source").agg(F.collect_set("pii_type").alias("found"))
    wanted = F.array(*map(F.lit, ("email_address", "person_name", "phone_number")))
    return t.select("source", F.array_join(F.array_sort(F.array_except(wanted, "found")), ",").alias("missing"))


# --- quality -------------------------------------------------------------------------------------


@query()
def o155_assessed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.assess(kinds(spark, sf_dir)).select("doc_id", "start_pos", "kind", "format", "context", "cross", "pattern", "adjusted", "level", "validity", F.array_join("flags", ",").alias("flags")), 6)


@query(RS + f""", k AS (SELECT doc_id, start_pos, end_pos, text, {_UPPER} AS kind FROM spans), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, kind, text) AS t, count(*) OVER (PARTITION BY doc_id, kind, CASE WHEN contains(text, '@') THEN split_part(text, '@', -1) END) AS m, count(*) OVER (PARTITION BY doc_id, kind, substr(regexp_replace(text, '[^0-9]', '', 'g'), 1, 3)) AS a FROM k)
SELECT doc_id, start_pos, end_pos, kind, round(least(0.5::DOUBLE + CASE WHEN t > 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN kind = 'EMAIL' AND m > 1 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN kind = 'PHONE' AND a > 1 THEN 0.05::DOUBLE ELSE 0 END, 1), 6) AS "cross" FROM c""")
def o156_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.with_cross_factor(kinds(spark, sf_dir)).select("doc_id", "start_pos", "end_pos", "kind", "cross"), 6)


@query()
def o158_document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.document_quality(Q.assess(kinds(spark, sf_dir))), 6)


@query(RS + """, t AS (SELECT doc_id, source, pii_type, count(*) AS n, sum(confidence) AS s, var_pop(confidence) AS v FROM spans GROUP BY ALL), per AS (SELECT doc_id, source, sum(s) / sum(n) AS c, avg(CASE WHEN n > 1 THEN 1 - v ELSE 0.8::DOUBLE END) AS k, list(pii_type) AS f FROM t GROUP BY ALL)
SELECT doc_id, source AS doc_type, round(c, 6) AS confidence, round(k, 6) AS consistency, CASE WHEN source = 'src1' THEN array_to_string(list_sort(list_filter(['email_address', 'person_name'], lambda x: NOT list_contains(f, x))), ',') ELSE '' END AS missing,
  round(CASE WHEN source = 'src1' THEN len(list_filter(['email_address', 'person_name'], lambda x: list_contains(f, x))) / 2.0::DOUBLE ELSE 1 END, 6) AS completeness FROM per""")
def o159_label_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.label_scores(kinds(spark, sf_dir).withColumnRenamed("source", "doc_type"), {"src1": ["email_address", "person_name"]})
    return rounded(out.withColumn("missing", F.array_join("missing", ",")), 6)


@query("""WITH a AS (SELECT quality AS x, 1 - toxic AS y FROM labels), t AS (SELECT count(*)::DOUBLE AS n FROM a), o AS (SELECT avg((x = y)::INT) AS p FROM a), e AS (SELECT sum(p.c * q.c) / max(n * n) AS p FROM (SELECT x AS k, count(*) AS c FROM a GROUP BY x) p JOIN (SELECT y AS k, count(*) AS c FROM a GROUP BY y) q USING (k), t)
SELECT round(o.p, 6) AS observed, round(e.p, 6) AS expected, round((o.p - e.p) / (1 - e.p), 6) AS kappa FROM o, e""")
def o160_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.kappa(table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")), "a", "b"), 6)


_ANN = ", n AS (SELECT doc_id, start_pos, end_pos, pii_type, text, 'one' AS annotator FROM spans UNION ALL SELECT doc_id, start_pos, end_pos, CASE WHEN (doc_id + start_pos) % 4 = 0 THEN 'other' ELSE pii_type END, text, 'two' FROM spans WHERE (doc_id + start_pos) % 5 <> 0)"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = E.rule_spans(documents(spark, sf_dir)).select("doc_id", "start_pos", "end_pos", "pii_type", "text", F.lit("one").alias("annotator"))
    at = F.col("doc_id") + F.col("start_pos")
    return one.unionByName(one.filter(at % 5 != 0).withColumns({"pii_type": F.when(at % 4 == 0, "other").otherwise(F.col("pii_type")), "annotator": F.lit("two")}))


@query(RS + _ANN + " SELECT a.annotator AS annotator_a, b.annotator AS annotator_b, count(*) AS places, round(avg((a.pii_type = b.pii_type)::INT), 6) AS type_agreement, round(avg((lower(a.text) = lower(b.text))::INT), 6) AS text_agreement FROM n a JOIN n b USING (doc_id, start_pos, end_pos) WHERE a.annotator < b.annotator GROUP BY ALL")
def o041_annotator_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.annotator_pairs(annotations(spark, sf_dir)), 6)


@query(RS + _ANN + ", sets AS (SELECT doc_id, annotator, list_distinct(list(text || '|' || pii_type)) AS x FROM n GROUP BY ALL) SELECT a.doc_id, round(len(list_intersect(a.x, b.x))::DOUBLE / len(list_distinct(a.x || b.x)), 6) AS jaccard FROM sets a JOIN sets b ON a.doc_id = b.doc_id AND a.annotator < b.annotator")
def o161_annotator_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = annotations(spark, sf_dir).groupBy("doc_id", "annotator").agg(F.collect_set(F.concat_ws("|", "text", "pii_type")).alias("x"))
    a, b = (s.select("doc_id", F.col("annotator").alias(f"w{k}"), F.col("x").alias(k)) for k in "ab")
    return rounded(a.join(b, "doc_id").filter("wa < wb").select("doc_id", S.jaccard_of_sets(F.col("a"), F.col("b")).alias("jaccard")), 6)


@query(P + ", r AS (SELECT count(*) AS n, avg(accuracy_score) AS mean, quantile_cont(accuracy_score, 0.5) AS median, stddev_pop(accuracy_score) AS std FROM performance) SELECT n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, CASE WHEN mean >= 0.9 THEN 'A' WHEN mean >= 0.8 THEN 'B' WHEN mean >= 0.7 THEN 'C' WHEN mean >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM r")
def o162_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.validation_report(performance(spark, sf_dir), "accuracy_score"), 6)


@query("""SELECT doc_id, least(greatest(trunc(5 + 0.5::DOUBLE * (n_chars % 17) + 2 * (n_chars % 3) + greatest(0, 2 * (n_chars % 6 - 3)))::INT, 5), 30) AS minutes, round((1 - n_chars % 100 / 100.0::DOUBLE) * 10 + 5 * (n_chars % 2) + 2 * (n_chars % 3 + 1) + CASE WHEN lang = 'en' THEN 3 ELSE 0 END, 6) AS priority FROM documents""")
def o163_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rows = table(spark, sf_dir, "documents").select("doc_id", (n % 17).alias("entities"), (n % 3).alias("issues"), (n % 6).alias("complexity"), (n % 100 / 100.0).alias("score"), (n % 2).alias("high_issues"), (n % 3 + 1).alias("document_priority"), (F.col("lang") == "en").alias("sensitive"))
    return rounded(Q.review_queue(rows).select("doc_id", "minutes", "priority"), 6)


@query("SELECT page_id, array_to_string(list_filter([CASE WHEN url IS NULL THEN 'missing url' END, CASE WHEN length(html) > 2000 THEN 'html too long' END, CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'url does not match' END], lambda x: x IS NOT NULL), ',') AS errors FROM pages")
def o165_schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.check_schema(table(spark, sf_dir, "pages"), ["url"], {"html": (None, 2000)}, {"url": "^https?://"})
    return out.select("page_id", F.array_join("errors", ",").alias("errors"))


@query("SELECT doc_id, round(least(0.05::DOUBLE * (contains(lower(text), 'license')::INT + contains(lower(text), 'the')::INT + contains(lower(text), 'apache')::INT + contains(lower(text), 'http')::INT + contains(lower(text), 'version')::INT), 0.2), 6) AS boost FROM documents")
def o167_domain_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(documents(spark, sf_dir).select("doc_id", Q.domain_boost(F.col("text"), ("license", "the", "apache", "http", "version")).alias("boost")), 6)


@query(f"WITH {LEDGER_SQL} SELECT event_id, CASE WHEN contains(error_message, 'timeout') THEN 'timeout' ELSE 'other' END AS category, round(least(pow(2, event_id % 8), 60), 4) AS wait FROM ledger WHERE NOT success")
def o195_error_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).filter("not success").select("event_id", Q.error_category(F.col("error_message")).alias("category"), F.round(Q.backoff(F.col("event_id") % 8), 4).alias("wait"))


@query(f"WITH {LEDGER_SQL}, h AS (SELECT provider AS name, CASE WHEN provider = 'error' THEN 2 WHEN avg(estimated_cost) > 40 THEN 1 ELSE 0 END AS r, avg(processing_time) AS response FROM ledger GROUP BY provider) SELECT ['healthy', 'degraded', 'unhealthy'][max(r) + 1] AS status, round(avg(response), 6) AS avg_response, coalesce(array_to_string(list(name ORDER BY name) FILTER (WHERE r = 2), ','), '') AS failed FROM h")
def o197_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ledger(spark, sf_dir).groupBy(F.col("provider").alias("name")).agg(F.avg("estimated_cost").alias("c"), F.avg("processing_time").alias("response"))
    status = F.when(F.col("name") == "error", "unhealthy").when(F.col("c") > 40, "degraded").otherwise("healthy")
    return rounded(Q.health(h.withColumn("status", status)).withColumn("failed", F.array_join("failed", ",")), 6)


# --- routing and batches -------------------------------------------------------------------------

_MODELS = "m AS (SELECT domain, model, avg(accuracy_score) AS accuracy, avg(latency) AS seconds, avg(cost) / 10 AS cost, avg(success::INT) AS reliability, count(*) AS requests FROM performance GROUP BY ALL)"


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = performance(spark, sf_dir)
    return p.groupBy("domain", "model").agg(F.avg("accuracy_score").alias("accuracy"), F.avg("latency").alias("seconds"), (F.avg("cost") / 10).alias("cost"), F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)).alias("reliability"), F.count("*").alias("requests"))


@query(P + f""", {_MODELS}, s AS (SELECT domain, model, (0.35::DOUBLE * accuracy + 0.2::DOUBLE * (1 - least(seconds / 30, 1)) + 0.2::DOUBLE * (1 - least(cost / 0.01::DOUBLE, 1)) + 0.25::DOUBLE * reliability) * CASE WHEN seconds > 25.5::DOUBLE THEN 0.5::DOUBLE ELSE 1 END AS score FROM m)
SELECT domain, model, round(score, 6) AS score, row_number() OVER (PARTITION BY domain ORDER BY score DESC, model)::INT AS place FROM s QUALIFY place <= 3""")
def o176_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.route(models(spark, sf_dir), ["domain"], "balanced", 2, max_seconds=25.5).select("domain", "model", "score", "place"), 6)


@query(P + "SELECT document_name, model FROM performance WHERE success QUALIFY row_number() OVER (PARTITION BY document_name ORDER BY timestamp, document_id, latency, model) = 1")
def o175_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = performance(spark, sf_dir).withColumn("priority", F.struct("timestamp", "document_id", "latency", "model"))
    return R.first_success(p, ["document_name"]).select("document_name", "model")


@query(P + ", g AS (SELECT document_name, model, avg(latency) AS latency, sum(entities_found) AS e, avg(cost) AS cost FROM performance GROUP BY ALL) SELECT document_name, arg_min(model, row(latency, model)) AS fastest, arg_min(model, row(-e, model)) AS most_entities, arg_min(model, row(cost, model)) AS cheapest FROM g GROUP BY document_name")
def o179_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = performance(spark, sf_dir).groupBy("document_name", "model").agg(F.avg("latency").alias("latency"), F.sum("entities_found").alias("entities_found"), F.avg("cost").alias("cost"))
    return R.extremes(g, ["document_name"])


_VARIANT = "CASE WHEN (('0x' || substr(md5('exp:' || session_id), 1, 8))::BIGINT % 10000) / 10000.0::DOUBLE <= 0.5 THEN 'a' ELSE 'b' END"


@query(f"WITH {LEDGER_SQL}, v AS (SELECT {_VARIANT} AS variant, estimated_cost FROM ledger), m AS (SELECT variant, count(*) AS n, avg(estimated_cost) AS mean FROM v GROUP BY variant) SELECT variant, n, round(mean, 6) AS mean, mean = max(mean) OVER () AS winner, round((max(mean) OVER () - mean) / max(mean) OVER (), 6) AS behind, (max(mean) OVER () - mean) / max(mean) OVER () > 0.05::DOUBLE AS significant FROM m")
def o180_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ledger(spark, sf_dir).withColumn("variant", R.variant(F.col("session_id"), "exp", {"a": 0.5, "b": 0.5}))
    return rounded(R.experiment_summary(v, "estimated_cost"), 6)


@query(P + ", m AS (SELECT model AS version, avg(accuracy_score) AS a, avg(latency) AS l FROM performance GROUP BY model), x AS (SELECT version, 'a' AS metric, a AS value FROM m UNION ALL SELECT version, 'l', l FROM m) SELECT version, metric, round(value, 6) AS value, rank() OVER (PARTITION BY metric ORDER BY value DESC)::DOUBLE AS rank FROM x")
def o181_version_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = performance(spark, sf_dir).groupBy(F.col("model").alias("version")).agg(F.avg("accuracy_score").alias("a"), F.avg("latency").alias("l"))
    return rounded(R.version_ranking(m, ["a", "l"]), 6)


@query("SELECT l_orderkey AS document_id, arg_max(l_returnflag, row(l_shipdate, l_linenumber, l_returnflag)) AS status FROM lineitem GROUP BY l_orderkey")
def o209_current_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("f"))
    return R.current(e, ["document_id"], ["at", "n", "f"], []).select("document_id", "status")


@query("SELECT CASE WHEN o_custkey = 7 AND o_orderstatus = 'O' THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'pending' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def o210_cancelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cancel(batch_documents(spark, sf_dir), F.lit(7)).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS results FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY AND o_orderstatus IN ('F', 'P'))")
def o211_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = batch_documents(spark, sf_dir).withColumnRenamed("document_id", "l_orderkey")
    return R.retained(parents, table(spark, sf_dir, "lineitem"), datetime(1998, 1, 1), 365, "l_orderkey")[1].agg(F.count("*").alias("results"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE user_id = 7")
def o212_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("user_id = 7").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
