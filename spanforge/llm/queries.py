"""Queries that apply the training-data operators to whole tables, and SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import new_folder
from .decontaminate import decontaminate
from .embedding_dedup import embedding_duplicates
from .exact_dedup import exact_dedup
from .lm_score import lm_scores
from .minhash import near_duplicates
from .mixing import mix_sources
from .sharding import shard_by_bytes
from .spelling import spelling_variants
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import toxicity
from .warc import read_warc, write_warc
from .whitening import whitened


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    weights = (F.round(c, 6).alias(c.removeprefix("mix_")) for c in ("mix_weight", "mix_rate"))
    return mixed.select("doc_id", "source", "lang", "topic", F.col("mix_tokens").alias("tokens"), *weights, F.col("mix_copies").alias("copies"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_bytes", "n_chunks")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back in byte ranges."""
    folder = new_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder).write.format("noop").mode("overwrite").save()
    records = read_warc(spark, folder, split_bytes=4 << 20, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def held_out(key: Column) -> Column:
    """The fold whose labels are never learnt from; null keys are in it."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(True))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.7).cast("int").alias("predicted"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("place")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("uid")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target model is that of the rows labelled as good; the background model that of all rows."""
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    scored = lm_scores(table(spark, sf_dir, "documents"), good)
    return scored.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component."""
    rows = whitened(table(spark, sf_dir, "embeddings"), 32)
    rows = rows.select("*", F.posexplode("whitened").alias("at", "value"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.col("explained")[F.col("at")].alias("explained"), "identity_error")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_duplicates(table(spark, sf_dir, "embeddings"), 0.9)
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_exact_dedup, op3_warc, op4_toxicity, op5_decontamination, op6_suffix_dedup, op7_minhash, op8_sharding, op9_substring_dedup, op10_lm_score, op11_spelling, op12_whitening, op13_embedding_dedup)
}
ORACLE_SQL: dict[str, str] = {
    # Runs of a document are counted first, so that each is checksummed once. Near words share what is left without one code point
    # (at one place, for replaced ones).
    "op11_spelling": r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)),
mine AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, step[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS h FROM mine, crc),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM summed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word)::BIGINT + 1))::INT AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM pairs GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)""",
    # CRC-32 byte by byte, over a table made from its polynomial.
    "op8_sharding": """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS step),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, b: xor(a >> 8, step[xor(a & 255, b) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM documents, crc),
s AS (SELECT *, ((2 * sum(size) OVER (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size) * 8 // (2 * sum(size) OVER ()))::INT AS shard FROM d)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard FROM s""",
    "op3_warc": """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
m AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first FROM d),
bits AS (SELECT page_id, n, first, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(h, i::INT, 1))::INT), 4, '0')), 'string_agg', '') AS bits FROM m)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_sum(list_transform(range(0, 5), lambda j: substr(bits, (5 * i + j + 1)::INT, 1)::INT * (1 << (4 - j)::INT)))::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits""",
    "op2_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)""",
    "op1_mixing": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang,
    CASE WHEN contains(text, 'icensed under') THEN 'licence' WHEN contains(text, ' | ') THEN 'table'
         WHEN contains(text, 'http') THEN 'link' WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,
    CASE WHEN length(text) > 0 THEN 2 * length(text) - length(replace(text, ' ', '')) - length(replace(text, chr(10), '')) + 1 ELSE 0 END::BIGINT AS tokens
  FROM documents),
cells AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
s AS (SELECT source, pow(sum(tokens), 0.7) AS w FROM cells GROUP BY source),
l AS (SELECT lang, pow(sum(tokens), 0.7) AS w FROM cells GROUP BY lang),
t AS (SELECT topic, pow(sum(tokens), 0.7) AS w FROM cells GROUP BY topic),
base AS (SELECT c.*, s.w / (SELECT sum(w) FROM s) AS ts, l.w / (SELECT sum(w) FROM l) AS tl, t.w / (SELECT sum(w) FROM t) AS tt
         FROM cells c JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)),
fit AS (
  SELECT 0 AS k, source, lang, topic, tokens, ts, tl, tt, tokens / (SELECT sum(tokens) FROM cells) AS w FROM base
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, ts, tl, tt, w * tt / sum(w) OVER (PARTITION BY topic) FROM (
    SELECT * REPLACE (w * tl / sum(w) OVER (PARTITION BY lang) AS w) FROM (
      SELECT * REPLACE (w * ts / sum(w) OVER (PARTITION BY source) AS w) FROM fit WHERE k < 40))),
r AS (SELECT source, lang, topic, w, w / (tokens / (SELECT sum(tokens) FROM cells)) AS rate FROM fit WHERE k = 40)
SELECT doc_id, source, lang, topic, tokens, round(w, 6) AS weight, round(rate, 6) AS rate,
  (floor(rate) + CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0 < rate - floor(rate) THEN 1 ELSE 0 END)::INT AS copies
FROM d JOIN r USING (source, lang, topic)""",
    "op10_lm_score": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS own
  FROM documents),
ends AS (SELECT doc_id, own, len(w) AS n, list_append(w, '') AS w FROM d WHERE len(w) > 0),
tok AS (SELECT doc_id, own, n, w[i] AS word, CASE WHEN i = 1 THEN '' ELSE w[i - 1] END AS prev
        FROM (SELECT *, unnest(range(1, n + 2)) AS i FROM ends)),
pairs AS (SELECT prev, word, count(*) AS b, count(*) FILTER (WHERE own) AS t FROM tok GROUP BY ALL),
singles AS (SELECT word, count(*) AS b, count(*) FILTER (WHERE own) AS t FROM tok GROUP BY ALL),
everything AS (SELECT count(*) AS b, count(*) FILTER (WHERE own) AS t FROM tok),
mine2 AS (SELECT doc_id, own, n, prev, word, count(*) AS c FROM tok GROUP BY ALL),
mine1 AS (SELECT doc_id, word, count(*) AS c FROM tok GROUP BY ALL),
counts AS (
  SELECT m.doc_id, m.n, m.c,
         p.b - m.c AS b2, v.b - coalesce(o.c, 0) AS bv, s.b - u.c AS b1, e.b - (m.n + 1) AS b0,
         p.t - m.c * m.own::INT AS t2, v.t - coalesce(o.c, 0) * m.own::INT AS tv, s.t - u.c * m.own::INT AS t1, e.t - (m.n + 1) * m.own::INT AS t0
  FROM mine2 m JOIN pairs p ON p.prev = m.prev AND p.word = m.word
  JOIN singles v ON v.word = m.prev JOIN singles s ON s.word = m.word
  JOIN mine1 u ON u.doc_id = m.doc_id AND u.word = m.word
  LEFT JOIN mine1 o ON o.doc_id = m.doc_id AND o.word = m.prev CROSS JOIN everything e),
probs AS (
  SELECT doc_id, n, c,
    (CASE WHEN bv > 0 THEN 0.7e0 ELSE 0e0 END) * b2 / greatest(bv, 1) + (1e0 - CASE WHEN bv > 0 THEN 0.7e0 ELSE 0e0 END) * (0.95e0 * b1 / greatest(b0, 1) + 0.05e0 / 1048576) AS pb,
    (CASE WHEN tv > 0 THEN 0.7e0 ELSE 0e0 END) * t2 / greatest(tv, 1) + (1e0 - CASE WHEN tv > 0 THEN 0.7e0 ELSE 0e0 END) * (0.95e0 * t1 / greatest(t0, 1) + 0.05e0 / 1048576) AS pt
  FROM counts),
losses AS (SELECT doc_id, n, sum(-ln(pt) * c) / (n + 1) AS lt, sum(-ln(pb) * c) / (n + 1) AS lb FROM probs GROUP BY doc_id, n)
SELECT d.doc_id, len(d.w) AS n_words, round(lt, 6) AS target_loss, round(lb, 6) AS background_loss, round(lb - lt, 6) AS score
FROM d LEFT JOIN losses USING (doc_id)""",
}
