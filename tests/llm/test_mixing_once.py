"""A rare source doesn't set the share of all other rows that stays."""

from pyspark.sql import functions as F

from spanforge.llm.mixing import mix_sources


def kept(docs, **more):
    mixed = mix_sources(docs, {"source": 0.95, "lang": 0.95, "topic": 0.98}, budget=None, **more)
    return mixed.agg(F.sum(F.col("mix_tokens") * F.col("mix_rate")) / F.sum("mix_tokens"), F.max("mix_rate"), F.max(F.when(F.col("source") == "rare", F.col("mix_rate")))).first()


def test_rare_source(spark):
    rows = spark.range(20000).selectExpr("id AS doc_id", "repeat('word ', 200) AS text", "'en' AS lang", "if(id % 4 = 0, 'b', 'a') AS source", "'t' AS topic")
    rare = rows.limit(1).selectExpr("-1L AS doc_id", "'one two' AS text", "'xx' AS lang", "'rare' AS source", "'t' AS topic")
    assert kept(rows)[0] > 0.9
    share, most, of_rare = kept(rows.unionAll(rare))
    assert share > 0.9 - 1e-6 and most <= 1 and of_rare == 1
    assert abs(kept(rows.unionAll(rare), keep=0.95)[0] - 0.95) < 0.05
