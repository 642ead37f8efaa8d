"""The pipeline on a small corpus with planted cases, stage by stage."""

import random

import corpus_pipeline as C
import pytest

from spanforge.llm.mixing import MARGINS

from .test_operators import edit, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, folder = random.Random(11), tmp_path_factory.mktemp("sf")
    texts = [prose(rng, 90, 4000) for _ in range(400)]
    items = [prose(rng, 30, 4000) for _ in range(5)]
    toxic = [i % 4 == 0 for i in range(len(texts))]
    texts = [t + " zorgle you blimpf and zorgle" if bad else t for t, bad in zip(texts, toxic, strict=True)]
    near = {400 + k: 4 * k + 1 for k in range(10)}
    texts += [edit(rng, texts[j], 1) for j in near.values()]
    leaks = [410 + k for k in range(5)]
    texts += [prose(rng, 40, 4000) + " " + items[k] for k in range(5)]
    rows = [(i, t, rng.choice(["en", "fr"]), rng.choice(["a", "a", "b"]), len(t)) for i, t in enumerate(texts)] + [(415, None, None, None, 0), (416, "", "en", "a", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(b)) for i, b in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {i for i, b in enumerate(toxic) if b}, near, set(leaks)


def test_stages(spark, corpus, tmp_path):
    folder, toxic, near, leaks = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id for r in docs.collect()}]
    for name, stage in C.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert name == "sharding" or docs.columns == columns
    everything, clean, single, unleaked, mixed, dealt = seen
    assert everything - clean == toxic
    assert clean - single == set(near) | {416}  # texts without words are one class
    assert single - unleaked == leaks
    assert mixed <= unleaked and len(mixed) > 0.7 * len(unleaked) and dealt == mixed
    sizes = [r["sum(size)"] for r in docs.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 2000


def test_run_and_extra_columns(spark, corpus):
    folder = corpus[0]
    assert C.run(spark, folder).count() > 200
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 uid", "2 place", "3 toxic_score", "4 size", "5 shard", *(f"6 AS {m}_x" for m in MARGINS))
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
