"""Places and batches hold on many files that are packed into tasks otherwise in each pass."""

import random
from contextlib import contextmanager

import corpus_pipeline as C
import pyarrow as pa
import pytest

from spanforge.llm import _packed as P
from spanforge.llm._shared import with_place
from spanforge.llm.decontaminate import decontaminate
from spanforge.llm.minhash import near_duplicates

from .test_operators import edit, prose


@contextmanager
def splits(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, size)
    yield
    for name in names:
        spark.conf.unset(name)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, at = random.Random(21), tmp_path_factory.mktemp("many")
    base = [prose(rng, 60, 4000) for _ in range(1200)]
    texts = base + [edit(rng, base[k * 7], 1) for k in range(150)] + [base[k * 5] for k in range(60)]
    items = [prose(rng, 30, 4000) for _ in range(4)]
    texts += [f"{prose(rng, 20, 4000)} {i}" for i in items]
    rng.shuffle(texts)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(32).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("shuffled", [False, True])
def test_stages_keep_what_the_operators_say(spark, folder, shuffled):
    def docs():
        rows = spark.read.parquet(f"{folder}/documents.parquet")
        return rows.repartition(5) if shuffled else rows

    with splits(spark, "20k"):
        kept = {r.doc_id for r in C.drop_near_duplicates(spark, docs(), folder).select("doc_id").collect()}
        clean = {r.doc_id for r in C.drop_contaminated(spark, docs(), folder).select("doc_id").collect()}
    with splits(spark, "1m"):
        assert kept == {r.doc_id for r in near_duplicates(docs()).filter("kept").collect()}
        leaks = {r.doc_id for r in decontaminate(docs(), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    everything = {r.doc_id for r in docs().select("doc_id").collect()}
    assert len(everything) - len(kept) == 210 and leaks == everything - clean and len(leaks) == 4


def test_places(spark, folder):
    seen = []
    for size in ("20k", "1m"):
        with splits(spark, size):
            rows = with_place(spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id % 2 = 0"), "p")
            seen.append({r.doc_id: r.p for r in rows.select("doc_id", "p").collect()})
    assert seen[0] == seen[1] and len(set(seen[0].values())) == len(seen[0])


def test_one_scan_and_one_exchange_of_texts(spark, folder):
    from spanforge.llm.suffix_dedup import suffix_dedup

    out = suffix_dedup(spark.read.parquet(f"{folder}/documents.parquet"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 3


def test_batches_are_cut_by_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * (3 << 20)) for i in range(6)] + [(9, None), (10, "")], "id long, text string").coalesce(1)

    def count(left):
        ids = P.unpacked(left).column("id")
        return pa.table({"id": ids, "n": pa.array([len(ids)] * len(ids), pa.int32())})

    sizes = P.batches(rows, most_bytes=7 << 20).applyInArrow(count, "id long, n int")
    assert {r.id: r.n for r in sizes.collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 4, 5: 4, 9: 4, 10: 4}
