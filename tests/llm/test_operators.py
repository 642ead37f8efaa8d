"""Each operator on small tables against brute force, with nulls, ties, empty tables and clashing columns."""

import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanforge.llm import _packed as P
from spanforge.llm import lm_score as L
from spanforge.llm import warc as W
from spanforge.llm.decontaminate import decontaminate
from spanforge.llm.exact_dedup import exact_dedup
from spanforge.llm.graph import components
from spanforge.llm.lm_score import lm_scores
from spanforge.llm.minhash import near_duplicates
from spanforge.llm.mixing import mix_sources
from spanforge.llm.sharding import shard_by_bytes
from spanforge.llm.substring_dedup import substring_dedup
from spanforge.llm.suffix_dedup import suffix_dedup
from spanforge.llm.toxicity import Channel, toxicity, trigram_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, bid string, uid int, key string, size int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def table(spark, texts, ids=None):
    """Rows whose other columns have the names the operators use themselves."""
    rows = [(i, t, "en", "s", None, "x", "y", 1, None, 2) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    shared, long = prose(rng, 120), prose(rng, 4000)
    out = [prose(rng, rng.randrange(1, 200)) for _ in range(60)]
    out += [prose(rng, 30) + " " + shared + " " + prose(rng, 30) for _ in range(5)]
    out += [out[3], out[3], out[3].upper(), None, "", None, " \n ", "é" * 500, "é" * 500, long, long + " end", "a" * 1000, "Ünï cödé wörds " * 40]
    return out


def test_substring_dedup(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(table(spark, texts)).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert got[i] == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())


def test_suffix_dedup(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(table(spark, texts)).collect()}
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k : k + 400] for b in raw for k in range(len(b) - 399))
    for i, b in enumerate(raw):
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert got[i] == (len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_exact_dedup(spark, texts):
    got = {r.doc_id: r for r in exact_dedup(table(spark, texts)).collect()}
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    for i, t in enumerate(low):
        same = [j for j, u in enumerate(low) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
        assert got[i].text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_dedup_keeps_one_of_tied_rows(spark):
    rows = exact_dedup(table(spark, ["a", "A", "a", "b", "b"], [1, 1, 1, None, None])).collect()
    assert sum(r.kept for r in rows) == 2 and sorted(r.group_size for r in rows) == [2, 2, 3, 3, 3]


def edit(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def weight(shingles):
    """Of shingles as tuples of words: each weighs as the root of its bytes."""
    return sum(math.sqrt(sum(len(w.encode()) for w in x)) for x in shingles)


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = [prose(rng, 120, 5000) for _ in range(12)]
    texts = base + [edit(rng, b, k) for b in base[:6] for k in (1, 2, 2, 3, 6)] + [base[0], None, "", "few words", "few  words!"]
    chain = base[0]
    for _ in range(6):
        texts.append(chain := edit(rng, chain, 2))
    sets = []
    for t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if weight(a & b) >= 0.8 * weight(a | b) - 1e-9:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    rows = near_duplicates(table(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: root(i) for i in range(len(texts))}
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)
    assert {r.class_id: r.class_size for r in rows} == dict(collections.Counter(r.class_id for r in rows))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_lm_scores(spark):
    rng = random.Random(3)
    texts = [prose(rng, 50, 30) for _ in range(20)] + ["the target speaks like this " * 5] * 4 + [None, "", "one"]
    target = spark.createDataFrame([(i,) for i in (20, 21, 22, 22, None)], "doc_id long")
    got = {r.doc_id: r for r in lm_scores(table(spark, texts), target).collect()}
    own = {20, 21, 22}
    seqs = {i: [*t.split(), ""] for i, t in enumerate(texts) if t and t.split()}

    def counts(ids):
        one, two = collections.Counter(), collections.Counter()
        for i in ids:
            one.update(seqs[i])
            two.update(zip(["", *seqs[i]], seqs[i], strict=False))
        return one, two

    for i, s in seqs.items():
        losses = []
        for ids in (set(seqs), own):
            one, two = counts(ids - {i})
            total, loss = sum(one.values()), 0.0
            for v, w in zip(["", *s], s, strict=False):
                a = 0.7 if one[v] else 0.0
                loss -= math.log(a * two[v, w] / max(one[v], 1) + (1 - a) * (0.95 * one[w] / max(total, 1) + 0.05 / (1 << 20)))
            losses.append(loss / len(s))
        assert got[i].background_loss == pytest.approx(losses[0]) and got[i].target_loss == pytest.approx(losses[1])
        assert got[i].score == pytest.approx(losses[0] - losses[1])
    assert got[24].score is None and got[25].n_words == 0
    assert min(got[i].score for i in (20, 23)) > max(got[i].score for i in range(20))


def test_lm_counts_go_whole():
    text = b"again " * 5000 + b"once"
    h, seen, own = L._batch_grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]), np.array([True]))
    assert len(h) == 3 + 4 and sorted(seen)[-2:] == [4999, 5000] and (own == seen).all()  # an entry for each word, end and pair
    n, own = np.array([1, 14, 15, 3_000_000_000, 5]), np.array([0, 14, 15, 16, 0])
    grams = np.arange(5, dtype=np.uint64)
    sent = pa.table({"bucket": [7, 7], "body": [P.low5(grams), P.low5(grams[3:])], "tail": [L._pack_counts(n, own), L._pack_counts(n[3:], own[3:])]})
    back, front = L._sums([L._add_up(sent)[0]])
    assert back.tolist() == [1, 14, 15, 6_000_000_000, 10] and front.tolist() == [0, 14, 15, 32, 0]


def test_sharding(spark, texts):
    rows = sorted(shard_by_bytes(table(spark, texts, list(range(100, 100 + len(texts)))), 5).collect(), key=lambda r: r.doc_id)
    sizes = [len((t or "").encode()) + 1 for t in texts]
    total, before, slots = sum(sizes), 0, collections.Counter()
    for r, n, t in zip(rows, sizes, texts, strict=True):
        shard = (2 * before + n) * 5 // (2 * total)
        assert (r.size, r.shard, r.slot, r.text_crc32) == (n, shard, slots[shard], zlib.crc32((t or "").encode()))
        slots[shard] += 1
        before += n


def test_sharding_splits_a_hot_key(spark):
    rows = shard_by_bytes(table(spark, ["same"] * 100, [None] * 50 + [7] * 50), 4).collect()
    assert collections.Counter(r.shard for r in rows) == {0: 25, 1: 25, 2: 25, 3: 25}
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(25)) for s in range(4))


def test_mixing_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 20), rng.choice(["en"] * 6 + ["fr"]), rng.choice(["web"] * 8 + ["books", None]), rng.choice(["a", "b", "b"]), 1) for i in range(4000)] + [(None, None, None, None, None, None), (1, "", "en", "web", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, mix_tokens int")
    goals = {m: spark.createDataFrame(v, f"{m} string, target double") for m, v in (("lang", [("en", 0.5), ("fr", 0.5)]), ("source", [("web", 0.5), ("books", 0.3), ("", 0.2)]), ("topic", [("a", 0.6), ("b", 0.4)]))}
    mixed = mix_sources(docs, targets=goals).cache()
    assert mixed.count() == 4002 and mixed.columns[:5] == ["doc_id", "text", "lang", "source", "topic"]
    tokens = F.sum(F.col("mix_tokens") * F.col("mix_rate"))
    total = mixed.agg(tokens).first()[0]
    assert total == pytest.approx(80_000, rel=1e-6)
    for r in mixed.groupBy("lang").agg(tokens.alias("t")).filter("lang is not null").collect():
        assert r.t / total == pytest.approx(0.5, abs=1e-6)
    drawn = mixed.agg(F.sum(F.col("mix_tokens") * F.col("mix_copies"))).first()[0]
    assert drawn == pytest.approx(80_000, rel=0.05)
    assert mix_sources(docs, budget=None).agg(F.max("mix_rate")).first()[0] == pytest.approx(1.0)


def test_decontamination(spark):
    rng = random.Random(6)
    items = [prose(rng, 30, 900) for _ in range(8)] + ["only five words stand here", None, "", prose(rng, 11, 900)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    swapped = items[1].split()
    for k in (4, 13, 22):
        swapped[k] = "other"
    texts = [prose(rng, 80, 900) for _ in range(20)] + [prose(rng, 40, 900) + " " + items[0].upper() + "! " + prose(rng, 9, 900), " ".join(swapped), " ".join(items[2].split()[5:20]), " ".join(items[3].split()[:7]), "so only five words stand here now", items[11], None, ""]
    got = {(r.doc_id, r.item_id): r for r in decontaminate(table(spark, texts), bench).collect()}
    assert set(got) == {(20, 0), (21, 1), (22, 2), (24, 8), (25, 11)}
    assert (got[20, 0].doc_start, got[20, 0].n_words, got[21, 1].n_same) == (40, 30, 27)


def test_channel_restores_words(spark):
    corpus = spark.createDataFrame([("stupid idiot trash loser moron pathetic people say hello and read the text " * 20,)], "text string")
    g = trigram_counts(corpus).toPandas()
    channel = Channel(g["gram"].to_numpy(), g["n"].to_numpy(float))
    for written, meant in (("stup1d", "stupid"), ("1d10t", "idiot"), ("tr@$h", "trash"), ("l0ooooser", "loser"), ("p4th3t1c!!!", "pathetic"), ("st-up.id", "stupid"), ("hello", "hello"), ("text", "text")):
        assert channel.restore(written) == meant
    assert {"stupid", "moron"} <= channel.words("you s t u p i d and m.o.r.o.n man")[0].keys()


def test_toxicity_holds_out(spark):
    rng = random.Random(7)
    texts, toxic = [], []
    for i in range(600):
        t = prose(rng, 40, 3000)
        bad = i % 5 == 0
        if bad:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["zorgle", "blimpf", "zorgle", "snarvit"]))
            t = " ".join(w)
        texts.append(t)
        toxic.append(int(bad))
    texts += [None, "", "z o r g l e you bl1mpf"]
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(toxic) if i < 400] + [(1, 0), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r.toxic_score for r in toxicity(table(spark, texts), labels).collect()}
    assert all((got[i] >= 0.7) == bool(toxic[i]) for i in range(400, 600))
    assert got[600] == got[601] < 0.1 and got[602] >= 0.7
    assert set(toxicity(table(spark, texts), labels.filter("toxic = 0")).select("toxic_score").distinct().toPandas().toxic_score) == {got[600]}


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(8)
    big = "".join(chr(rng.randrange(32, 0x24F)) for _ in range(300_000))
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", big, big, "\x1f\x8b\x08 not a member"] + [f"<i>{rng.random()}</i>" for _ in range(200)]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\nBad: {i}", h, "c") for i, h in enumerate(html)] + [(None, None, "<p>b</p>", "d")], "page_id long, url string, html string, uid string").repartition(3)
    folder = f"file://{tmp_path}/w"
    assert sum(r.records for r in W.write_warc(pages, folder).collect()) == 209
    for split in (1 << 20, 700):
        rows = W.read_warc(spark, folder, split).collect()
        assert len(rows) == 209
        for r in rows:
            body = (html[r.page_id] if r.page_id is not None else "<p>b</p>") or ""
            first = html.index(html[r.page_id]) if r.page_id is not None else 1
            first = 3 if body == "" else first
            assert (r.payload_bytes, r.payload_digest) == (len(body.encode()), W.payload_digest(body.encode()))
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
            if r.record_type == "response":
                assert r.payload == body.encode() and r.found_digest == r.payload_digest
    part = sorted((tmp_path / "w").glob("*.warc.gz"))[0]
    assert gzip.decompress(part.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_reader_passes_over_damage(spark, tmp_path):
    good = W._member([("WARC-Type", "response")], [b"x" * 50])
    (tmp_path / "d.warc.gz").write_bytes(b"junk\x1f\x8b\x08junk" + good + good[:20] + good)
    assert W.read_warc(spark, f"file://{tmp_path}").count() == 2


def test_empty_tables(spark):
    none = table(spark, [])
    assert substring_dedup(none).count() == suffix_dedup(none).count() == exact_dedup(none).count() == near_duplicates(none).count() == 0
    assert shard_by_bytes(none).count() == mix_sources(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity(none, labels).count() == lm_scores(none, labels).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(none, bench).count() == decontaminate(table(spark, ["a"]), bench).count() == 0


def test_empty_pages_make_no_archive(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = str(tmp_path / "none")
    assert W.write_warc(pages, folder).collect() == []
    assert W.read_warc(spark, folder).collect() == []
    (tmp_path / "bare").mkdir()
    assert W.read_warc(spark, str(tmp_path / "bare")).count() == 0
