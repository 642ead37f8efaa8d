"""Golden cases, invariants and round trips of the engine's own operators."""

import json
import os
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanforge import plans
from spanforge.functions import fixed
from spanforge.functions import text as X
from spanforge.operators import dispatch as D
from spanforge.operators import ensemble as N
from spanforge.operators import evaluate as V
from spanforge.operators import extract as E
from spanforge.operators import models as MO
from spanforge.operators import privacy as P
from spanforge.operators import quality as Q
from spanforge.operators import routing as R
from spanforge.operators import spans as S
from spanforge.sources import files, sinks
from spanforge.streaming import monitor as M

SPAN = "doc_id long, text string, pii_type string, confidence double, start_pos int, end_pos int, extractor string, extractor_rank int"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_one_email(spark):
    rows = E.rule_spans(docs(spark, "Contact us at john.doe@example.com for more")).filter("pii_type = 'email_address'").collect()
    assert [(r.text, r.start_pos, r.end_pos) for r in rows] == [("john.doe@example.com", 14, 34)] and rows[0].confidence == 1.0


def test_types_of_a_record(spark):
    text = "Patient: John Smith\nDOB: 03/15/1985\nPhone: (555) 123-4567\nSSN: 123-45-6789\nCard 4111 1111 1111 1111, MRN-1234567\nsee https://x.org/a?b=1 or 10.0.0.1, IBAN FR1420041010050500013M02606"
    got = E.rule_spans(docs(spark, text)).collect()
    assert {"person_name", "date_of_birth", "phone_number", "social_security_number", "credit_card_number", "medical_record_number", "url", "ip_address", "iban"} <= {r.pii_type for r in got}
    assert all(text[r.start_pos : r.end_pos].strip() == r.text for r in got)


def test_no_spans(spark):
    assert E.rule_spans(docs(spark, "", None, "nothing to see here", "not@an", "4532-1234-5678-9012")).filter("pii_type in ('email_address', 'credit_card_number')").count() == 0


def test_rules_agree_with_a_plain_scan(spark):
    rng = random.Random(1)
    bits = ["a@b.co", "é@x.org", "06 12 34 56 78", "+33 6 12 34 56 78", "12/31/1999", "3 août 2020", "Jean Dupont", "Mme. Anne Roy", "12 Main Street", "EMP-12345", "1.2.3.4", "www.ab.com/x", "123456789", "AB123456", "Élan Vital", "😀", "\x01", "patient id 1234567"]
    texts = [" ".join(rng.choice(bits) for _ in range(12)) for _ in range(20)]
    got = {(r.doc_id, r.pii_type, r.text, r.start_pos, r.end_pos) for r in E.rule_spans(docs(spark, *texts)).collect()}
    want = set()
    for i, t in enumerate(texts):
        t = t.replace("\x01", " ")
        for kind, ignore, p in fixed.RULES:
            for m in re.finditer(p, t, re.I if ignore else 0) if kind in fixed.SPAN_TYPES else ():
                n = len(re.sub(r"\D", "", m[0]))
                ok = {"phone_number": 10 <= n <= 15, "social_security_number": 9 <= n <= 10, "credit_card_number": False}.get(kind, True)
                if ok:
                    want.add((i, kind, m[0].strip(), m.start(), m.end()))
    assert got == want


def test_dictionary(spark):
    got = E.dictionary_spans(docs(spark, "Our employee id is emp #12345, bank account #: 123456789; téléphone"), types=None).collect()
    assert {(r.pii_type, r.text) for r in got} >= {("employee_id", "employee id"), ("employee_id", "emp #12345"), ("financial_account", "account #: 123456789"), ("contact_info", "téléphone")}
    assert ("financial_account", "bank account") not in {(r.pii_type, r.text) for r in got}


def test_model_spans(spark):
    out = E.model_spans(docs(spark, "ab", None, "b"), lambda texts: [[("b", "X", 0.9, t.find("b"), t.find("b") + 1)] if "b" in t else [] for t in texts], "toy").collect()
    assert [(r.doc_id, r.start_pos, r.extractor) for r in out] == [(0, 1, "toy"), (2, 0, "toy")]


def spans(spark, *rows):
    return spark.createDataFrame([(0, t, k, c, s, s + len(t), x, r) for t, k, c, s, x, r in rows], SPAN)


@pytest.mark.parametrize(("predicted", "truth", "rates"), [(["a@b.c", "555"], ["a@b.c", "555"], (1, 1)), (["a@b.c"], ["a@b.c", "555"], (1, 0.5)), (["a@b.c", "x"], ["a@b.c"], (0.5, 1))])
def test_golden_rates(spark, predicted, truth, rates):
    make = lambda texts: spans(spark, *((t, "email_address", 0.9, 10 * ord(t[0]), "e", 0) for t in texts))
    r = V.overall(V.counts(make(predicted), make(truth))).first()
    assert (r["precision"], r["recall"]) == rates


def test_matches_are_one_to_one_and_know_aliases(spark):
    p = spans(spark, ("John Doe", "person_name", 0.9, 0, "e", 0), ("John Doe", "person_name", 0.9, 2, "e", 0))
    t = spans(spark, ("John Doe", "individual", 0.9, 2, "e", 0))
    m = V.match(p, t).collect()
    assert len(m) == 1 and m[0].p_start == 0 and m[0].score > 0.5


def test_votes(spark):
    s = spans(spark, ("John Doe", "person_name", 0.9, 5, "a", 0), ("john doe", "person_name", 0.5, 5, "b", 1), ("Jane", "person_name", 0.6, 40, "a", 0), ("x@y.z", "email_address", 0.9, 60, "b", 1))
    g = N.group_similar(s)
    assert {r.text for r in N.vote(g, "majority").collect()} == {"John Doe"}
    assert {r.text for r in N.vote(g, "union").collect()} == {"John Doe", "Jane", "x@y.z"}
    assert {r.text: round(r.confidence, 4) for r in N.vote(g, "weighted").collect()} == {"John Doe": round((0.81 + 0.25) / 1.4, 4), "x@y.z": 0.9}
    assert {r.text for r in N.vote(g, "consensus").collect()} == {"John Doe"}


def test_redaction_leaves_no_span(spark):
    d = docs(spark, "Mail a.b@c.org or call (555) 123-4567, card 4111-1111-1111-1111.", "none", None)
    found = E.rule_spans(d)
    out = {r.doc_id: r.text for r in P.redact(d, found).collect()}
    assert out == {0: "Mail ███@█████ or call (███) ███-████, card ████-████-████-1111.", 1: "none", 2: None}
    assert E.rule_spans(P.redact(d, found)).count() == 0


def test_tokens_come_back(spark):
    d = docs(spark, "Mail a.b@c.org or a.b@c.org, call 555-123-4567 now", "plain")
    found = E.rule_spans(d)
    hidden = P.tokenize(d, found, "s3")
    assert "a.b@c.org" not in hidden.first().text
    assert sorted(P.detokenize(hidden, P.token_vault(found, "s3")).collect()) == sorted(d.collect())
    assert P.token_vault(found, "s3", "00" * 16).filter("sealed is null").count() == 0
    shaped = d.select(P.shaped_token(F.col("text"), "s").alias("t")).first().t
    assert re.fullmatch(r"[A-Z][a-z]{3} [a-z]\.[a-z]@.*\d{3}-\d{3}-\d{4} [a-z]{3}", shaped)


def test_roles(spark):
    s = spans(spark, ("john@x.org", "email_address", 0.9, 0, "a", 0), ("4111", "credit_card_number", 0.95, 20, "a", 0), ("J D", "person_name", 0.5, 30, "a", 0))
    assert {r.text for r in S.for_role(s, "general_user").collect()} == {"john@x.org"}
    assert S.for_role(s, "nobody").count() == 3
    views = s.select(S.role_text(S.upper_type(F.col("pii_type")), F.col("text"), F.lit("partial")).alias("v")).collect()
    assert [r.v for r in views] == ["j**n@x.org", "4111", "J D"]


def test_checklists(spark):
    r = spark.createDataFrame([(True, True, True, ["encryption", "access_control"], None), (True, True, True, ["encryption"], True)], "purpose_defined boolean, retention_policy boolean, validation_enabled boolean, security_measures array<string>, processing_documented boolean")
    assert [(x.security, x.accountability, x.compliant) for x in P.checklist(r, P.GDPR).collect()] == [(True, False, False), (False, True, False)]


def test_cross_factor_and_review(spark):
    s = spans(spark, ("a@x.org", "EMAIL", 0.9, 0, "a", 0), ("b@x.org", "EMAIL", 0.9, 20, "a", 0), ("b@x.org", "EMAIL", 0.9, 40, "a", 0)).withColumnRenamed("pii_type", "kind")
    assert sorted(round(r.cross, 2) for r in Q.with_cross_factor(s).collect()) == [0.6, 0.8, 0.8]
    q = spark.createDataFrame([(10, 2, 0.8, 1, 3, 5, True)], "entities int, issues int, score double, high_issues int, document_priority int, complexity int, sensitive boolean")
    r = Q.review_queue(q).first()
    assert (r.minutes, r.priority) == (18, pytest.approx(2 + 5 + 6 + 3))


def test_split_is_whole_and_exact(spark):
    rows = spark.range(1000)
    got = {r.part: r["count"] for r in R.split(rows, "id", {"train": 0.7, "validation": 0.15, "test": 0.15}).groupBy("part").count().collect()}
    assert got == {"train": 700, "validation": 150, "test": 150}


def test_numbered_places_every_row(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(5000)], "id long, priority int").repartition(7)
    got = R.numbered(rows, [F.desc("priority"), F.col("id")], "place").collect()
    want = {i: n for n, (_, i) in enumerate(sorted((-(i % 3), i) for i in range(5000)), 1)}
    assert {r.id: r.place for r in got} == want and len(got) == 5000


def test_whole_texts_and_orders(spark, tmp_path):
    texts = [None, "", "short", "x" * 49, "y" * 50, "z" * 3000, "alone"]
    spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, f"ocr {i}") for i in range(6)] + [(6, 1, "later turn")], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, ["1-URGENT", "2-HIGH", "5-LOW"][i % 3]) for i in range(900)], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.doc_id: r.text for r in plans.QUERIES["o025_effective_whole_text"](spark, str(tmp_path)).collect()}
    assert got == {0: "ocr 0", 1: "ocr 1", 2: "short\nocr 2", 3: "x" * 49 + "\nocr 3", 4: "y" * 50, 5: "z" * 3000, 6: "alone"}
    orders = plans.QUERIES["o109_priority_ranks"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r.place for r in orders] == list(range(1, 901)) and [r.o_orderkey % 3 for r in orders] == [0] * 300 + [1] * 300 + [2] * 300
    assert plans.QUERIES["o110_review_ranks"](spark, str(tmp_path)).count() == len(texts)


def test_helpers(spark):
    d = spark.createDataFrame([("a b", "A  b ", 0, 4, 2, 6), ("", "", 0, 0, 0, 0), ("x y", "y z", 0, 2, 5, 9)], "a string, b string, p int, q int, r int, s int")
    got = d.select(X.word_jaccard(F.col("a"), F.col("b")).alias("j"), X.range_iou(*(F.col(c) for c in "pqrs")).alias("i")).collect()
    assert [(round(r.j, 3), round(r.i, 3)) for r in got] == [(1.0, 0.333), (1.0, 0.0), (0.333, 0.0)]


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes("héllo w\nx".encode() + b"\xff")
    (tmp_path / "in" / "sub" / "B.TXT").write_text("two words")
    (tmp_path / "in" / "c.exe").write_text("no")
    found = files.discover(spark, f"file://{tmp_path}/in")
    meta = files.metadata(found).cache()
    assert {r.file_name: r.content_type for r in meta.collect()} == {"a.txt": "text/plain", "B.TXT": "text/plain"}
    assert files.changed(meta, meta.limit(0)).count() == 2 and files.changed(meta, meta).count() == 0
    assert {r.word_count for r in files.read_text(found).collect()} == {2, 3}
    got = files.read_with(found, {"txt": lambda b: b.decode()}).collect()
    assert sorted((r.text is None, r.error is None) for r in got) == [(False, True), (True, False)]
    assert files.not_processed(found, found.filter("path like '%a.txt'")).count() == 1


def test_results_and_answers(spark, tmp_path):
    one = {"document_id": "d", "extraction_result": {"pii_entities": [{"text": "x", "type": "email", "confidence": 0.5, "start_pos": 1, "end_pos": 2}]}}
    (tmp_path / "r.json").write_text(json.dumps(one, indent=1))
    assert files.read_results(spark, str(tmp_path / "r.json")).first().pii_type == "email"
    a = spark.createDataFrame([(1, 'sure ```json\n{"extracted_information": {"names": ["A B", "C"], "emails": "e@x"}}\n```'), (2, "none")], "doc_id long, answer string")
    assert sorted((r.text, r.pii_type) for r in files.model_answer_spans(a).collect()) == [("A B", "PERSON"), ("C", "PERSON"), ("e@x", "EMAIL")]
    e = spark.createDataFrame([('{"value": "v", "label": "L", "start": 3, "end": 4}',)], "json string")
    r = files.coerced(e).first()
    assert (r.text, r.pii_type, r.start_pos, r.confidence) == ("v", "L", 3, 1.0)


def test_sinks(spark, tmp_path):
    d = docs(spark, "mail a@b.co", "nothing")
    s = E.rule_spans(d)
    sinks.export_dataset(d, s, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2
    sinks.save_results(s, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().pii_entities[0].text == "a@b.co"
    old, new = spark.createDataFrame([("m", 1, 0.1), ("n", 1, 0.2)], "model string, day int, v double"), spark.createDataFrame([("m", 1, 0.9)], "model string, day int, v double")
    assert {(r.model, r.v) for r in sinks.upserted(old, new, ["model", "day"]).collect()} == {("m", 0.9), ("n", 0.2)}


def test_alert_stream_agrees_with_its_batch_twin(spark, tmp_path):
    start, rng = datetime(2024, 1, 1), random.Random(9)
    rows = [{"metric": m, "timestamp": (start + timedelta(seconds=30 * k)).isoformat(), "value": rng.choice([50.0, 95.0, 96.0, 97.0])} for k in range(60) for m in ("cpu", "mem")]
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[40 * k : 40 * k + 40]))
        os.utime(tmp_path / "in" / f"{k}.json", (10**9 + k, 10**9 + k))  # the order in which the stream takes them
    schema = "metric string, timestamp timestamp, value double"
    stream = M.alerts_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), 90.0, True, 60)
    q = stream.writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("alerts").collect()))
    want = sorted(map(tuple, M.alerts_batch(spark.read.schema(schema).json(str(tmp_path / "in")), 90.0, True, 60).collect()))
    assert got == want and want


def test_window_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"metric": "m", "timestamp": f"2024-01-01T00:{k:02d}:00", "value": float(k)}) for k in range(60)))
    schema = "metric string, timestamp timestamp, value double"
    out = M.window_statistics(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("windows").collect()) == [15, 15, 15, 15]


def chunked(text, most):
    """Sentence packing, step by step."""
    out, now = [], ""
    for s in filter(None, (s.strip() for s in re.split("[.!?]+", text))):
        if len(now) + len(s) + 1 <= most:
            now = f"{now}. {s}" if now else s
        elif now:
            out.append(now)
            now = s
        else:
            for w in s.split():
                if len(now) + len(w) + 1 <= most:
                    now = f"{now} {w}" if now else w
                elif now:
                    out.append(now)
                    now = w
                else:
                    out.append(w)
    return [*out, now] if now else out or [text[:most]]


def test_chunks(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bbbb.", "cc!", "d" * 30, "e?"]) for _ in range(rng.randrange(40))) for _ in range(30)] + ["", "...", "x" * 50]
    got = {r.doc_id: r.c for r in docs(spark, *texts).select("doc_id", MO.chunks(F.col("text"), 24).alias("c")).collect()}
    assert got == {i: chunked(t, 24) for i, t in enumerate(texts)}


def test_bio_and_meta(spark):
    t = spark.createDataFrame([(0, 0, "Jean", "B-PER", 0.9), (0, 1, "Roy", "I-PER", 0.95), (0, 2, "at", "O", 0.99), (0, 3, "Acme", "B-ORG", 0.99), (0, 4, "x", "B-LOC", 0.5), (1, 0, "y", "I-PER", 0.99)], "doc_id long, position int, token string, tag string, confidence double")
    assert sorted((r.text, r.pii_type, round(r.confidence, 3)) for r in MO.bio_spans(t).collect()) == [("Acme", "organization", 0.99), ("Jean Roy", "person_name", 0.925)]
    s = spans(spark, *((f"n{k}", "person_name", 0.9 if k % 2 else 0.3, k + 1, "rule_based", 0) for k in range(40))).withColumn("context", F.lit(""))
    f = MO.span_features(s)
    assert {len(r.f) for r in f.collect()} == {25}
    good = MO.meta(N.exact_groups(f), MO.train_meta(MO.labelled(f, s.filter("confidence > 0.5"))))
    assert {int(r.text[1:]) % 2 for r in good.collect()} == {1} and good.count() == 20


def test_content_confidence(spark):
    rows = [("EMAIL", "a@b.c"), ("EMAIL", "ab"), ("PHONE", "514-555-0123 x"), ("PHONE", "555"), ("PERSON", "Ann  Lee"), ("PERSON", "Ann 2"), ("DATE", "x"), ("EMAIL", None), ("NEW", "")]
    got = spark.createDataFrame(rows, "k string, t string").select(F.round(S.content_confidence(F.col("k"), F.col("t")), 3).alias("c")).collect()
    assert [r.c for r in got] == [0.98, 0.65, 0.95, 0.7, 0.9, 0.7, 0.7, 0.65, 0.7]


def test_error_patterns_keep_the_first_texts(spark):
    rows = [("A", "x", f"t{k % 7}", 0.0 if k % 2 else 0.5) for k in range(40)] + [("A", None, None, 0.2), ("B", "x", "u", 0.0)]
    got = {r.pattern: (r.n, r.avg_confidence, r.examples) for r in Q.error_patterns(spark.createDataFrame(rows, "pii_type string, error string, text string, confidence double")).collect()}
    assert got == {"A_x": (40, 0.5, ["t0", "t1", "t2", "t3", "t4"]), "A": (1, 0.2, []), "B_x": (1, None, ["u"])}


def test_bootstrap_does_not_depend_on_partitions(spark):
    rows = spark.range(3000).selectExpr("id", "cast(id % 17 as double) AS v")
    one, two = (R.bootstrap(rows.repartition(n), "v", 20, key=["id"]).first() for n in (1, 7))
    assert abs(one.mean - two.mean) < 1e-9 and abs(one.variance - two.variance) < 1e-9


def test_models_against_truth(spark):
    schema = "doc_id long, pii_type string, text string, start_pos int, end_pos int"
    truth = spark.createDataFrame([(1, "email_address", "a@b.c", 0, 5), (2, "email", "d@e.f", 3, 8)], schema)
    found = spark.createDataFrame([(1, "email", "a@b.c", 0, 5, "m1"), (2, "email", "d@e.f", 3, 8, "m1"), (1, "email", "zz", 40, 42, "m2")], schema + ", extractor string")
    got = {(r.model, r.doc_id): (r.tp, r.fp, r.fn) for r in D.cross_evaluate(found, truth, V.counts).collect()}
    assert got == {("m1", 1): (1, 0, 0), ("m1", 2): (1, 0, 0), ("m2", 1): (0, 1, 1), ("m2", 2): (0, 0, 1)}
    assert D.cross_evaluate(found.limit(0), truth, V.counts).count() == 0


def test_equal_predictions_match_equal_truths(spark):
    span = "doc_id int, text string, pii_type string, start_pos int, end_pos int"
    p = spark.createDataFrame([(1, "Ann Lee", "person_name", 0, 7)] * 3 + [(2, "x", "location", 0, 1)], span)
    t = spark.createDataFrame([(1, "Ann Lee", "name", 0, 7)] * 2 + [(3, "y", "location", 0, 1)], span)
    assert V.match(p, t).count() == 2
    got = {r.kind: (r.tp, r.fp, r.fn) for r in V.counts(p, t).collect()}
    assert got == {"person_name": (2, 1, 0), "location": (0, 1, 1)}
    assert V.match(p.limit(0), t).count() == 0
    assert {(r.tp, r.fp, r.fn) for r in V.counts(p.limit(0), t).collect()} == {(0, 0, 2), (0, 0, 1)}


def test_greedy_choices_against_a_plain_loop(spark):
    """Matching and grouping in the order of places, held against loops over the same spans."""
    import random

    draw = random.Random(5)
    words = ["ann", "lee", "bo", "may"]
    make = lambda d: (d, " ".join(draw.choices(words, k=draw.randint(1, 3))), draw.choice(["person_name", "name"]), (a := draw.randint(0, 12)), a + draw.randint(1, 9))
    schema = "doc_id int, text string, pii_type string, start_pos int, end_pos int"
    p, t = ([make(d) for d in range(12) for _ in range(draw.randint(0, 9))] for _ in range(2))

    def score(a, b):
        both = max(min(a[4], b[4]) - max(a[3], b[3]), 0)
        iou = both / (a[4] - a[3] + b[4] - b[3] - both)
        x, y = set(a[1].split()), set(b[1].split())
        return 0.3 + 0.4 * iou + 0.3 * (len(x & y) / len(x | y))

    want = []
    for d in range(12):
        order = lambda r: (r[3], r[4], r[1])
        mine, free = sorted((r for r in p if r[0] == d), key=order), sorted((r for r in t if r[0] == d), key=order)
        for a in mine:
            best = max(free, key=lambda b: score(a, b), default=None)
            if best is not None and score(a, best) > 0.5:
                free.remove(best)
                want.append((d, *order(a), *order(best)))
    got = [(r.doc_id, r.p_start, r.p_end, r.p_text, r.t_start, r.t_end, r.t_text) for r in V.match(spark.createDataFrame(p, schema), spark.createDataFrame(t, schema)).collect()]
    assert sorted(got) == sorted(want) and want


def test_rewriting_inside_the_row_is_rewriting_by_join(spark):
    d = spark.createDataFrame([(1, "Mail ann@example.com, call 514-555-1234 or Dr. Ann Lee"), (2, ""), (3, None), (4, "nothing here"), (5, "Dr. Ann Lee, ann@example.com")], "doc_id int, text string")
    for f in (lambda docs, s: P.redact(docs, s), lambda docs, s: P.tokenize(docs, s, "k"), lambda docs, s: P.mixed(docs, s, "k"), lambda docs, s: P.highlight(docs, s)):
        inside = {r.doc_id: r.text for r in f(E.with_rule_spans(d), "spans").collect()}
        joined = {r.doc_id: r.text for r in f(d, E.rule_spans(d)).collect()}
        assert inside == joined and inside[3] is None and inside[2] == "" and "ann@example.com" not in inside[1].replace(">ann@example.com<", "")
