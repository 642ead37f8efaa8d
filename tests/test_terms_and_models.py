"""Dictionaries as tables, the tagger and nested answers, against brute force."""

import itertools
import json
import random
import re

import numpy as np
import pytest

from spanforge.operators import answers as W
from spanforge.operators import extract as E
from spanforge.operators import tagger as G
from spanforge.operators import terms as T
from spanforge.sources import files as S


def term_rows(spark, terms, **flags):
    rows = [(f"d{i % 3}", "organization", t, 0.5, ["near"] if i % 2 else [], flags.get("case_sensitive", False), flags.get("word_boundaries", True)) for i, t in enumerate(terms)]
    return spark.createDataFrame(rows, T.TERM)


def occurrences(texts, terms, case_sensitive=False, word_boundaries=True):
    """Every place of every term, overlapping ones too."""
    out = set()
    for d, text in enumerate(texts):
        for i, t in enumerate(terms):
            edge = r"\b" if word_boundaries else ""
            for m in re.finditer(f"(?={edge}({re.escape(t)}){edge})", text or "", 0 if case_sensitive else re.IGNORECASE):
                out.add((d, m.start(1), m.end(1), m[1], f"d{i % 3}"))
    return out


TEXTS = ["account # 12, Account #3 and ACCOUNT", "a-b a-b-a b_a été Été ÉTÉ", None, "", "xx near the one two three four", "one two one two one", "#tag x#tag ##", "\U0001f600 smile \U0001f600\U0001f600", "word" * 300]
TERMS = ["account", "account #", "a-b", "b", "été", "one two", "one two three", "two one", "#tag", "smile \U0001f600", "\U0001f600", "wordword", "x", "x#tag", "three four", "one two one"]


@pytest.mark.parametrize("flags", [{}, {"case_sensitive": True}, {"word_boundaries": False}, {"word_boundaries": False, "case_sensitive": True}])
@pytest.mark.parametrize("slice_terms", [T.SLICE, 4])
def test_term_spans_against_regular_expressions(spark, flags, slice_terms):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = T.term_spans(docs, term_rows(spark, TERMS, **flags), slice_terms=slice_terms).collect()
    want = {x for x in occurrences(TEXTS, TERMS, **flags) if len(x[3]) >= 2 and len(re.sub(r"[^\w\s]", "", x[3])) >= 0.3 * len(x[3])}
    assert {(r.doc_id, r.start_pos, r.end_pos, r.text, r.dictionary) for r in rows} == want and len(rows) == len(want)
    assert all(TEXTS[r.doc_id][r.start_pos : r.end_pos] == r.text and r.text in r.context for r in rows)


def test_many_terms_from_a_table(spark):
    """100,000 terms; those that stand in the texts are found, and the join is no broadcast beyond its checked size."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(3000)]
    terms = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(200_000)})[:100_000]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start_pos, r.end_pos) for r in T.term_spans(docs, term_rows(spark, terms)).collect()}
    known, want = set(terms), set()
    for d, text in enumerate(texts):
        ends = [m.span() for m in re.finditer(r"\S+", text)]
        for i in range(len(ends)):
            for j in range(i, min(i + 3, len(ends))):
                if text[ends[i][0] : ends[j][1]] in known:
                    want.add((d, ends[i][0], ends[j][1]))
    assert len(terms) == 100_000 and got == want and len(want) > 1000


def test_longest_spans_lie_side_by_side(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    spans = T.term_spans(docs, term_rows(spark, TERMS))
    rows = sorted(T.longest(spans).collect(), key=lambda r: (r.doc_id, r.start_pos))
    assert [r.text for r in rows if r.doc_id == 4] == ["one two three"]
    assert [r.text for r in rows if r.doc_id == 5] == ["one two one", "two one"]
    for a, b in itertools.pairwise(rows):
        assert a.doc_id != b.doc_id or a.end_pos <= b.start_pos


def test_dictionaries_from_files_find_their_terms(spark, tmp_path):
    one = {"name": "teams", "description": "x", "pii_type": "organization", "terms": ["Red Team", "", None], "patterns": ["r\\d"], "case_sensitive": True, "confidence_score": 0.9}
    (tmp_path / "a.json").write_text(json.dumps([one, {"name": "empty", "pii_type": "location", "confidence_score": 0.5}]))
    dictionaries = S.read_dictionaries(spark, str(tmp_path))
    info = {r.name: r for r in T.dictionary_info(dictionaries).collect()}
    assert (info["teams"].terms_count, info["teams"].patterns_count, info["empty"].terms_count, info["empty"].word_boundaries) == (2, 1, 0, True)
    docs = spark.createDataFrame([(1, "the Red Team and the red team")], "doc_id long, text string")
    assert [(r.text, r.start_pos, r.confidence) for r in T.term_spans(docs, T.term_table(dictionaries)).collect()] == [("Red Team", 4, 0.9)]
    assert T.term_spans(docs, T.term_table(dictionaries.filter("name <> 'teams'"))).count() == 0  # a dictionary taken out


def test_viterbi_and_shares_against_all_sequences():
    rng = np.random.default_rng(2)
    tags = ["B-x", "I-x", "O"]
    step, shows = (rng.dirichlet(np.ones(n), 3) for n in (3, G.SHAPES))
    step[2, 1] = 0
    step /= step.sum(1, keepdims=True)
    with np.errstate(divide="ignore"):
        model = G.Tagger(tags, np.log(step), np.log(shows))
    for _ in range(30):
        shapes = rng.integers(0, G.SHAPES, 5).tolist()
        score = {}
        for s in itertools.product(range(3), repeat=5):
            path = [2, *s, 2]
            with np.errstate(divide="ignore"):
                score[s] = sum(np.log(step[a, b]) for a, b in itertools.pairwise(path)) + sum(np.log(shows[t, x]) for t, x in zip(s, shapes, strict=True))
        best = tuple(model.likeliest(shapes))
        assert score[best] == pytest.approx(max(score.values()))
        total = np.logaddexp.reduce(list(score.values()))
        own = np.logaddexp.reduce([v for s, v in score.items() if s[1:3] == best[1:3]])
        assert model.shares(shapes, [(1, 3, list(best[1:3]))]) == [pytest.approx(float(np.exp(own - total)))]
    assert model.likeliest([]) == []


def test_tagger_learns_and_places_its_spans(spark):
    rng = random.Random(8)
    filler = "the report of was sent on and then again with all the usual notes about it".split()

    def doc():
        out = []
        for _ in range(60):
            out.append(rng.choice(filler))
            if rng.random() < 0.12:
                out.append(rng.choice([f"{rng.choice('abc')}{rng.randrange(99)}@mail.org", f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}", "Anna Berg", "Paul Lenz"]))
        return " ".join(out)

    texts = [doc() for _ in range(60)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = G.fitted(G.counted(E.with_rule_spans(docs.filter("doc_id < 40"))))
    held = docs.filter("doc_id >= 40")
    got = G.with_text(G.stitched(G.tagged(G.windows(held, 120, 40), model, overlap=40)), held).collect()
    assert all(texts[r.doc_id][r.start_pos : r.end_pos] == r.text and 0 < r.confidence <= 1 + 1e-9 for r in got)
    truth = {(r.doc_id, r.start_pos, r.end_pos, r.pii_type) for r in E.rule_spans(held).collect() if r.pii_type in ("email_address", "person_name", "social_security_number")}
    said = {(r.doc_id, r.start_pos, r.end_pos, r.pii_type) for r in got}
    f1 = 2 * len(truth & said) / (len(truth) + len(said))
    print("held-out F1", f1)
    assert f1 > 0.9


@pytest.mark.parametrize("most, overlap", [(50, 20), (64, 0), (30, 29), (1000, 100)])
def test_windows_and_stitching(spark, most, overlap):
    rng = random.Random(most)
    texts = ["".join(rng.choice("ab  ") for _ in range(n)) for n in (0, 1, 49, 50, 51, 200, 333)] + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = G.windows(docs, most, overlap)
    rows = cut.collect()
    assert all(texts[r.doc_id][r.at : r.at + most] == r.text for r in rows)
    for d, text in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.at)
        assert (not own) == (not text)
        if own:
            assert own[0].first and own[-1].last and own[-1].at + len(own[-1].text) == len(text)
            assert all(b.at - a.at == most - overlap for a, b in itertools.pairwise(own))

    def runs(batch):
        return [[(m[0], "run", 0.5, *m.span()) for m in re.finditer("[ab]+", t)] for t in batch]

    if overlap >= 20:  # runs are far shorter than that
        got = {(r.doc_id, r.start_pos, r.end_pos) for r in G.stitched(G.tagged(cut, runs, overlap=overlap)).collect()}
        assert got == {(d, *m.span()) for d, t in enumerate(texts) for m in re.finditer("[ab]+", t or "")}
    long = spark.createDataFrame([(1, "x" * 500)], "doc_id long, text string")
    whole = G.stitched(G.tagged(G.windows(long, 64, 16), lambda ts: [[(t, "x", 0.5, 0, len(t))] for t in ts], overlap=16)).collect()
    assert [(r.start_pos, r.end_pos) for r in whole] == [(0, 500)]


def test_nested_answers(spark):
    text = "Anna Berg (a@b.org) and anna berg, then Anna Berg; call 555-1234. Acme"
    info = {"names": ["Anna Berg", "Anna Berg", " Anna Berg ", "Nobody", "", None], "contact_info": {"emails": ["a@b.org"], "phones": [{"home": "555-1234", "office": None}], "deep": {"er": {"organizations": "ACME"}}}, "count": 3, "none": {}, "empty": []}
    answers = [
        (1, text, f"Sure:\n```json\n{json.dumps({'extracted_information': info})}\n```"),
        (2, text, "no json {"), (3, text, None), (4, None, json.dumps({"extracted_information": {"emails": "x@y.z"}})), (5, text, "{}"),
    ]
    rows = W.answer_spans(spark.createDataFrame(answers, "doc_id long, text string, answer string")).collect()
    got = {(r.path, r.pii_type, r.text, r.start_pos) for r in rows if r.doc_id == 1}
    assert got == {
        ("$.names[0]", "PERSON", "Anna Berg", 0), ("$.names[1]", "PERSON", "Anna Berg", 40), ("$.names[2]", "PERSON", "Anna Berg", got_third(text)), ("$.names[3]", "PERSON", "Nobody", None),
        ("$.contact_info.emails[0]", "EMAIL", "a@b.org", 11), ("$.contact_info.phones[0].home", "PHONE", "555-1234", text.index("555")), ("$.contact_info.deep.er.organizations", "ORGANIZATION", "ACME", text.index("Acme")),
        ("$.count", "COUNT", "3", text.index("3")),
    }
    assert [(r.doc_id, r.text, r.start_pos, r.end_pos) for r in rows if r.doc_id > 1] == [(4, "x@y.z", None, None)]


def got_third(text):
    """The third place of the name counts in any case, as it stands twice as written."""
    return [m.start() for m in re.finditer("anna berg", text.lower())][2]


def test_answers_deeper_than_followed_stay_json(spark):
    deep = {"names": {"a": {"b": {"c": {"d": {"e": ["x"]}}}}}}
    rows = W.answer_spans(spark.createDataFrame([(1, "x", json.dumps({"extracted_information": deep}))], "doc_id long, text string, answer string"), depth=2).collect()
    assert [(r.path, r.pii_type) for r in rows] == [("$.names.a", "PERSON")] and json.loads(rows[0].text) == deep["names"]["a"]
