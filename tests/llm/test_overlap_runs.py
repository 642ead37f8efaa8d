"""Every run of enough words that agree well enough counts, whatever stands at its ends or beside it."""

import random

import numpy as np

from spanforge.llm.decontaminate import _run, decontaminate

from .test_operators import prose, table


def test_runs_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(600):
        same = rng.random(rng.integers(0, 40)) < rng.choice([0.5, 0.75, 0.85])
        agree = [int(same[a:b].sum()) for a in range(len(same)) for b in range(a + 13, len(same) + 1) if same[a:b].sum() >= 0.8 * (b - a) - 1e-9]
        run = _run(same, 13, 0.8)
        assert (run is None) == (not agree)
        if run:
            a, b = run
            assert b - a >= 13 and same[a:b].sum() == max(agree) and same[a:b].sum() >= 0.8 * (b - a) - 1e-9


def test_mismatches_near_an_end_and_weak_surroundings(spark):
    rng = random.Random(8)
    items = [prose(rng, 15, 900), prose(rng, 74, 900), prose(rng, 6, 900), prose(rng, 11, 900)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def swap(text, *at):
        return " ".join("other" if k in at else w for k, w in enumerate(text.split()))

    texts = [swap(items[0], 1, 13), swap(items[1], *range(15, 74, 4), *range(16, 74, 12)), swap(items[2], 0), swap(items[3], 0, 10), swap(items[2], 0, 5), swap(items[3], 0, 5, 10)]
    got = {(r.doc_id, r.item_id) for r in decontaminate(table(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3)}
