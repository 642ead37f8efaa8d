"""Connected components against a plain search, with links in one task and in many."""

import random

import pytest

from spanforge.llm import graph as G


def searched(links):
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {}
    for n in sorted(near):
        todo = [] if n in label else [n]
        while todo:
            if label.setdefault(m := todo.pop(), n) == n:
                todo += [o for o in near[m] if o not in label]
    return label


@pytest.mark.parametrize("limit", [G.LINKS, 40])
def test_components_and_joined(spark, monkeypatch, limit):
    monkeypatch.setattr(G, "LINKS", limit)
    rng = random.Random(8)
    ids = rng.sample(range(10**12), 400)
    links = [(ids[k], ids[k + 1]) for k in range(20)] + [(rng.choice(ids[130:300]), rng.choice(ids[130:300])) for _ in range(60)] + [(ids[320], ids[320])]
    more = [(ids[5], ids[140]), (ids[350], ids[351]), (ids[351], ids[140])]
    rng.shuffle(links)
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long").repartition(6)
    label = G.components(frame(links))
    assert {r.node: r.label for r in label.collect()} == searched(links)
    assert {r.node: r.label for r in G.joined(label, frame(more)).collect()} == searched(links + more)
    assert G.components(frame([])).count() == 0
