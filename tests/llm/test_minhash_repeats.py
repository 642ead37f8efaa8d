"""Links are set Jaccard: unequally repeated passages don't part texts."""

import random

from spanforge.llm.minhash import near_duplicates

from .test_operators import prose, table


def test_unequal_repeats(spark):
    rng, texts = random.Random(12), []
    for _ in range(6):
        rest, passage = prose(rng, 70, 9000), prose(rng, 30, 9000)
        texts += [" ".join([rest, passage, passage]), " ".join([rest, *[passage] * 300])]
    got = {r.doc_id: r.class_id for r in near_duplicates(table(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(12)}
