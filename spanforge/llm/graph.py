"""Connected components of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed

#: Links that a task joins at a time.
LINKS = 100_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, LINKS at a time, as links of each node to the smallest that these join it to."""

    def joined_up(links: np.ndarray) -> pa.RecordBatch:
        parent = {n: n for n in np.unique(links).tolist()}

        def root(n: int) -> int:
            while parent[n] != n:
                parent[n] = n = parent[parent[n]]
            return n

        for a, b in links.tolist():
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array([root(n) for n in parent], pa.int64())], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in ("a", "b")], 1))
        n += batch.num_rows
        if n >= LINKS:
            yield joined_up(np.concatenate(held))
            held, n = [], 0
    if n:
        yield joined_up(np.concatenate(held))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of the links (a, b): label is the smallest node of its component.

    Tasks join LINKS of them at a time into stars, which leaves few rounds where links are few. Each round takes the least label
    among a node's neighbours, then that of its label's label, so that long chains shorten fast; it ends as labels only ever fall. Nodes that no link names are not in the result; a link from a
    node to itself names it.
    """
    links = checkpointed(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    links = links.coalesce(links.count() // LINKS + 1).mapInArrow(_stars, "a long, b long")
    edges = checkpointed(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a")).distinct())
    labels = checkpointed(edges.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = checkpointed(lower.join(far, "near").select("node", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("moved")))
        labels = after.select("node", "label")
        if after.filter("moved").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels of components() after further links; only the classes that these name are worked on."""
    own = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    between = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    step = components(between.filter("a <> b"))
    moved = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return checkpointed(moved.unionAll(step.join(labels, "node", "left_anti")))
