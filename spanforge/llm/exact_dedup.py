"""Exact dedup by recipes of content-defined chunks.

A text is cut where a rolling hash of its last bytes has a given form, so equal texts are cut alike.
Chunks meet once, by digest, and are compared byte for byte: a digest whose chunks all agree is a
verified identifier, a text with a digest that stands for different chunks has its own SHA-256 beside
its list. Texts are equal exactly if their ordered lists of identifiers are; only these lists go on, so a
long text is moved once, however many texts it equals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._shared import checkpointed

WINDOW = 16
_GEAR = (T.byte_table(7) >> T.U(32)).astype(np.uint32)


def cuts(data: np.ndarray, least: int, mask: int, most: int) -> list[int]:
    """Ends of the chunks of one text: after a rolling hash of 16 bytes with mask zero, at least `least` and at most `most` apart."""
    n = len(data)
    if not n:
        return []
    h, span = _GEAR[data], 1
    while span < WINDOW and n > span:  # h[i] covers the last 2 * span bytes up to i
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    ends, last = [], 0
    for c in (np.flatnonzero((h >> np.uint32(7)) & np.uint32(mask) == 0) + 1).tolist():
        while c - last > most:
            last += most
            ends.append(last)
        if c - last >= least:
            ends.append(c)
            last = c
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 512, mask: int = 0x3FF, most: int = 16384) -> DataFrame:
    """Groups equal texts: those identical after lower-casing A to Z only; null counts as empty.

    Returns key, keep_id (the largest key of the group, null only if all are), group_size, kept and
    text_sha256 (of the normalised text in UTF-8) for each row. One row of a group is kept, that with
    the largest key; of rows that tie, the last in the scan. Empty texts form one group. Other
    columns are not read.
    """
    rows = docs.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("uid"), F.col(text).alias("text"))

    def chunked(tables: Iterator[pa.RecordBatch], with_chunks: bool) -> Iterator[pa.RecordBatch]:
        for table in T.small(tables):
            data, offs = T.buffers(table.column("text"))
            raw = data.tobytes().lower()  # bytes.lower() changes A to Z only
            data = np.frombuffer(raw, np.uint8)
            for i, j in T.pieces(offs, 4 << 20):
                ends = [cuts(data[lo:hi], least, mask, most) for lo, hi in zip(offs[i:j].tolist(), offs[i + 1 : j + 1].tolist(), strict=True)]
                chunks = [[raw[a + lo : b + lo] for a, b in zip([0, *e], e, strict=False)] for lo, e in zip(offs[i:j].tolist(), ends, strict=True)]
                digests = [[xxhash.xxh3_64_intdigest(c) - (1 << 63) for c in x] for x in chunks]
                part = table.slice(i, j - i)
                if with_chunks:
                    yield pa.RecordBatch.from_arrays([pa.array([d for x in digests for d in x], pa.int64()), pa.array([c for x in chunks for c in x], pa.binary())], ["digest", "chunk"])
                else:
                    sha = [hashlib.sha256(raw[lo:hi]).hexdigest() for lo, hi in zip(offs[i:j].tolist(), offs[i + 1 : j + 1].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("uid"), pa.array(digests, pa.list_(pa.int64())), pa.array(np.diff(offs[i : j + 1]), pa.int64()), pa.array(sha, pa.string())], ["id", "uid", "recipe", "n_bytes", "text_sha256"])

    # Chunks meet by digest. Where least and greatest agree, all do, and the digest is verified.
    chunks = rows.select("text").mapInArrow(lambda t: chunked(t, True), "digest long, chunk binary")
    met = chunks.groupBy("digest").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    shared = checkpointed(met.filter("lo <> hi").select("digest"))  # next to none

    schema = f"id {rows.schema['id'].dataType.simpleString()}, uid long, recipe array<long>, n_bytes long, text_sha256 string"
    recipes = checkpointed(rows.mapInArrow(lambda t: chunked(t, False), schema))
    spoilt = recipes.select("uid", F.explode("recipe").alias("digest")).join(shared, "digest", "left_semi").select("uid", F.lit(True).alias("spoilt")).distinct()
    exact = F.when(F.col("spoilt"), F.col("text_sha256")).otherwise("")
    named = recipes.join(spoilt, "uid", "left").withColumn("exact", exact)

    # A group's row goes back to its members by all three columns, of which n_bytes adds nothing but
    # makes both sides of the join be dealt anew, so that Spark can split the members of a hot group.
    groups = named.groupBy("recipe", "exact").agg(F.max("n_bytes").alias("n_bytes"), F.max(F.struct("id", "uid")).alias("keep"), F.count("*").alias("group_size"))
    joined = named.join(groups, ["recipe", "exact", "n_bytes"])
    return joined.select(F.col("id").alias(key), F.col("keep.id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept"), "text_sha256", "n_bytes", F.size("recipe").alias("n_chunks"))
