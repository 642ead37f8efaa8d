"""Near-duplicate classes with ProbMinHash, banding and verification.

The distinct shingles of a text weigh as the square root of their bytes, so that runs of short words say less; how often one
repeats doesn't count. Each sends arrivals of a Poisson process, at the rate of its weight, to random registers of a
signature; a register keeps the shingle that arrives first. A shingle stops once its next arrival comes after every register of the
text was reached. Two signatures agree in a register with the probability Jaccard similarity of the texts, which for weights that
a shingle has in any text is the weight of the shingles they share over that of all they have. Links are verified by this measure.

1. Texts with equal words make one node. 2. Bands of registers give buckets; each node is paired
with the first and the last node of its buckets. 3. The likeliest pairs by signature are verified on
the shingles; verified links make classes. 4. In buckets that still hold several classes, rows ask
their likeliest partners of other classes, and at last all close pairs across classes are verified
in place, so that no class that a link within a bucket would join stays apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from . import _text as T
from ._shared import checkpointed, free_name, with_place
from .graph import components, joined

BANDS, IN_BAND = 20, 5
REGISTERS = BANDS * IN_BAND
#: Share of equal registers from which a pair is verified; about four standard deviations below 0.8.
CLOSE = 0.64
#: Bytes of a shingle in a set.
WIDTH = 7
#: Nodes of a hot bucket that are compared with each other in one place.
BLOCK = 2000
#: Sets that are compared with another at a time, and their bytes (more for one that is longer).
AT_ONCE, AT_ONCE_BYTES = 64, 8 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, their rows and the bytes of their words (65,535 for more), sorted by row; and two hashes of each row's words (0 if it has none)."""
    s, e, begin = T.words(data, offsets, T.PUNCT)
    one = T.prefix(T.word_hashes(data, s, e))
    at = T.windows(begin, n)
    row = np.searchsorted(begin, at, "right") - 1
    size = np.diff(begin)
    short = np.flatnonzero((size > 0) & (size < n))  # fewer words than a shingle has: all of them are one
    h = np.concatenate([T.span_hash(one, at, at + n), T.span_hash(one, begin[:-1][short], begin[1:][short])])
    row = np.concatenate([row, short])
    long = np.concatenate([[0], np.cumsum(e - s)])
    long = np.concatenate([long[at + n] - long[at], long[begin[1:][short]] - long[begin[:-1][short]]])
    _, first = np.unique(T.mix(h + row.astype(T.U) * T.U(0x9E3779B97F4A7C15)), return_index=True)
    first = first[np.lexsort((h[first], row[first]))]
    two = T.prefix(T.word_hashes(data, s, e, 2))
    whole = [np.where(size > 0, T.span_hash(x, begin[:-1], begin[1:]), T.U(0)) for x in (one, two)]
    return h[first], row[first], np.minimum(long[first], 0xFFFF), *whole


def signatures(h: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """ProbMinHash signatures: for each row and register the shingle that arrives first."""
    time = np.full(rows * REGISTERS, np.inf)
    owner = np.zeros(rows * REGISTERS, T.U)
    now, k = np.zeros(len(h)), 0
    while len(h):
        k += 1
        u = T.mix(h ^ T.U(k * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        now = now - np.log(((u >> T.U(11)).astype(float) + 0.5) / (1 << 53)) / weight
        slot = row * REGISTERS + (T.mix(u) % T.U(REGISTERS)).astype(np.int64)
        np.minimum.at(time, slot, now)
        won = now == time[slot]
        owner[slot[won]] = h[won]
        last = time.reshape(rows, REGISTERS).max(1)
        on = now < last[row]
        h, row, weight, now = h[on], row[on], weight[on], now[on]
    return owner.reshape(rows, REGISTERS)


def _lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return T.buffers(pc.utf8_lower(pc.fill_null(column, "")))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, id, two hashes of the words, the signature in bytes and the keys of its bands."""
    for table in T.small(batches):
        data, offs = _lowered(table.column("text"))
        for i, j in T.pieces(offs):
            h, row, long, a, b = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            sign = signatures(h, row, np.sqrt(long), j - i)
            bands = np.zeros((j - i, BANDS), T.U)
            for k in range(IN_BAND):
                bands = T.mix(bands + sign[:, k::IN_BAND])
            bands = T.mix(bands + np.arange(BANDS, dtype=T.U)).view(np.int64)
            ends = pa.array(np.arange(0, (j - i) * BANDS + 1, BANDS), pa.int32())
            body = np.ascontiguousarray((sign & T.U(0xFF)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays(
                [table.column("uid").slice(i, j - i), table.column("id").slice(i, j - i), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([x.tobytes() for x in body], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1)))],
                ["uid", "id", "words_a", "words_b", "sign", "bands"],
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid and the text's distinct shingles, in order: 40 bits of each, and its bytes."""
    for table in T.small(batches):
        data, offs = _lowered(table.column("text"))
        for i, j in T.pieces(offs):
            h, row, long, _, _ = shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            at = np.searchsorted(row, np.arange(j - i + 1))
            low = np.empty((len(h), WIDTH), np.uint8)
            low[:, :5] = (h >> T.U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            low[:, 5:] = long.astype("<u2").view(np.uint8).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([table.column("uid").slice(i, j - i), pa.array([low[p:q].tobytes() for p, q in zip(at, at[1:], strict=False)], pa.binary())], ["uid", "shingles"])


def _set(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and their weights."""
    rows = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, :5] = rows[:, :5]
    return out.reshape(-1).view("<u8"), np.sqrt(np.ascontiguousarray(rows[:, 5:]).reshape(-1).view("<u2"))


def _similar(one: bytes, others: list[bytes], similarity: float) -> np.ndarray:
    """Which of the other sets have at least the given similarity to one."""
    (a, of_a), (b, of_b) = _set(one), _set(b"".join(others))
    of = np.repeat(np.arange(len(others)), [len(raw) // WIDTH for raw in others])
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    shared = a[at] == b
    both, weight = (np.bincount(of[x], of_b[x], len(others)) for x in (shared, slice(None)))
    return both >= similarity * (of_a.sum() + weight - both) - 1e-9


def _registers(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, REGISTERS)


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        same = (_registers(t.column("sign_a").to_pylist()) == _registers(t.column("sign_b").to_pylist())).mean(1) if t.num_rows else np.zeros(0)
        keep = pa.array(same >= CLOSE)
        yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep), pa.array(same).filter(keep)], ["a", "b", "close"])


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least the given Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = pa.array([bool(_similar(x, [y], similarity)[0]) for x, y in zip(t.column("sa").to_pylist(), t.column("sb").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([t.column("a").filter(keep), t.column("b").filter(keep)], ["a", "b"])

    left, right = (sets.select(F.col("uid").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    return checkpointed(pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long"))


PAIRS = {"a": pa.int64(), "b": pa.int64()}


def _buckets_in(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Each bucket's two blocks: the rows, and which of them are in the first and in the second block."""
    t = table.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("uid", "ascending")])
    key, i, j, block = (t.column(c).to_numpy() for c in ("key", "i", "j", "block"))
    edge = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1), len(key)]
    for lo, hi in zip(edge, edge[1:], strict=False):
        if hi > lo:
            yield t.slice(lo, hi - lo), np.flatnonzero(block[lo:hi] == i[lo]), np.flatnonzero(block[lo:hi] == j[lo])


def _close_across(part: pa.Table, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of the left block the rows of the right one in another class and with a close signature, and how close."""
    label, sign = part.column("label").to_numpy(), _registers(part.column("sign").to_pylist())
    own = part.column("i")[0] == part.column("j")[0]
    for x in left.tolist():
        y = right[right > x] if own else right
        y = y[label[y] != label[x]]
        if len(y):
            same = (sign[y] == sign[x]).mean(1)
            if (same >= CLOSE).any():
                yield x, y[same >= CLOSE], same[same >= CLOSE]


def _nearest(most: int):
    """The `most` likeliest partners across classes of each row of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        out = [np.zeros((2, 0), np.int64)]
        for part, left, right in _buckets_in(table):
            uid = part.column("uid").to_numpy()
            for x, y, same in _close_across(part, left, right):
                y = y[np.argsort(-same, kind="stable")[:most]]
                out.append(np.stack([np.minimum(uid[x], uid[y]), np.maximum(uid[x], uid[y])]))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": pa.array(a, PAIRS["a"]), "b": pa.array(b, PAIRS["b"])})

    return run


def _still_open(table: pa.Table) -> pa.Table:
    """The rows of buckets that are close to one of another class."""
    keys, uids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part, left, right in _buckets_in(table):
        near = np.zeros(part.num_rows, bool)
        for x, y, _ in _close_across(part, left, right):
            near[x] = near[y] = True
        keys.append(part.column("key").to_numpy()[near])
        uids.append(part.column("uid").to_numpy()[near])
    return pa.table({"key": pa.array(np.concatenate(keys), pa.int64()), "uid": pa.array(np.concatenate(uids), pa.int64())})


def _every_link(similarity: float):
    """Verifies all close rows of different classes of a bucket, but for classes that a link found here has joined.

    Two rows with several buckets in common are compared in that of their first common band.
    """

    def run(table: pa.Table) -> pa.Table:
        found = []
        for part, left, right in _buckets_in(table):
            uid, label, key = part.column("uid").to_numpy(), part.column("label").to_pylist(), part.column("key")[0].as_py()
            bands = part.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            raw, parent = part.column("shingles"), {}
            size = pc.binary_length(raw).to_numpy()

            def root(c: int, parent: dict[int, int] = parent) -> int:
                while c in parent:
                    c = parent[c]
                return c

            for x, ys, same in _close_across(part, left, right):
                common = (bands[ys] == bands[x]).argmax(1)
                ys = ys[np.argsort(np.where(bands[x][common] == key, -same, 1), kind="stable")[: (bands[x][common] == key).sum()]]
                one = raw[x].as_py()
                while len(ys := ys[[root(label[y]) != root(label[x]) for y in ys.tolist()]] if len(ys) else ys):
                    n = max(1, min(AT_ONCE, int(np.searchsorted(np.cumsum(size[ys]), AT_ONCE_BYTES, "right"))))
                    for y in ys[:n][_similar(one, [raw[y].as_py() for y in ys[:n].tolist()], similarity)].tolist():
                        a, b = root(label[x]), root(label[y])
                        if a != b:
                            parent[max(a, b)] = min(a, b)
                            found.append(sorted((int(uid[x]), int(uid[y]))))
                    ys = ys[n:]
        return pa.table({"a": pa.array([a for a, _ in found], PAIRS["a"]), "b": pa.array([b for _, b in found], PAIRS["b"])})

    return run


def near_duplicates(docs: DataFrame, similarity: float = 0.8, text: str = "text", key: str = "doc_id", place: str | None = None, with_links: bool = True) -> DataFrame:
    """Classes of near-duplicates: texts linked by a probability Jaccard similarity of at least `similarity` on weighted five-word shingles.

    Returns key, uid (the row's place: the column place, no two rows of which are equal, or else its
    place in the files), class_id (the smallest key of the class), class_size, n_links (how many other texts this one was verified to
    be linked with), linked_id (the key of one of them, of the smallest place; null if n_links is 0) and kept for each row. Without with_links, n_links and linked_id are left out. Verified links join a class;
    those that would join what is joined already are not all looked for.
    One row of a class is kept, that with the smallest key, null last; of rows that tie, the first by place. Words are lower-cased runs of letters and digits;
    a text of fewer than five words is one shingle; texts without words, null ones included, are one
    class; rows that repeat are one class; other columns are not read.
    """
    if place is None:
        docs = with_place(docs, place := free_name(docs, "place"))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(place).alias("uid"))
    signed = checkpointed(rows.mapInArrow(_signed, f"uid long, id {rows.schema['id'].dataType.simpleString()}, words_a long, words_b long, sign binary, bands array<long>"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid"))
    same = signed.groupBy("words_a", "words_b").agg(F.min("uid").alias("node"), first.alias("first"), F.count("*").alias("n"))
    same = checkpointed(same)
    nodes = signed.join(same.filter("words_a <> 0 or words_b <> 0").select(F.col("node").alias("uid")), "uid", "left_semi").select("uid", "sign", "bands")

    # Buckets of two or more. key and its parity: two columns, so that Spark deals both sides of the
    # join anew and can split the members of a hot bucket.
    member = nodes.select("uid", F.explode("bands").alias("key"))
    bucket = member.groupBy("key").agg(F.min("uid").alias("low"), F.max("uid").alias("high"), F.count("*").alias("size")).filter("low < high")
    parity = F.pmod("key", F.lit(2)).alias("parity")
    member = checkpointed(member.select("uid", "key", parity).join(bucket.select("*", parity), ["key", "parity"]).select("uid", "key", "low", "high", "size"))
    ends = F.explode(F.array("low", "high"))
    pairs = member.select("uid", ends.alias("other")).filter("uid <> other").select(F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b")).distinct()
    left, right = (nodes.select(F.col("uid").alias(k), F.col("sign").alias(f"sign_{k}")) for k in "ab")
    close = pairs.join(left, "a").join(right, "b").mapInArrow(_agree, "a long, b long, close double")

    # The two likeliest partners of each node come first; a node has at most two pairs for each band.
    asked = close.select("a", "b", "close", F.explode(F.array("a", "b")).alias("of"))
    partner = F.when(F.col("of") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    ranked = asked.groupBy("of").agg(F.max(F.struct("close", partner.alias("with"))).alias("one")).select(F.col("of"), F.col("one.with").alias("with"))
    likely = checkpointed(ranked.select(F.least("of", "with").alias("a"), F.greatest("of", "with").alias("b")).distinct())
    texts = member.select("uid").distinct()
    sets = checkpointed(rows.select("uid", "text").join(texts, "uid", "left_semi").mapInArrow(_shingle_sets, "uid long, shingles binary"))
    links = _verify(likely, sets, similarity)
    label = components(links)

    # Buckets that hold several classes: each row asks its likeliest partners in other classes; what
    # then is still open is compared in full.
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def open_rows() -> DataFrame:
        labelled = member.select("uid", "key", "size").join(label.select(F.col("node").alias("uid"), "label"), "uid", "left")
        labelled = labelled.select("uid", "key", "size", F.coalesce("label", "uid").alias("label"))
        mixed = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("key", parity)
        return labelled.select("*", parity).join(mixed, ["key", "parity"]).join(nodes.select("uid", "sign"), "uid")

    def by_block(rows: DataFrame) -> GroupedData:
        blocks = F.ceil(F.col("size") / BLOCK)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), blocks)).withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        rows = rows.select("*", F.least("block", "partner").alias("i"), F.greatest("block", "partner").alias("j")).drop("partner", "size", "parity")
        return rows.groupBy(F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts)).alias("part"))

    asked = by_block(open_rows()).applyInArrow(_nearest(3), "a long, b long").distinct().join(likely, ["a", "b"], "left_anti")
    more = _verify(asked, sets, similarity)
    links, label = links.unionAll(more), joined(label, more)
    rest = checkpointed(open_rows())
    still = checkpointed(by_block(rest).applyInArrow(_still_open, "key long, uid long").distinct())
    if not still.isEmpty():
        rest = rest.join(still, ["key", "uid"]).join(nodes.select("uid", "bands"), "uid").join(sets, "uid")
        more = checkpointed(by_block(rest).applyInArrow(_every_link(similarity), "a long, b long").distinct())
        links, label = links.unionAll(more), joined(label, more)

    told = ["n_links", "linked_id"] if with_links else []
    groups = same.join(label, "node", "left").select("*", F.coalesce("label", "node").alias("class"))
    if with_links:
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(links.select("b", "a"))
        ends = ends.groupBy("node").agg(F.countDistinct("other").alias("n_links"), F.min("other").alias("other"))
        ends = ends.join(same.select(F.col("node").alias("other"), F.col("first.id").alias("linked_id")), "other").drop("other")
        groups = groups.join(ends, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    odd = F.pmod("class", F.lit(2)).alias("parity")
    groups = groups.select("words_a", "words_b", "first", "n", "class", *told, odd)
    classes = groups.groupBy("class").agg(F.min("first").alias("keep"), F.sum("n").alias("class_size"))
    groups = groups.join(classes.select("*", odd), ["class", "parity"])
    out = signed.select("uid", "id", "words_a", "words_b").join(groups.select("words_a", "words_b", "keep", "class_size", *told), ["words_a", "words_b"])
    return out.select(F.col("id").alias(key), "uid", F.col("keep.id").alias("class_id"), "class_size", *told, (F.col("uid") == F.col("keep.uid")).alias("kept"))
