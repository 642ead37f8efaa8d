"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over a run of words: positions marked 0 are ignored, so a passage in which
words were replaced still shares seeds with its benchmark item. Seeds of the benchmark and of the
texts are rows that a join on their hash brings together. Each pair of text and item that shares a
seed is then compared word by word along that alignment, and any run of words that is long and similar enough counts.

Most seeds of the texts are in no item. A bitmap of a fixed FILTER_BITS bits with the hashes of the benchmark goes to all
tasks and keeps them from the exchange; it only thins, so that a benchmark of any size gives whole results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._shared import checkpointed

#: Six words of nine to twelve count in each mask.
MASKS = ("110101011", "1011000011001", "11100111")
#: Eight MB; three fourths of random seeds are kept out up to 18 million seeds of a benchmark.
FILTER_BITS = 26


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return T.buffers(pc.utf8_lower(pc.fill_null(column, "")))


class Seeds:
    """The masks, and for items shorter than a mask the pieces that stand in for them."""

    def __init__(self, masks: Sequence[str], short: Sequence[int], similarity: float):
        pieces = [(piece, n) for n in short for piece in _pieces(n, similarity)]
        self.shown = [tuple(k for k, c in enumerate(m) if c == "1") for m in masks] + [piece for piece, _ in pieces]
        self.spans = [len(m) for m in masks] + [n for _, n in pieces]
        self.whole = [False] * len(masks) + [True] * len(pieces)

    def of(self, words: np.ndarray, begin: np.ndarray, items: bool) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of all seeds. Pieces are taken of items of just their length, and anywhere in texts."""
        found = [(np.zeros(0, T.U), np.zeros(0, np.int64))]
        for k, (shown, span, whole) in enumerate(zip(self.shown, self.spans, self.whole, strict=True)):
            at = T.windows(begin, span)
            if whole and items:
                at = at[np.diff(begin)[np.searchsorted(begin, at, "right") - 1] == span]
            found.append((seeds(words, at, shown, k), at))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pieces(n: int, similarity: float) -> list[tuple[int, ...]]:
    """The words of a short item in one piece more than it may have mismatches, so that one piece agrees."""
    return [tuple(x.tolist()) for x in np.array_split(np.arange(n), int((1 - similarity) * n + 1e-9) + 1) if len(x)]


def seeds(words: np.ndarray, at: np.ndarray, mask: Sequence[int], kind: int) -> np.ndarray:
    """Hash of the words that the mask shows at each place."""
    h = np.full(len(at), kind + 1, T.U)
    for k in mask:
        h = h * T.U(0x9E3779B97F4A7C15) + words[at + k]
    return T.mix(h)


def _run(same: np.ndarray, need: int, similarity: float) -> tuple[int, int] | None:
    """Of the runs of at least need words in which the given share agrees, that with most agreeing words."""
    total = np.concatenate([[0], np.cumsum(same - similarity)])
    agree = np.concatenate([[0], np.cumsum(same)])
    low = np.minimum.accumulate(total)
    end = np.arange(len(total))
    start = np.searchsorted(-low, -total - 1e-9)  # the first place from which a run up to here agrees enough
    good = np.flatnonzero(end - start >= need)
    if not len(good):
        return None
    b = int(good[np.argmax(agree[good] - agree[start[good]])])
    a = int(start[b])
    while not same[a] and b - a > need:
        a += 1
    return a, b


def _item_words(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """number, item and the hashes of its words."""
    for table in T.small(tables):
        data, offs = lowered(table.column("text"))
        s, e, begin = T.words(data, offs, T.PUNCT)
        words = T.word_hashes(data, s, e)
        raw = pa.array([words[i:j].tobytes() for i, j in zip(begin, begin[1:], strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([table.column("number"), table.column("item"), raw, pa.array(np.diff(begin), pa.int64())], ["number", "item", "item_words", "size"])


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The fixed number of bits of which those are set that some hash has in front, packed into bytes."""
    front = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    parts = hashes.groupBy(F.shiftright(front, 15).alias("part")).agg(F.bitmap_construct_agg(front.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts.collect():  # 4 KB each, 2 ** (FILTER_BITS - 15) of them
        out[r.part * 4096 : r.part * 4096 + 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    masks: Sequence[str] = MASKS,
    least_words: int = 13,
    similarity: float = 0.8,
    text: str = "text",
    key: str = "doc_id",
    item_key: str = "item_id",
    place: str | None = None,
) -> DataFrame:
    """One row for each text and benchmark item that overlap.

    Returns key, item_id, doc_start and item_start (first words of the overlap), n_words, n_same
    (words that agree) and place (the row's place: the column place, if one is named, or else its
    place in the scan, equal for no two rows). An overlap is a run of one alignment that has least_words words
    or more, or the whole of an item with fewer, and at least the given similarity. Of several runs and
    alignments the one with most agreeing words is given, then the first. Words are lower-cased runs of
    letters and digits. Null and empty texts and items overlap with nothing; an empty table of either
    kind gives no rows; rows that repeat are each reported; items that repeat are reported under each
    id; other columns are not read.

    Alignments are found if they share a seed. With substitutions at random places up to the limit, the
    three masks find 96 % of overlaps of 13 words and over 99 % from 16 words on; items too short for
    a mask are always found.
    """
    rows = docs.select((F.col(place) if place else F.monotonically_increasing_id()).alias("place"), F.col(key).alias("id"), F.col(text).alias("text"))
    items = benchmark.select(F.monotonically_increasing_id().alias("number"), F.col(item_key).alias("item"), F.col("text").alias("text"))
    id_type, item_type = rows.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    items = checkpointed(items.mapInArrow(_item_words, f"number long, item {item_type}, item_words binary, size long").filter("size > 0"))
    longest = max(map(len, masks))
    short = sorted(r[0] for r in items.filter(F.col("size") < longest).select("size").distinct().collect())  # fewer than longest
    kinds = Seeds(masks, short, similarity)

    def of_items(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in T.small(tables):
            begin = np.concatenate([[0], np.cumsum(table.column("size").to_numpy())])
            words = np.frombuffer(b"".join(table.column("item_words").to_pylist()), T.U)
            h, at = kinds.of(words, begin, True)
            row = np.searchsorted(begin, at, "right") - 1
            number = table.column("number").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(number), pa.array(at - begin[row], pa.int64())], ["hash", "number", "item_at"])

    known = checkpointed(items.mapInArrow(of_items, "hash long, number long, item_at long").distinct())
    maybe = rows.sparkSession.sparkContext.broadcast(_bitmap(known))

    def of_texts(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts with any seed that may be an item's, and these seeds."""
        for table in T.small(tables):
            data, offs = lowered(table.column("text"))
            for i, j in T.pieces(offs):
                s, e, begin = T.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], T.PUNCT)
                h, at = kinds.of(T.word_hashes(data[offs[i] : offs[j]], s, e), begin, False)
                front = h >> T.U(64 - FILTER_BITS)
                hit = (maybe.value[front >> T.U(3)] >> (front & T.U(7)).astype(np.uint8)) & 1 > 0
                h, at = h[hit], at[hit]
                row = np.searchsorted(begin, at, "right") - 1
                order = np.argsort(row, kind="stable")
                h, at, row = h[order], at[order], row[order]
                have, first = np.unique(row, return_index=True)
                edge = pa.array(np.append(first, len(row)), pa.int32())
                part = table.slice(i, j - i).take(pa.array(have))
                lists = [pa.ListArray.from_arrays(edge, pa.array(x, pa.int64())) for x in (h.view(np.int64), at - begin[row])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("place", "id", "text")), *lists], ["place", "id", "text", "hashes", "doc_at"])

    held = checkpointed(rows.mapInArrow(of_texts, f"place long, id {id_type}, text string, hashes array<long>, doc_at array<long>"))
    asked = held.select("place", F.explode(F.arrays_zip("hashes", "doc_at")).alias("s")).select("place", F.col("s.hashes").alias("hash"), F.col("s.doc_at").alias("doc_at"))
    pairs = asked.join(known, "hash").select("place", "number", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()

    def compare(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best run of each alignment."""
        for table in T.small(tables):
            data, offs = lowered(table.column("text"))
            found, pick = [], []
            for k, (shift, raw) in enumerate(zip(table.column("shift").to_pylist(), table.column("item_words").to_pylist(), strict=True)):
                own = data[offs[k] : offs[k + 1]]
                s, e, _ = T.words(own, np.array([0, len(own)]), T.PUNCT)
                words, item = T.word_hashes(own, s, e), np.frombuffer(raw, T.U)
                lo, hi = max(0, -shift), min(len(item), len(words) - shift)
                same = item[lo:hi] == words[lo + shift : hi + shift]
                run = _run(same, min(least_words, len(item)), similarity)
                if run:
                    pick.append(k)
                    found.append((lo + run[0] + shift, lo + run[0], run[1] - run[0], int(same[run[0] : run[1]].sum())))
            part = table.take(pa.array(pick, pa.int64()))
            numbers = [pa.array([f[k] for f in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("place", "number", "id", "item")), *numbers], ["place", "number", "id", "item", *RUN])

    joined = pairs.join(held.select("place", "id", "text"), "place").join(items.select("number", "item", "item_words"), "number")
    joined = joined.select("place", "number", "id", "item", "text", "item_words", "shift")
    runs = joined.mapInArrow(compare, f"place long, number long, id {id_type}, item {item_type}, doc_start long, item_start long, n_words long, n_same long")
    # Most words that agree, then the first alignment.
    order = F.struct("n_same", (F.col("item_start") - F.col("doc_start")).alias("first"), "n_words")
    best = runs.groupBy("place", "number").agg(F.max_by(F.struct("id", "item", *RUN), order).alias("b"))
    return best.select("place", F.col("b.id").alias(key), F.col("b.item").alias(item_key), *(F.col(f"b.{c}").alias(c) for c in RUN))


RUN = ("doc_start", "item_start", "n_words", "n_same")
