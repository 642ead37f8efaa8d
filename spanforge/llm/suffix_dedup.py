"""Suffix dedup by bucket-pointer refinement over sampled suffixes.

All suffixes would be several times the corpus in each round, so only suffixes at anchors enter the
buckets: the anchor of a `width`-byte window is the smallest 16-gram among the window's first
`spread` bytes, so equal windows have their anchor at the same offset and neighbouring windows share it.

Buckets have identifiers, and a bucket of longer grams is told by the identifiers at a place and at a later
offset: those of 2q bytes by the two of q bytes at i and i + q, whose own identifiers were made alike, down
to eight bytes (see names()). Three rounds sort buckets on such identifiers, coarse to fine:

1. the initial bucket of a suffix is the q-gram that all windows of its anchor hold, q = width - spread
   + 1. It is refined on the identifiers of the anchor's first and last window: suffixes that
   still agree settle all their windows at once, and a bucket of one name leaves;
2. suffixes in buckets of several names are refined by classes of CLASS neighbouring windows: a class's bucket is the gram
   that its windows have in common, sorted on the identifiers of its first and last window;
3. the windows of class buckets that hold several names are compared one by one, on 96 bits.

Each round asks only about what the round before left open, and reuses its identifiers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _packed as P
from . import _text as T

GRAM = 16
#: Neighbouring windows that the second round refines together.
CLASS = 16
#: Kinds of questions: does a name occur twice, does a bucket hold several names.
NAME, BUCKET, CLASS_NAME, CLASS_BUCKET, WINDOW = range(5)
_PLACE = T.U((1 << 31) - 1)
_PAIR = np.dtype([("bucket", "<u8"), ("name", "<u8")])
_ODD = tuple((T.U(a), T.U(b)) for a, b in ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number: a view."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), strides=(1,))


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """The identifier of a bucket told by two others."""
    one, two = _ODD[seed]
    h = (a + one) * two
    h ^= h >> T.U(32)
    h = (h + b) * one
    h ^= h >> T.U(29)
    h *= two
    return h ^ (h >> T.U(32))


def names(x: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Bucket identifiers of the size-byte grams at some places, made by doubling from those of eight bytes.

    If size is no power of two, the two identifiers that tell the last overlap.
    """
    q = 1 << (size.bit_length() - 1)
    steps = 8 * np.arange(q // 8)

    def doubled(at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), T.U)
        for i in range(0, len(at), 4096):
            ids = x[at[i : i + 4096, None] + steps]
            while ids.shape[1] > 1:
                ids = pair(ids[:, ::2], ids[:, 1::2], seed)
            out[i : i + 4096] = ids[:, 0]
        return out

    return doubled(at) if q == size else pair(doubled(at), doubled(at + (size - q)), seed)


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run, one run after another."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, spread: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, first and last window of the anchors of a run of texts."""
    found = []
    for i, j in T.pieces(offsets, 1 << 17):
        at = T.windows(offsets[i : j + 1] - offsets[i], width)
        if len(at):
            x = eights(data[offsets[i] : offsets[j]])
            grams = x[:-8] * _ODD[0][0] + x[8:]
            grams ^= grams >> T.U(29)
            grams *= _ODD[0][1]
            grams &= ~_PLACE
            grams |= np.arange(len(grams), dtype=T.U)
            anchor = (T.sliding_min(grams, spread)[at] & _PLACE).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            last = np.concatenate([first[1:], [len(at)]]) - 1
            found.append(offsets[i] + np.stack([anchor[first], at[first], at[last]]))
    return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 3


def _steps(width: int, spread: int):
    """Makes a column with each text's anchors: how far place and last window are from those before, in two bytes each."""

    def run(texts: pa.Array) -> pa.Array:
        data, offs = T.buffers(texts)
        place, _, last = anchors(data, offs, width, spread)
        edge = np.searchsorted(place, offs)
        both = np.stack([place, last], axis=1)
        both[1:] -= both[:-1].copy()
        begin = edge[:-1][edge[1:] > edge[:-1]]
        both[begin] = np.stack([place, last], axis=1)[begin] - offs[:-1][edge[1:] > edge[:-1], None]
        both = both.astype("<u2")
        return pa.array([both[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)], pa.binary())

    return run


class Batch:
    """The texts of a batch and their anchors."""

    def __init__(self, left: pa.Table, width: int, spread: int):
        self.table, self.width, self.spread, self.bid = P.unpacked(left), width, spread, P.bid_of(left)
        self.data, self.offs = T.buffers(self.table.column("text"))
        self.x = eights(self.data)
        raw = self.table.column("more").to_pylist()
        size = np.array([len(r) // 4 for r in raw])
        edge = np.cumsum(size) - size
        both = np.cumsum(np.frombuffer(b"".join(raw), "<u2").reshape(-1, 2), axis=0, dtype=np.int64)
        both = np.concatenate([np.zeros((1, 2), np.int64), both])
        row = np.repeat(np.arange(len(raw)), size)
        self.place, self.last = (both[1:] - both[edge[row]] + self.offs[row, None]).T
        self.first = np.concatenate([[0], self.last[:-1] + 1]) if len(row) else self.last
        begin = edge[size > 0]
        self.first[begin] = self.offs[:-1][size > 0]

    def suffixes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and name of each anchor: the gram of all its windows, and its first and last window."""
        bucket = names(self.x, self.place, self.width - self.spread + 1)
        ends = (names(self.x, k, self.width) for k in (self.first, self.last))
        return bucket, pair(pair(*ends), ((self.place - self.first) << 32 | (self.last - self.first)).astype(T.U))

    def classes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window, bucket and name of the classes of some anchors."""
        place, first, last = self.place[which], self.first[which], self.last[which]
        low = (place - last) // CLASS
        size = (place - first) // CLASS - low + 1
        c, k = _runs(low, size), np.repeat(np.arange(len(place)), size)
        core = place[k] - CLASS * c
        a, b = np.maximum(first[k], core - CLASS + 1), np.minimum(last[k], core)
        bucket = pair(names(self.x, core, self.width - CLASS + 1), c.astype(T.U))
        name = pair(pair(names(self.x, a, self.width), names(self.x, b, self.width)), (c << 32 | (core - a) << 16 | (core - b)).astype(T.U))
        return a, b, bucket, name

    def split(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the anchors, which of them are settled, and whose bucket holds several names."""
        bucket, name = self.suffixes()
        return name, T.member(P.hashes_of(P.of_kind(answers, NAME)), name), T.member(P.hashes_of(P.of_kind(answers, BUCKET)), bucket)

    def asked_classes(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The classes of buckets that hold several names. Settled names are asked about too, as others may share a class with them, but once."""
        name, _, split = self.split(answers)
        return self.classes(_once(name, split))

    def asked_windows(self, answers: pa.Table) -> np.ndarray:
        """The windows of class buckets that hold several names."""
        a, b, bucket, name = self.asked_classes(answers)
        which = _once(name, T.member(P.hashes_of(P.of_kind(answers, CLASS_BUCKET)), bucket))
        return _runs(a[which], (b - a)[which] + 1)

    def covered(self, answers: pa.Table) -> np.ndarray:
        """Which bytes of the batch some repeated window covers."""
        _, settled, split = self.split(answers)
        a, b, bucket, name = self.classes(np.flatnonzero(split & ~settled))
        done = T.member(P.hashes_of(P.of_kind(answers, CLASS_NAME)), name)
        left = T.member(P.hashes_of(P.of_kind(answers, CLASS_BUCKET)), bucket) & ~done
        at, back = _runs(a[left], (b - a)[left] + 1), P.hashes_of(P.of_kind(answers, WINDOW))
        at = at[T.member(back, names(self.x, at, self.width))] if len(back) else at[:0]
        step = np.zeros(len(self.data) + 1, np.int32)
        for lo, hi in ((self.first[settled], self.last[settled]), (a[done], b[done]), (at, at)):
            np.add.at(step, lo, 1)
            np.add.at(step, hi + self.width, -1)
        return np.cumsum(step[:-1]) > 0


def _once(name: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The chosen places, one for each name."""
    at = np.flatnonzero(which)
    return at[np.sort(np.unique(name[at], return_index=True)[1])]


def _questions(bid: int, kind: int, bucket: np.ndarray, name: np.ndarray, n: int) -> pa.Table:
    """Does each name occur elsewhere (kind), and does each bucket hold other names (kind + 1)."""
    order = np.lexsort((name, bucket))
    bucket, name = bucket[order], name[order]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[: len(bucket)])
    end = np.concatenate([begin[1:], [len(bucket)]]) - 1
    least = np.empty(len(begin), _PAIR)
    if len(begin):
        least["bucket"], least["name"], split = bucket[begin], name[begin], (name[begin] != name[end]).astype(np.uint8)
    h, seen = np.unique(name, return_counts=True)
    twice = (seen > 1).astype(np.uint8)
    return pa.concat_tables([
        P.send(bid, kind, h, n, lambda p: h[p].tobytes(), lambda p: twice[p].tobytes()),
        P.send(bid, kind + 1, least["bucket"], n, lambda p: least[p].tobytes(), lambda p: split[p].tobytes()),
    ])


def _several(table: pa.Table) -> list[bytes | None]:
    """The buckets that hold several names."""
    raw = [np.frombuffer(b, _PAIR) for b in P.bodies(table)]
    x, split = np.concatenate(raw), np.frombuffer(b"".join(P.bodies(table, "tail")), np.uint8)
    order = np.lexsort((x["name"], x["bucket"]))
    y = x[order]
    begin = np.flatnonzero(np.concatenate([[True], y["bucket"][1:] != y["bucket"][:-1]]))
    end = np.concatenate([begin[1:], [len(y)]]) - 1
    many = (np.maximum.reduceat(split[order], begin) > 0) | (y["name"][begin] != y["name"][end])
    hit = np.empty(len(x), bool)
    hit[order] = np.repeat(many, end - begin + 1)
    return [np.ascontiguousarray(r["bucket"][h]).tobytes() or None for r, h in zip(raw, np.split(hit, np.cumsum([len(r) for r in raw])[:-1]), strict=True)]


def _answer(table: pa.Table) -> list[bytes | None]:
    kind = table.column("kind")[0].as_py()
    return P.repeated_wide(table) if kind == WINDOW else _several(table) if kind in (BUCKET, CLASS_BUCKET) else P.repeated_hashes(table)


def suffix_dedup(docs: DataFrame, width: int = 400, spread: int = 256, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Removes every byte covered by a `width`-byte string that also starts anywhere else.

    Returns key, kept (binary), n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256
    for each row. Strings never cross rows; overlaps count; all are judged on the input. Null is an
    empty text; rows that repeat, with any key or a null one, each count as a document of their
    own; texts shorter than width stay whole; an empty table gives no rows; other columns are not read.
    """
    if spread + GRAM > width or spread <= CLASS or spread >= 1 << 16:
        raise ValueError("spread must be more than 16 and at most width - 16")
    n = P.buckets(docs.sparkSession, 2)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    batches = P.batches(rows, 1024, more=_steps(width, spread))

    def initial(left: pa.Table) -> pa.Table:
        batch = Batch(left, width, spread)
        return _questions(batch.bid, NAME, *batch.suffixes(), n)

    def refined(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return P.nothing()
        batch = Batch(left, width, spread)
        return _questions(batch.bid, CLASS_NAME, *batch.asked_classes(right)[2:], n)

    def single(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return P.nothing()
        batch = Batch(left, width, spread)
        at = batch.asked_windows(right)
        x, twice = P.unique_wide(names(batch.x, at, width), names(batch.x, at, width, 1))
        return P.send(batch.bid, WINDOW, x["a"], n, lambda p: x[p].tobytes(), lambda p: twice[p].tobytes())

    one = P.ask(batches.applyInArrow(initial, P.SENT), _answer)
    two = one.unionAll(P.ask(batches.cogroup(one.groupBy("bid")).applyInArrow(refined, P.SENT), _answer))
    three = two.unionAll(P.ask(batches.cogroup(two.groupBy("bid")).applyInArrow(single, P.SENT), _answer))
    kind = to_arrow_type(rows.schema["id"].dataType)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        batch = Batch(left, width, spread)
        out = batch.covered(right) if right.num_rows else np.zeros(len(batch.data), bool)
        kept, gone, spans, sha = [], [], [], []
        for lo, hi in zip(batch.offs[:-1].tolist(), batch.offs[1:].tolist(), strict=True):
            c = out[lo:hi]
            rest = batch.data[lo:hi][~c].tobytes()
            kept.append(rest)
            gone.append(int(c.sum()))
            spans.append(int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if hi > lo else 0)
            sha.append(hashlib.sha256(rest).hexdigest())
        numbers = {"n_bytes": np.diff(batch.offs), "n_removed": gone, "n_spans": spans}
        return pa.table({"id": batch.table.column("id").cast(kind), "kept": pa.array(kept, pa.binary())} | {k: pa.array(v, pa.int64()) for k, v in numbers.items()} | {"kept_sha256": pa.array(sha, pa.string())})

    schema = f"id {rows.schema['id'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return batches.cogroup(three.groupBy("bid")).applyInArrow(remove, schema).withColumnRenamed("id", key)
