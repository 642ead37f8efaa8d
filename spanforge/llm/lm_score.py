"""Cross-entropy difference: matched target and background bigram models over one vocabulary.

Each text is read as a sequence of words that ends with an end mark, which is also the context of
the first word. Both models count all texts: the target model those of target rows, the background
model those of every row; smoothing and the hashed vocabulary are the same. A row is scored without
its own counts, so that being in the target does not by itself help it:

    p(w | v) = a * c(v, w) / c(v) + (1 - a) * ((1 - e) * c(w) / c() + e / VOCABULARY)

where a = 0 if v was not seen. The score is the mean over the row's words and its end of
log p_target - log p_background, in nats; higher means closer to the target. Words and pairs are
known by hashes of 40 bits and their bucket, so that of a hundred million pairs a few dozen share
their counts with another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import _packed as P
from . import _text as T

#: Words that the floor of the unigram model is spread over; a fixed size, so that counts can be gathered in one pass.
VOCABULARY = 1 << 20
WORD, PAIR = (T.U(k) for k in (0x33, 0x44))
_EDGE = T.U(0x5DEECE66D)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers of each word or end, of the word before it and of the pair, and the number of each row's words and ends."""
    s, e, begin = T.words(data, offsets)
    size = np.diff(begin)
    h = np.insert(T.word_hashes(data, s, e), begin[1:][size > 0], _EDGE)
    before = np.concatenate([[_EDGE], h[:-1]]).astype(T.U) if len(h) else h
    return T.mix(h ^ WORD), T.mix(before ^ WORD), T.mix(T.mix(before + PAIR) ^ h), size + (size > 0)


def _planes(x: np.ndarray) -> bytes:
    """Counts byte by byte, as many bytes as the largest needs: the high bytes, mostly zero, stand together and shrink to nothing."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(raw: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for k, plane in enumerate(raw.reshape(-1, size) if size else ()):
        out |= plane.astype(np.int64) << 8 * k
    return out


def _pack_counts(n: np.ndarray, own: np.ndarray) -> bytes:
    """A byte with both counts of each gram, 15 where it is more; what is more follows in full."""
    few = (np.minimum(n, 15) | np.minimum(own, 15) << 4).astype(np.uint8)
    return few.tobytes() + _planes(np.concatenate([n[n >= 15], own[own >= 15]]))


def _unpack_counts(raw: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    few, more = np.frombuffer(raw, np.uint8, size), np.frombuffer(raw, np.uint8, offset=size)
    n, own = (few & 15).astype(np.int64), (few >> 4).astype(np.int64)
    many = n == 15, own == 15
    counts = _from_planes(more, int(many[0].sum() + many[1].sum()))
    n[many[0]], own[many[1]] = np.split(counts, [int(many[0].sum())])
    return n, own


def _add_up(table: pa.Table) -> list[bytes | None]:
    """Sums the counts of each gram; answers each batch with both counts of each of its grams, in its order."""
    raw = [P.from_low5(b) for b in P.bodies(table)]
    counts = [_unpack_counts(t, len(r)) for t, r in zip(P.bodies(table, "tail"), raw, strict=True)]
    x = np.concatenate(raw)
    order = np.argsort(x, kind="stable")
    y = x[order]
    new = np.ones(len(y), bool)
    new[1:] = y[1:] != y[:-1]
    first = np.flatnonzero(new)
    sums = [np.add.reduceat(np.concatenate(n)[order], first) if len(first) else np.zeros(0, np.int64) for n in zip(*counts, strict=True)]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    out, at = [], 0
    for r, bucket in zip(raw, table.column("bucket").to_pylist(), strict=True):
        g = back[at : at + len(r)]
        at += len(r)
        out.append(bucket.to_bytes(4, "little") + len(r).to_bytes(4, "little") + _planes(np.concatenate([n[g] for n in sums])))
    return out


def _sums(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What _add_up() says of a batch, bucket by bucket."""
    bodies = sorted(bodies, key=lambda b: int.from_bytes(b[:4], "little"))
    both = [_from_planes(np.frombuffer(b, np.uint8, offset=8), 2 * int.from_bytes(b[4:8], "little")).reshape(2, -1) for b in bodies]
    return tuple(np.concatenate([np.zeros((2, 0), np.int64), *both], axis=1).astype(float))


def _batch_grams(data: np.ndarray, offs: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct grams of a batch in order, how often they are there and how often in rows of the target."""
    found, whose = [np.zeros(0, T.U)], [np.zeros(0, bool)]
    for i, j in T.pieces(offs):
        word, _, pair, size = grams(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        found += [word, pair]
        whose += [np.repeat(mine[i:j], size)] * 2
    h, inverse, seen = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    return h, seen, np.bincount(inverse, weights=np.concatenate(whose), minlength=len(h)).astype(np.int64)


def _totals(rows: DataFrame, target: DataFrame) -> tuple[int, int]:
    """Words and ends of all rows, and of those of the target."""

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            data, offs = T.buffers(table.column("text"))
            size = [np.diff(T.words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[2]) for i, j in T.pieces(offs)]
            size = np.concatenate([np.zeros(0, np.int64), *size])
            yield pa.RecordBatch.from_arrays([table.column("id"), pa.array(size + (size > 0), pa.int64())], ["id", "n"])

    sized = rows.mapInArrow(count, f"id {rows.schema['id'].dataType.simpleString()}, n long")
    own = F.when(F.col("own"), F.col("n"))
    return tuple(sized.join(target.withColumn("own", F.lit(True)), "id", "left").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", own))).first())


def lm_scores(docs: DataFrame, target: DataFrame, weight: float = 0.7, floor: float = 0.05, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Scores every row; target has the keys of the rows that make up the target model.

    Returns key, n_words, target_loss, background_loss and score (their difference) in nats a word.
    Words are runs of bytes other than white space. Null and empty texts have no words, count
    nowhere and get null losses and a null score; a null key is in no target; rows that repeat count
    each; keys that target lists twice count once; an empty table gives no rows; other columns are not read.
    """
    n = P.buckets(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    target = target.select(F.col(key).alias("id")).distinct()
    totals = _totals(rows, target)
    batches = P.batches(rows, 1024)

    # The ids of a batch's rows in the target, 1024 at most.
    def ids(left: pa.Table) -> pa.Table:
        found = P.unpacked(left).column("id").unique()
        return pa.table({"bid": pa.array([P.bid_of(left)] * len(found), pa.int64()), "id": found.cast(kind)})

    kind = to_arrow_type(rows.schema["id"].dataType)
    id_type = rows.schema["id"].dataType.simpleString()
    marks = batches.applyInArrow(ids, f"bid long, id {id_type}").join(target, "id", "left_semi").groupBy("bid").agg(F.collect_list("id").alias("ids"))

    def owned(rows: pa.Table, right: pa.Table) -> np.ndarray:
        marked = [x for x in right.column("ids").to_pylist() if x]
        own = pa.array([y for x in marked for y in x], rows.schema.field("id").type)
        return pc.is_in(rows.column("id"), value_set=own, skip_nulls=True).to_numpy()

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = P.unpacked(left)
        h, seen, own = _batch_grams(*T.buffers(rows.column("text")), owned(rows, right))
        return P.send(P.bid_of(left), 0, h, n, lambda p: P.low5(h[p]), lambda p: _pack_counts(seen[p], own[p]))

    counts = P.ask(batches.cogroup(marks.groupBy("bid")).applyInArrow(count, P.SENT), _add_up)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        left = P.unpacked(left)
        data, offs = T.buffers(left.column("text"))
        own_row = owned(left, right)
        names, _, _ = _batch_grams(data, offs, own_row)
        back, front = np.empty(len(names)), np.empty(len(names))
        order = P.by_bucket(names, n)
        back[order], front[order] = _sums([b for b in P.bodies(right) if b])
        words, losses = [np.zeros(0, np.int64)], [np.zeros((2, 0))]

        def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(names, h)
            return back[at], front[at]

        def own(h: np.ndarray, row: np.ndarray, also: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
            """How often each row has its grams itself; the same for the grams in also."""
            salt = row.astype(T.U) * T.U(0x9E3779B97F4A7C15)
            x = T.mix(h + salt)
            values, inverse, seen = np.unique(x, return_inverse=True, return_counts=True)
            if also is None:
                return (seen[inverse],)
            y = T.mix(also + salt)
            at = np.minimum(np.searchsorted(values, y), len(values) - 1)
            return seen[inverse], np.where(values[at] == y, seen[at], 0)

        for i, j in T.pieces(offs):
            word, before, pair, size = grams(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            row = np.repeat(np.arange(j - i), size)
            loss = np.zeros((2, j - i))
            if len(row):
                mine = own_row[i:j][row]
                less_word, less_before = own(word, row, before)
                less = (own(pair, row)[0], less_before, less_word, size[row])
                seen = [*(counted(x) for x in (pair, before, word)), totals]
                for k in (0, 1):  # the background, then the target
                    both, context, single, everything = (np.maximum(c[k] - x * (mine if k else 1), 0) for c, x in zip(seen, less, strict=True))
                    a = np.where(context > 0, weight, 0.0)
                    p = a * both / np.maximum(context, 1) + (1 - a) * ((1 - floor) * single / np.maximum(everything, 1) + floor / VOCABULARY)
                    loss[k] = np.bincount(row, weights=-np.log(p), minlength=j - i) / np.maximum(size, 1)
            words.append(np.maximum(size - 1, 0))
            losses.append(loss)
        size, (back_loss, front_loss) = np.concatenate(words), np.concatenate(losses, axis=1)
        none = size == 0
        return pa.table({"id": left.column("id").cast(kind), "n_words": pa.array(size, pa.int64())} | {name: pa.array(x, pa.float64(), mask=none) for name, x in (("target_loss", front_loss), ("background_loss", back_loss), ("score", back_loss - front_loss))})

    known = counts.select("bid", "body", F.lit(None).cast(f"array<{id_type}>").alias("ids")).unionByName(marks.select("bid", F.lit(None).cast("binary").alias("body"), "ids"))
    schema = f"id {id_type}, n_words long, target_loss double, background_loss double, score double"
    return batches.cogroup(known.groupBy("bid")).applyInArrow(score, schema).withColumnRenamed("id", key)
