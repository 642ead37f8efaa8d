"""Substring dedup over words with fixed-block anchors.

Reference blocks of `block` words are laid end to end over each document. Any window of `width`
words holds a whole block when width >= 2 * block - 1, so a window that starts in two places holds
a run of `block` words that is a reference block of one of them. Three passes:

1. every rolling run of `block` words probes the index of reference blocks (hash buckets own the
   index and see all probes; a run that occurs twice and is a block somewhere is a hit);
2. hits are extended to the windows around them, and those windows are compared exactly, on
   96-bit hashes of all their words;
3. words covered by repeated windows are removed, which leaves the union of maximal repeats out.
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


def _blocks(begin: np.ndarray, block: int, starts: np.ndarray) -> np.ndarray:
    """Which of the run starts lie on their row's block grid."""
    row = np.searchsorted(begin, starts, "right") - 1
    return (starts - begin[row]) % block == 0


def _hits(table: pa.Table) -> list[bytes | None]:
    """A probe hits if its run is seen twice and is a reference block somewhere."""
    raw = [P.from_low5(b) for b in P.bodies(table)]
    flags = np.frombuffer(b"".join(P.bodies(table, "tail")), np.uint8)
    x = np.concatenate(raw)
    order = np.argsort(x, kind="stable")
    y, f = x[order], flags[order]
    new = np.ones(len(y), bool)
    new[1:] = y[1:] != y[:-1]
    run = np.cumsum(new) - 1
    seen = np.bincount(run, weights=1 + (f & 1))
    anchor = np.bincount(run, weights=f >> 1) > 0
    hit = np.empty(len(x), bool)
    hit[order] = ((seen >= 2) & anchor)[run]
    out, at = [], 0
    for r in raw:
        out.append(P.low5(r[hit[at : at + len(r)]]) or None)
        at += len(r)
    return out


def substring_dedup(docs: DataFrame, width: int = 35, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Removes every word covered by a `width`-word window whose words also start anywhere else.

    Returns key, kept_text, n_words, n_removed, n_spans (maximal removed runs) and kept_sha256 for
    each row. Words are runs of bytes other than space, tab, LF, VT, FF and CR; kept words are
    joined by one space. Null and empty texts have no words; rows that repeat, with any key or a
    null one, each count as a document of their own; texts of fewer than width words stay whole; an
    empty table gives no rows; other columns are not read.
    """
    block = (width + 1) // 2
    n = P.buckets(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    batches = P.batches(rows)

    def probe(left: pa.Table) -> pa.Table:
        data, offs = T.buffers(P.unpacked(left).column("text"))
        found, flags = [], []
        for i, j in T.pieces(offs):
            d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            s, e, begin = T.words(d, o)
            at = T.windows(begin, block)
            found.append(T.span_hash(T.prefix(T.word_hashes(d, s, e)), at, at + block))
            flags.append(_blocks(begin, block, at))
        h, inverse, seen = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        flag = (seen > 1).astype(np.uint8)
        flag[inverse[np.concatenate(flags)]] |= 2
        return P.send(P.bid_of(left), 0, h, n, lambda p: P.low5(h[p]), lambda p: flag[p].tobytes())

    hits = P.ask(batches.applyInArrow(probe, P.SENT), _hits)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return P.nothing()
        bid, left = P.bid_of(left), P.unpacked(left)
        back = np.unique(P.from_low5(b"".join(P.bodies(right))))
        data, offs = T.buffers(left.column("text"))
        a, b = [], []
        for i, j in T.pieces(offs):
            d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            s, e, begin = T.words(d, o)
            one = T.prefix(T.word_hashes(d, s, e))
            at = T.windows(begin, block)
            hit = at[T.member(back, T.span_hash(one, at, at + block) & T.U((1 << 40) - 1))]
            near = np.zeros(len(s) + 1, np.int32)  # windows that hold a hit start up to width - block before it
            np.add.at(near, np.maximum(hit - (width - block), 0), 1)
            np.add.at(near, hit + 1, -1)
            at = T.windows(begin, width)
            at = at[np.cumsum(near)[at] > 0]
            a.append(T.span_hash(one, at, at + width))
            b.append(T.span_hash(T.prefix(T.word_hashes(d, s, e, 2)), at, at + width))
        x, twice = P.unique_wide(np.concatenate(a), np.concatenate(b))
        return P.send(bid, 1, x["a"], n, lambda p: x[p].tobytes(), lambda p: twice[p].tobytes())

    repeated = P.ask(batches.cogroup(hits.groupBy("bid")).applyInArrow(extend, P.SENT), P.repeated_wide)
    kind = to_arrow_type(rows.schema["id"].dataType)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        left = P.unpacked(left)
        back = P.hashes_of(P.bodies(right))
        data, offs = T.buffers(left.column("text"))
        texts, total, gone, spans, sha = [], [], [], [], []
        for i, j in T.pieces(offs):
            d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            s, e, begin = T.words(d, o)
            cover = np.zeros(len(s), bool)
            if len(back):
                at = T.windows(begin, width)
                found = T.span_hash(T.prefix(T.word_hashes(d, s, e)), at, at + width)
                cover = T.spread(at[T.member(back, found)], width, len(s))
            raw = d.tobytes()
            for k in range(j - i):
                lo, hi = begin[k], begin[k + 1]
                c = cover[lo:hi]
                kept = b" ".join([raw[p:q] for p, q, out in zip(s[lo:hi].tolist(), e[lo:hi].tolist(), c.tolist(), strict=True) if not out])
                texts.append(kept)
                total.append(int(hi - lo))
                gone.append(int(c.sum()))
                spans.append(int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if hi > lo else 0)
                sha.append(hashlib.sha256(kept).hexdigest())
        return pa.table({"id": left.column("id").cast(kind), "kept_text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    schema = f"id {rows.schema['id'].dataType.simpleString()}, kept_text string, n_words long, n_removed long, n_spans long, kept_sha256 string"
    return batches.cogroup(repeated.groupBy("bid")).applyInArrow(remove, schema).withColumnRenamed("id", key)
