"""Dictionaries of any size: terms that are rows of a table, found in texts with their offsets.

A term stands in a text where its letters do, whatever their case. Texts are read once for each slice of SLICE terms. A
task knows the hashes of the slice's terms, of a fixed size: it looks at the beginnings of words that begin a term, at each length that
such terms have, and keeps the places whose hash is that of a term. A join on the letters themselves
then tells which terms they are. Work grows with the words of the texts and the terms found, not with their product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .extract import dictionary_confidence, dictionary_valid

#: Terms that are looked for in one pass over the texts, and code points of them up to which they are broadcast.
SLICE, BROADCAST_CHARS = 500_000, 64 << 20
#: Code points around a place that keywords are looked for in, and that the context shows.
NEAR, SHOWN = 100, 50

TERM = "dictionary string, pii_type string, term string, confidence double, keywords array<string>, case_sensitive boolean, word_boundaries boolean"

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}


def _fold() -> np.ndarray:
    """Each code point of the first plane in lower case, if that is one code point."""
    if "fold" not in _tables:
        low = np.arange(1 << 16, dtype=np.uint32)
        for c in range(1 << 16):
            if not 0xD800 <= c < 0xE000 and len(x := chr(c).lower()) == 1:
                low[c] = ord(x)
        low[0x3C2] = 0x3C3  # final sigma
        _tables["fold"] = low
    return _tables["fold"]


def _word_sign() -> np.ndarray:
    if "word" not in _tables:
        _tables["word"] = np.array([chr(c).isalnum() or c == 95 for c in range(1 << 16)])
    return _tables["word"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("power", ())) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=_U)
    return _tables["power"][:n], _tables["inverse"][:n]


class _Text:
    """A text's code points in lower case, and hashes of any part of it."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.minimum(self.points, 0xFFFF)
        self.low = np.where(self.points > 0xFFFF, self.points, _fold()[first])
        self.word = np.where(self.points > 0xFFFF, False, _word_sign()[first])
        for k in np.flatnonzero(self.points > 0xFFFF):
            self.word[k] = chr(self.points[k]).isalnum()
        n = len(self.points)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum((self.low.astype(_U) + _U(1)) * _powers(n)[0], out=self.sums[1:])
        edge = np.ones(n + 1, bool)  # a word begins or ends
        edge[1:n] = self.word[1:] != self.word[:-1]
        if n:
            edge[0], edge[n] = self.word[0], self.word[-1]
        else:
            edge[0] = False
        self.edge = edge

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * _powers(len(self.sums))[1][start] + (end - start).astype(_U)
        h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
        return h ^ (h >> _U(29))

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of words and of signs that are neither word nor space, and where each ends."""
        n = len(self.points)
        starts = np.flatnonzero((self.edge[:n] & self.word) | ~self.word)
        ends = starts + 1
        of_word = self.word[starts]
        edges = np.flatnonzero(self.edge)
        ends[of_word] = edges[np.searchsorted(edges, starts[of_word], "right")]
        return starts, ends


#: Length of what begins a term that may stand inside a word.
_GRAM = 2


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of a term, of what it begins with, its length, and whether it keeps to word boundaries."""
    for batch in batches:
        out = []
        for term, bounded in zip(batch.column("term").to_pylist(), batch.column("word_boundaries").to_pylist(), strict=True):
            t = _Text(term)
            n = len(t.points)
            starts, ends = t.heads()
            head = int(ends[0]) if bounded and len(starts) and starts[0] == 0 else min(n, 1 if bounded else _GRAM)
            zero = np.zeros(1, np.int64)
            out.append((int(t.hash(zero, zero + n)[0].view(np.int64)), int(t.hash(zero, zero + head)[0].view(np.int64)), n, bounded))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], ["whole", "head", "size", "bounded"])


class _Index:
    """Sorted hashes of terms, and the lengths of the terms that begin with each head."""

    def __init__(self, rows: Sequence, bounded: bool):
        own = [r for r in rows if r["bounded"] == bounded]
        self.whole = np.unique(np.array([r["whole"] for r in own], np.int64))
        pairs = np.array(sorted({(r["head"], r["size"]) for r in own}), np.int64).reshape(-1, 2)
        self.head, first = np.unique(pairs[:, 0], return_index=True)
        self.first, self.size = np.append(first, len(pairs)), pairs[:, 1]

    def places(self, t: _Text, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of what may be a term, of places that begin as given."""
        if not len(self.head) or not len(starts):
            return (np.zeros(0, np.int64),) * 2
        at = np.searchsorted(self.head, h := t.hash(starts, ends).view(np.int64))
        at[at == len(self.head)] = 0
        known = self.head[at] == h
        starts, at = starts[known], at[known]
        n = self.first[at + 1] - self.first[at]
        begin = np.repeat(starts, n)
        end = begin + self.size[np.repeat(self.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        inside = end <= len(t.points)
        begin, end = begin[inside], end[inside]
        h = t.hash(begin, end).view(np.int64)
        at = np.searchsorted(self.whole, h)
        at[at == len(self.whole)] = 0
        found = self.whole[at] == h
        return begin[found], end[found]


def _found(index: tuple[_Index, _Index], batch: pa.RecordBatch) -> pa.RecordBatch:
    """Where the batch's texts may hold a term, whether inside words, and what stands around."""
    bounded, free = index
    keys = [c for c in batch.schema.names if c != "_text"]
    row, start, end, inside, found, near, shown = ([] for _ in range(7))
    for i, text in enumerate(batch.column("_text").to_pylist()):
        if not text:
            continue
        t = _Text(text)
        a, b = bounded.places(t, *t.heads())
        keep = t.edge[a] & t.edge[b]
        every = np.arange(len(t.points) if len(free.head) else 0)
        c, d = free.places(t, every, np.minimum(every + _GRAM, len(t.points)))
        e, f = free.places(t, every, every + 1)  # terms of one sign
        for x, y, free_ones in ((a[keep], b[keep], False), (np.concatenate([c, e]), np.concatenate([d, f]), True)):
            for p, q in sorted(set(zip(x.tolist(), y.tolist(), strict=True))):
                row.append(i)
                start.append(p)
                end.append(q)
                inside.append(free_ones)
                found.append(text[p:q])
                near.append(text[max(p - NEAR, 0) : q + NEAR])
                shown.append(("..." if p > SHOWN else "") + text[max(p - SHOWN, 0) : q + SHOWN] + ("..." if q + SHOWN < len(text) else ""))
    columns = [(found, pa.string()), (start, pa.int32()), (end, pa.int32()), (inside, pa.bool_()), (near, pa.string()), (shown, pa.string())]
    own = [batch.column(c).take(pa.array(row, pa.int64())) for c in keys]
    return pa.RecordBatch.from_arrays([*own, *(pa.array(v, k) for v, k in columns)], [*keys, "text", "start_pos", "end_pos", "_inside", "_near", "context"])


def _within(held):
    """The search with a broadcast index, which the tasks of a process share; few texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                yield _found(held.value, batch.slice(k, 256))

    return run


def term_table(dictionaries: DataFrame) -> DataFrame:
    """A row for each term of dictionaries as sources.files.read_dictionaries gives them. Blank terms go."""
    kept = lambda c, otherwise: F.coalesce(F.col(c), F.lit(otherwise)).alias(c)
    rows = dictionaries.select(F.col("name").alias("dictionary"), "pii_type", F.explode("terms").alias("term"), F.col("confidence_score").alias("confidence"), F.array().cast("array<string>").alias("keywords"), kept("case_sensitive", False), kept("word_boundaries", True))
    return rows.filter(F.trim("term") != "").select(*(c.split()[0] for c in TERM.split(", ")))


def dictionary_info(dictionaries: DataFrame) -> DataFrame:
    """What each dictionary holds."""
    n = lambda c: F.coalesce(F.size(F.filter(c, lambda x: x.isNotNull())), F.lit(0))
    return dictionaries.select("name", "description", "pii_type", F.greatest(n("terms"), F.lit(0)).alias("terms_count"), F.greatest(n("patterns"), F.lit(0)).alias("patterns_count"), "confidence_score", F.coalesce("case_sensitive", F.lit(False)).alias("case_sensitive"), F.coalesce("word_boundaries", F.lit(True)).alias("word_boundaries"))


def _keyword_near(near: Column, keywords: Column) -> Column:
    return F.coalesce(F.exists(keywords, lambda k: F.contains(near, F.lower(k))), F.lit(False))


def term_spans(docs: DataFrame, terms: DataFrame, text: str = "text", key: Sequence[str] = ("doc_id",), slice_terms: int = SLICE) -> DataFrame:
    """Every occurrence of every term, as spans.

    terms has the columns of TERM. Case does not count unless case_sensitive; with word_boundaries a term begins and ends where a word does, as \\b of
    a regular expression has it, else it may stand inside words. A term that two dictionaries have gives a span for each; repeated rows of terms count once. Confidence and
    validity are those of dictionary_spans. Null and empty texts, null and empty terms find nothing.
    """
    spark = docs.sparkSession
    terms = terms.filter(F.length("term") > 0).select(*(c.split()[0] for c in TERM.split(", "))).distinct()
    measure = terms.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("term")), F.lit(0)).alias("most")).first()
    slices = max(1, -(-measure["n"] // slice_terms))
    rows = docs.select(*key, X.searchable(F.col(text)).alias("_text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in key)
    out = None
    for k in range(slices):
        part = terms if slices == 1 else terms.filter(F.pmod(F.xxhash64(F.lower("term")), F.lit(slices)) == k)
        index = part.select("term", "word_boundaries").distinct().mapInArrow(_index_rows, "whole long, head long, size int, bounded boolean").distinct().collect()
        held = spark.sparkContext.broadcast((_Index(index, True), _Index(index, False)))
        found = rows.mapInArrow(_within(held), f"{kinds}, text string, start_pos int, end_pos int, _inside boolean, _near string, context string")
        known = part.withColumn("_low", F.lower("term"))
        known = F.broadcast(known) if min(measure["n"], 2 * slice_terms) * measure["most"] <= BROADCAST_CHARS else known
        exact = ~known["case_sensitive"] | (found["text"] == known["term"])
        own = found.withColumn("_low", F.lower("text")).join(known, "_low").filter(exact & (F.col("_inside") != F.col("word_boundaries")))
        out = own if out is None else out.unionByName(own)
    near = F.lower("_near")
    score = F.when(_keyword_near(near, F.col("keywords")), F.least(F.col("confidence") + 0.1, F.lit(1.0))).otherwise(F.col("confidence"))
    out = out.withColumn("confidence", dictionary_confidence(score, F.col("text"), near, ())).filter(dictionary_valid(F.col("pii_type"), F.col("text")))
    return out.select(*key, "text", "pii_type", "confidence", "start_pos", "end_pos", "context", F.lit("dictionary").alias("extractor"), "dictionary")


def longest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The leftmost and of these the longest spans of each document, none over another.

    Ties go to the first by type, dictionary and text. Spans of a document come in order to one task, which keeps no more than where the last one ended.
    """
    order = ["start_pos", F.desc("end_pos"), "pii_type", *(c for c in ("dictionary", "text") if c in spans.columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = None, -1
        for batch in batches:
            keep = []
            for k, a, b in zip(*(batch.column(c).to_pylist() for c in (key, "start_pos", "end_pos")), strict=True):
                if k != last:
                    last, end = k, -1
                keep.append(a >= end)
                end = b if a >= end else end
            yield batch.filter(pa.array(keep, pa.bool_()))

    return spans.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, spans.schema)
