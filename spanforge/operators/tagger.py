"""A sequence tagger: windows of texts in, spans with offsets of the document out.

The model is a hidden Markov model over the shapes of words. It is fitted by two counts, of tags after tags and of shapes
under tags, that Spark adds up over all documents; both have a fixed size. Texts are cut into windows that overlap; a window's tags are the
likeliest sequence (Viterbi), with the share of probability that each span has (forward-backward) as its confidence. stitched()
turns spans of windows, of this model or any other, into spans of the document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words and numbers with the signs inside them: addresses, dates, numbers in groups are one word.
WORD = re.compile(r"\+?\w+(?:[@.%+\-/:']+\w+)*")
#: Numbers that shapes are hashed to.
SHAPES = 1 << 14
#: Texts whose sequences are searched side by side.
ABREAST = 256
OUT = "O"


def shape(word: str, before: str) -> int:
    """What a word looks like: its letters by case, ASCII or not, digits by how many, signs as they are; and whether only space parts it from the word before.

    Letters after the second of a run don't count.
    """
    return _shape(word, "_" if before.isspace() else "^" if not before else "|")


@lru_cache(1 << 16)
def _shape(word: str, gap: str) -> int:
    parts, last, n = [], "", 0
    for c in word:
        kind = "d" if c.isdigit() else c if not c.isalpha() else ("X" if c.isupper() else "x") if c.isascii() else ("Y" if c.isupper() else "y")
        n = n + 1 if kind == last else 1
        if kind == "d":
            if n == 1:
                parts.append("d1")
            else:
                parts[-1] = f"d{min(n, 20)}"
        elif kind not in "XxYy" or n <= 2:
            parts.append(kind)
        last = kind
    return zlib.crc32(f"{gap}{''.join(parts[:40])}".encode()) % SHAPES


def words(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Places and shapes of a text's words."""
    places, shapes, end = [], [], 0
    for m in WORD.finditer(text):
        places.append(m.span())
        shapes.append(shape(m[0], text[end : m.start()] if len(places) > 1 else ""))
        end = m.end()
    return places, shapes


def tags_of(places: Sequence[tuple[int, int]], spans: Sequence[tuple[int, int, str]]) -> list[str]:
    """B- at the first word of a span, I- at the others; spans come by likelihood, and a word goes to the first that has it."""
    out = [OUT] * len(places)
    starts = np.array([a for a, _ in places] + [1 << 60])
    ends = np.array([b for _, b in places])
    for a, b, kind in spans:
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if i < j and all(t == OUT for t in out[i:j]):
            out[i:j] = [f"B-{kind}"] + [f"I-{kind}"] * (j - i - 1)
    return out


def counted(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """(tag, before, shape, n): how often a tag follows another, and how often a word has a shape under a tag.

    docs has texts and the array of their spans (start_pos, end_pos, pii_type, confidence). A null shape marks counts of tags, a null
    tag before them those of shapes. Each text begins and ends with the tag O. Words of no span in texts without any are
    counted as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, int] = {}
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                places, shapes = words(text or "")
                order = sorted(own or [], key=lambda s: (-s["confidence"], s["start_pos"], -s["end_pos"]))
                tags = tags_of(places, [(s["start_pos"], s["end_pos"], s["pii_type"]) for s in order])
                for pair in zip([OUT, *tags], [*tags, OUT], strict=True):
                    found[k] = found.get(k := (pair[1], pair[0], None), 0) + 1
                for t, s in zip(tags, shapes, strict=True):
                    found[k] = found.get(k := (t, None, s), 0) + 1
            columns = list(zip(*((*k, n) for k, n in found.items()), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["tag", "before", "shape", "n"])

    rows = docs.select(F.col(text).alias("text"), F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("start_pos", "end_pos", "pii_type", "confidence")))).alias("spans"))
    return rows.mapInArrow(run, "tag string, before string, shape int, n long").groupBy("tag", "before", "shape").agg(F.sum("n").alias("n"))


@dataclass
class Tagger:
    """Log probabilities of a tag after another, and of a shape under a tag."""

    tags: list[str]
    step: np.ndarray
    shows: np.ndarray

    def likeliest(self, shapes: Sequence[int]) -> list[int]:
        """Viterbi: the tags of the likeliest sequence from O to O."""
        return self.likeliest_each([shapes])[0]

    def shares(self, shapes: Sequence[int], ranges: Sequence[tuple[int, int, list[int]]]) -> list[float]:
        """Of each range of words and its tags: the share that sequences with these tags have in the probability of all."""
        return self.shares_each([shapes], [ranges])[0]

    def likeliest_each(self, several: Sequence[Sequence[int]]) -> list[list[int]]:
        """likeliest() of several sequences, the longest first, which go abreast."""
        o, n, t = self.tags.index(OUT), len(several), len(self.tags)
        sizes = np.array([len(s) for s in several])
        codes = _padded(several)
        score, back, out = np.empty((n, t)), np.zeros((codes.shape[1], n, t), np.int16), []
        for k in range(codes.shape[1]):
            m = int(np.searchsorted(-sizes, -k, "left"))
            seen = self.shows.T[codes[:m, k]]
            if k:
                best = score[:m, :1] + self.step[0]
                for a in range(1, t):
                    other = score[:m, a : a + 1] + self.step[a]
                    back[k, :m][other > best] = a
                    np.maximum(best, other, out=best)
                score[:m] = best + seen
            else:
                score[:m] = self.step[o] + seen
        last = (score + self.step[:, o]).argmax(1)
        for i, size in enumerate(sizes):
            best = [int(last[i])] if size else []
            for k in range(size - 1, 0, -1):
                best.append(int(back[k, i, best[-1]]))
            out.append(best[::-1])
        return out

    def shares_each(self, several: Sequence[Sequence[int]], ranges: Sequence[Sequence[tuple[int, int, list[int]]]]) -> list[list[float]]:
        """shares() of several sequences, the longest first.

        Probabilities are scaled word by word (forward-backward), so that none runs out of a double's range.
        """
        o, step, sizes = self.tags.index(OUT), np.exp(self.step), np.array([len(s) for s in several])
        codes = _padded(several)
        n, longest, t = *codes.shape, len(self.tags)
        seen = self.shows.T[codes]
        seen = np.exp(seen - seen.max(2, keepdims=True))
        ahead, behind, scale = np.zeros((longest, n, t)), np.zeros((longest, n, t)), np.ones((longest, n))
        for k in range(longest):
            m = int(np.searchsorted(-sizes, -k, "left"))
            now = (ahead[k - 1, :m] @ step if k else step[o]) * seen[:m, k]
            scale[k, :m] = now.sum(1)
            ahead[k, :m] = now / scale[k, :m, None]
        for k in range(longest - 1, -1, -1):
            m, more = (int(np.searchsorted(-sizes, -x, "left")) for x in (k, k + 1))
            behind[k, more:m] = step[:, o]
            if more:
                behind[k, :more] = (seen[:more, k + 1] * behind[k + 1, :more] / scale[k + 1, :more, None]) @ step.T
        out = []
        for w, own in enumerate(ranges):
            total = ahead[sizes[w] - 1, w] @ step[:, o]
            out.append([])
            for i, j, tags in own:
                p = ahead[i, w, tags[0]] * behind[j - 1, w, tags[-1]] / total
                for k in range(i + 1, j):
                    p *= step[tags[k - 1 - i], tags[k - i]] * seen[w, k, tags[k - i]] / scale[k, w]
                out[-1].append(float(p))
        return out

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str, float, int, int]]]:
        """Spans (text, type, confidence, start, end) of each text, as operators.extract.model_spans takes them."""
        out, cut = [[] for _ in texts], [words(text) for text in texts]
        order = sorted((i for i, (places, _) in enumerate(cut) if places), key=lambda i: -len(cut[i][0]))
        for start in range(0, len(order), ABREAST):
            block, found = order[start : start + ABREAST], {}
            for i, best in zip(block, self.likeliest_each([cut[i][1] for i in block]), strict=True):
                ranges = []
                for k, t in enumerate(best):
                    if self.tags[t].startswith("B-"):
                        ranges.append([k, k + 1, [t]])
                    elif self.tags[t].startswith("I-"):
                        ranges[-1][1] = k + 1
                        ranges[-1][2].append(t)
                if ranges:
                    found[i] = ranges
            sure = self.shares_each([cut[i][1] for i in found], list(found.values())) if found else []
            for (i, ranges), shares in zip(found.items(), sure, strict=True):
                places = cut[i][0]
                out[i] = [(texts[i][places[a][0] : places[b - 1][1]], self.tags[t[0]][2:], p, places[a][0], places[b - 1][1]) for (a, b, t), p in zip(ranges, shares, strict=True)]
        return out


def _padded(several: Sequence[Sequence[int]]) -> np.ndarray:
    """Sequences as rows of one array, filled up with 0."""
    out = np.zeros((len(several), max(map(len, several), default=0)), np.int32)
    for row, s in zip(out, several, strict=True):
        row[: len(s)] = s
    return out


def fitted(counts: DataFrame, smooth: float = 0.01) -> Tagger:
    """The tagger of counted(): a row for each pair of tags and each shape under a tag, of which there are at most SHAPES times the tags.

    An I- tag follows no tag but those of its own type.
    """
    rows = counts.collect()
    tags = sorted({OUT} | {r["tag"] for r in rows})
    at = {t: k for k, t in enumerate(tags)}
    step, shows = np.full((len(tags), len(tags)), smooth), np.full((len(tags), SHAPES), smooth / SHAPES)
    for r in rows:
        if r["shape"] is None:
            step[at[r["before"]], at[r["tag"]]] += r["n"]
        else:
            shows[at[r["tag"]], r["shape"]] += r["n"]
    for a in tags:
        for b in tags:
            if b.startswith("I-") and a[2:] != b[2:]:
                step[at[a], at[b]] = 0.0
    with np.errstate(divide="ignore"):
        return Tagger(tags, np.log(step / step.sum(1, keepdims=True)), np.log(shows / shows.sum(1, keepdims=True)))


def windows(docs: DataFrame, most: int = 512, overlap: int = 128, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, window, at, text, first, last): the texts in windows of `most` characters, of which neighbours share `overlap`.

    Null and empty texts have none.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be less than a window")
    n = F.length("_text")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(most - overlap))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(n > 0)
    rows = rows.select("*", F.posexplode(starts).alias("window", "at"))
    return rows.select(F.col("_key").alias(key), "window", "at", F.substring("_text", F.col("at") + 1, F.lit(most)).alias("text"), (F.col("at") == 0).alias("first"), (F.col("at") + most >= n).alias("last"))


def tagged(cut: DataFrame, model: Callable[[list[str]], list[list[tuple[str, str, float, int, int]]]], overlap: int = 128, key: str = "doc_id") -> DataFrame:
    """Spans of a model in windows() of that overlap: (key, pii_type, confidence, start_pos, end_pos, cut_off), places those of the document.

    cut_off: the span touches an end of its window that is none of the text's. It counts only if it reaches beyond what the
    neighbour shares, which has seen it whole otherwise.
    """

    def counts(a: int, b: int, n: int, first: bool, last: bool) -> bool:
        return not (a == 0 and not first and b < overlap or b == n and not last and a > n - overlap)

    kind = cut.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column("text").to_pylist()
            rows = zip(*(batch.column(c).to_pylist() for c in (key, "at", "first", "last")), texts, model(texts), strict=True)
            for k, at, first, last, text, spans in rows:
                out += [(k, t, p, at + a, at + b, (a == 0 and not first) or (b == len(text) and not last)) for _, t, p, a, b in spans if counts(a, b, len(text), first, last)]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = (batch.column(key).type, pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [key, "pii_type", "confidence", "start_pos", "end_pos", "cut_off"])

    return cut.mapInArrow(run, f"{key} {kind}, pii_type string, confidence double, start_pos int, end_pos int, cut_off boolean")


def stitched(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of windows as spans of the document: (key, pii_type, confidence, start_pos, end_pos).

    Spans of one type that overlap are one; those that their window cuts off count only where no whole one overlaps them, and then
    reach from the first to the last. The confidence is the best of them.
    """
    order = Window.partitionBy(key, "pii_type").orderBy("start_pos", "end_pos")
    before = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.when(before.isNull() | (F.col("start_pos") >= before), 1).otherwise(0))
    rows = rows.withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = lambda c: F.when(~F.col("cut_off"), F.col(c))
    pick = lambda f, c: F.coalesce(f(whole(c)), f(c)).alias(c)
    return rows.groupBy(key, "pii_type", "_group").agg(pick(F.max, "confidence"), pick(F.min, "start_pos"), pick(F.max, "end_pos")).drop("_group")


def with_text(spans: DataFrame, docs: DataFrame, text: str = "text", key: str = "doc_id", reach: int = 50) -> DataFrame:
    """Adds text and context to spans that have places only."""
    from ..functions import text as X

    body = docs.select(key, F.col(text).alias("_text"))
    start, end = F.col("start_pos"), F.col("end_pos")
    cut: Column = F.substring("_text", start + 1, end - start)
    return spans.join(body, key).select(*spans.columns, cut.alias("text"), X.context(F.col("_text"), start, end, reach).alias("context"))
