"""Toxicity of deobfuscated text.

A noisy channel writes words with look-alike signs, doubled letters and gaps between letters. Each
written word that could be such a form becomes a lattice of letters; Viterbi search under a
character trigram model of the corpus restores the likeliest word. A lexicon of words and word
beginnings, learnt from labelled rows after restoring them too, scores the restored text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import _text as T


#: Letters that a sign can stand for.
SIGNS = {"@": "a", "4": "a", "8": "b", "(": "c", "3": "e", "€": "e", "6": "g", "9": "g", "#": "h", "1": "il", "!": "il", "|": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z", "*": "aeiou"}
#: Letters of the model: a to z, the Latin-1 letters above them, and one class for all else.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
SIZE = len(LETTERS) + 1
_CODE = {c: k + 1 for k, c in enumerate(LETTERS)}
#: Log probabilities of the channel.
SIGN_COST, DROP_COST, KEEP_COST = -1.0, -0.5, -4.0
#: Shares of a text's words that tell how dense a beginning stands in it.
RATES = (1 / 400, 1 / 200, 1 / 100, 1 / 50)
#: Words that a task remembers, restored or known to tell nothing.
REMEMBERED = 300_000

_GAP = re.compile(r"[ .\-_*/]")
_SPACED = re.compile(r"(?<!\S)\S(?:[ .\-_*/]\S){3,}(?!\S)")
_EDGE = re.compile(r"^[^\w@$€]+|[^\w@$€]+$")
_PLAIN = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "@$_")
_SIGN = re.compile(r"[@48(3€69#1!|05$7+2*]")
_LETTER = re.compile(r"[^\W\d_]")
_INNER = re.compile(r"[^\W\d_][.\-_~'`]+[^\W\d_]")
_RUN = re.compile(r"([^\W\d_])\1\1")
_DOUBLE = re.compile(r"([^\W\d_])\1+")
#: Signs as the first and as the last letter each can stand for.
_READ = tuple(str.maketrans({c: x[k] for c, x in SIGNS.items()}) for k in (0, -1))
#: What is stripped of a word whose first or last sign may stand for a letter.
_BLANK = "".join(c for c in _PLAIN if c not in SIGNS)


def _codes() -> np.ndarray:
    table = np.zeros(1 << 16, np.int64)
    for c, k in _CODE.items():
        table[ord(c)] = k
    return table


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) for the letter trigrams of all texts; whatever is no letter is an edge. At most SIZE ** 3 rows."""

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = _codes(), np.zeros(SIZE**3, np.int64)
        for batch in T.small(tables):
            raw = " ".join(x or "" for x in batch.column(0).to_pylist()).lower()
            for i in range(0, len(raw), 1 << 20):
                points = np.frombuffer(raw[i : i + (1 << 20) + 2].encode("utf-32-le"), np.uint32)
                k = table[np.minimum(points, 0xFFFF)]
                total += np.bincount((k[:-2] * SIZE + k[1:-1]) * SIZE + k[2:], minlength=SIZE**3)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["gram", "n"])

    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Channel:
    """The decoder: a character model, and what it restored before."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        three = np.zeros(SIZE**3)
        three[grams] = counts
        three = three.reshape(SIZE, SIZE, SIZE)
        two, one = three.sum(0), three.sum((0, 1))
        one = (one + 1) / (one.sum() + SIZE)
        two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
        self.logp = np.log((three + 5 * two) / (three.sum(2, keepdims=True) + 5)).astype(np.float32)
        self.known: dict[str, str] = {}

    def restore(self, word: str) -> str:
        """The likeliest word behind a written one (lower case)."""
        bare = word.strip(_PLAIN)
        if bare.isalpha() and not _RUN.search(bare):
            return bare
        found = self.known.get(word)
        if found is None:
            found = self._restore(word)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = found
        return found

    def _restore(self, word: str) -> str:
        bare = _EDGE.sub("", word)
        if not _LETTER.search(bare) or not (_SIGN.search(bare) or _RUN.search(bare) or _INNER.search(bare)):
            return bare
        return self.decode(bare)

    def decode(self, word: str) -> str:
        """Viterbi over the lattice: each sign yields a letter or, if it repeats the one before, nothing."""
        # state: the last two letters; value: log probability and the letters so far
        beam = {(0, 0): (0.0, "")}
        last = ""
        for c in word:
            options = [(x, SIGN_COST) for x in SIGNS.get(c, "")]
            if c in _CODE:
                options.append((c, 0.0))
            elif c.isalnum():
                options.append((c, KEEP_COST))
            after: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (score, text) in beam.items():
                steps = [((b, k), score + cost + float(self.logp[a, b, k]), text + x) for x, cost in options for k in (_CODE.get(x, 0),)]
                if c == last or (text and (text[-1] == c or text[-1] in SIGNS.get(c, ""))) or not c.isalnum():
                    steps.append(((a, b), score + DROP_COST, text))
                for state, value, letters in steps:
                    if state not in after or value > after[state][0]:
                        after[state] = (value, letters)
            beam, last = after or beam, c
        return max((score + float(self.logp[a, b, 0]), text) for (a, b), (score, text) in beam.items())[1]

    def words(self, text: str) -> tuple[Counter, int]:
        """How often each restored word stands in a text, words that gaps between letters part among them; and the number of written words."""
        low = text.lower()
        written, out = Counter(low.split()), Counter()
        for word, n in written.items():
            out[self.restore(word)] += n
        for spaced in _SPACED.findall(low):
            out[self.decode(_GAP.sub("", spaced))] += 1
        return out, written.total()

    def places(self, text: str) -> Iterator[tuple[str, str]]:
        """The restored words in order, with what is written around each."""
        low = text.lower()
        written = ["", *low.split(), ""]
        for before, word, after in zip(written, written[1:], written[2:], strict=False):
            yield self.restore(word), f"{before} {after}"
        for m in _SPACED.finditer(low):
            yield self.decode(_GAP.sub("", m[0])), f"{low[max(m.start() - 12, 0) : m.start()]}{low[m.end() : m.end() + 12]}"


@lru_cache(maxsize=REMEMBERED)
def _beginnings(word: str) -> tuple[str, ...]:
    """Beginnings of four to seven letters, marked with a hyphen."""
    return tuple(f"{word[:k]}-" for k in range(4, min(len(word), 8)))


def _levels(n: int, words: int) -> range:
    """The levels of RATES that n of some words reach; a single one reaches none."""
    return range(sum(n >= rate * words for rate in RATES) if n > 1 else 0)


def _features(found: Counter, words: int) -> set[str]:
    """Words, beginnings, and beginnings with each level of the share of words that have them."""
    begun = Counter()
    for word, n in found.items():
        for x in _beginnings(word):
            begun[x] += n
    return {*found, *begun, *(f"{x}{k}" for x, n in begun.items() for k in _levels(n, words))}


def _surely(toxic: int, clean: int, z: float = 2.0) -> float:
    """Lower bound of the share of toxic rows among those with a feature (Wilson)."""
    n = toxic + clean
    p = toxic / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def train_lexicon(docs: DataFrame, labels: DataFrame, grams: tuple[np.ndarray, np.ndarray], rows: int = 100_000, text: str = "text", key: str = "doc_id") -> dict[str, float]:
    """Features that at least half of the rows with them are toxic, with a bound of that share.

    Learnt from some `rows` labelled rows at most, chosen by a hash of their key: that bounds what is
    broadcast (16 bytes a row), and with it the features that reach the driver: only those that four
    toxic rows or more have, and more toxic ones than clean or any beginning.
    """
    picked = labels.select(F.col(key).alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().distinct()
    total = picked.count()
    if total > rows:  # by hash: an order with a limit would send that many rows of each partition to the driver
        picked = picked.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(0.98 * rows / total * (1 << 30)))
    train = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id").select("text", "toxic")

    def count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        channel, seen = Channel(*grams), (Counter(), Counter())
        for batch in T.small(tables):
            for body, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[toxic > 0].update(_features(*channel.words(body or "")))
            if len(seen[0]) > 200_000:
                yield from flush(seen)
        yield from flush(seen)

    def flush(seen: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in seen)], ["feature", "clean", "toxic"])
        for c in seen:
            c.clear()

    found = train.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    found = found.filter((F.col("toxic") >= 4) & ((share > 0.5) | F.endswith("feature", F.lit("-")))).collect()
    counts = {r.feature: np.array([r.toxic, r.clean]) for r in found}
    names = {x for x, (toxic, clean) in counts.items() if toxic > clean}
    dense = {x[:-1] for x in names if x[-1].isdigit() and x[-2:-1] == "-"}

    def places(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row and feature the first word that has it, and what is written around it."""
        channel = Channel(*grams)
        for batch in T.small(tables):
            seen = set()
            for body in batch.column("text").to_pylist():
                first: dict[str, tuple[str, str]] = {}
                n, total = Counter(), len((body or "").split())
                for word, place in channel.places(body or ""):
                    begun = _beginnings(word)
                    n.update(x for x in begun if x in dense)
                    for x in (word, *begun):
                        if x in names or x in dense:
                            first.setdefault(x, (word, place))
                for x in n:
                    first |= {f"{x}{k}": first[x] for k in _levels(n[x], total)}
                seen.update((x, *first[x]) for x in first.keys() & names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*seen, strict=True) if seen else ([], [], []))], ["feature", "word", "place"])

    # Copies of one toxic text make all its words look toxic: a feature counts once for each surrounding.
    # A beginning says no more than its one word unless it begins several.
    around = train.filter("toxic > 0").select("text").mapInArrow(places, "feature string, word string, place string").distinct().groupBy("feature")
    varied = {r.feature: (r.n, r.words) for r in around.agg(F.count("*").alias("n"), F.countDistinct("word").alias("words")).collect()}
    bounds = {}
    for x in names:
        n, words = varied.get(x, (0, 0))
        if n >= 4 and (words >= 3 or "-" not in x[-2:]):
            toxic, clean = counts[x].tolist()
            bounds[x] = _surely(min(toxic, n), clean)
    return _without_sparse({x: p for x, p in bounds.items() if p >= 0.55}, counts)


def _without_sparse(lexicon: dict[str, float], counts: dict[str, np.ndarray], sure: float = 0.9) -> dict[str, float]:
    """The lexicon without words that tell something only where their beginning is dense.

    Such a beginning is in the lexicon with a level, and most rows that have it more thinly are clean.
    """
    lowest: dict[str, int] = {}
    for x in lexicon:
        if x[-1:].isdigit() and x[-2:-1] == "-":
            lowest[x[:-1]] = min(int(x[-1]), lowest.get(x[:-1], len(RATES)))
    thin = {}
    for x, level in lowest.items():
        toxic, clean = counts.get(x, np.zeros(2)) - counts[f"{x}{level}"]
        thin[x] = toxic <= clean
    return {x: p for x, p in lexicon.items() if p >= sure or x[:-1] in lowest or not any(thin.get(b) for b in (x, *_beginnings(x.rstrip("-"))))}


def _single(word: str) -> str:
    """The word with each run of a letter as one."""
    return _DOUBLE.sub(r"\1", word)


class Scorer:
    """Scores texts, and remembers which written words tell nothing."""

    def __init__(self, channel: Channel, lexicon: dict[str, float], prior: float = 0.01):
        self.channel, self.lexicon, self.prior = channel, lexicon, prior
        self.dense = {x[:-1] for x in lexicon if x[-1:].isdigit() and x[-2:-1] == "-"}
        self.dull: set[str] = set()
        bare = {x.rstrip("0123456789").rstrip("-") for x in lexicon}
        self.single = {_single(x) for x in bare}
        self.sizes = sorted({len(x) for x in self.single})

    def may_tell(self, word: str) -> bool:
        """Whether something of the lexicon begins a word of letters, but for doubled ones."""
        word = _single(word)
        return any(word[:k] in self.single for k in self.sizes)

    def meant(self, written: str) -> tuple[str, float, list[str]]:
        """The word behind a written one and what it tells.

        A word that tells nothing as it stands, or without the signs at its ends, is decoded with its doubled letters, and with its
        end signs as letters, if such a reading could tell something. An end sign counts as a letter only in a whole word of the lexicon.
        """
        word = self.channel.restore(written)
        p, begun = self.tells(word)
        full = written.strip(_BLANK)
        first, last = full[:1], full[-1:]
        signs = [SIGNS.get(c, "") if not c.isalnum() else "" for c in (first, last)]
        if p or begun or len(full) < 4 or not (any(signs) or _DOUBLE.search(full)):
            return word, p, begun
        bare = full[bool(signs[0]) : len(full) - bool(signs[1])]
        if not bare.isalpha():
            return word, p, begun
        if self.may_tell(bare):
            other = self.channel.decode(bare)
            q, begun_of_other = self.tells(other)
            if q or begun_of_other:
                return other, q, begun_of_other
        for reading in (f"{x}{bare}{y}" for x in ["", *signs[0]] for y in ["", *signs[1]] if x or y):
            if self.may_tell(reading) and (other := self.channel.decode(reading)) in self.lexicon:
                return other, *self.tells(other)
        return word, p, begun

    def spaced(self, written: str) -> list[str]:
        """Words with gaps between their letters: as one word or, if that tells nothing, those of the lexicon that some of the letters make."""
        letters = _GAP.sub("", written)
        one = self.channel.decode(letters)
        if any(self.tells(one)):
            return [one]
        out, most = [one], 2 * max(self.sizes, default=0)
        for plain in {letters.translate(x) for x in _READ}:
            i = 0
            while i < len(plain):
                found = None
                if self.may_tell(plain[i : i + most]):
                    whole = ((self.channel.decode(letters[i:j]), j) for j in range(min(i + most, len(plain)), i + 3, -1))
                    found = next((x for x in whole if x[0] in self.lexicon), None)
                out += [found[0]] if found else []
                i = found[1] if found else i + 1
        return out

    def tells(self, word: str) -> tuple[float, list[str]]:
        """What a restored word tells, and which of its beginnings may stand densely."""
        begin = _beginnings(word)
        return max((self.lexicon.get(x, 0.0) for x in (word, *begin)), default=0.0), [x for x in begin if x in self.dense]

    def score(self, text: str) -> float:
        """1 less the chance that none of the distinct toxic words, nor the densest toxic beginning, is meant so."""
        low = text.lower()
        written, told, thick = low.split(), {}, []
        new = set(written) - self.dull
        for w in new:
            word, p, begun = self.meant(w)
            if p:
                told[word] = p
            if begun:
                thick.append((w, begun))
            elif not p:
                self.dull.add(w)
        if len(self.dull) > REMEMBERED:
            self.dull.clear()
        n = Counter()
        for word in (w for spaced in _SPACED.findall(low) for w in self.spaced(spaced)):
            p, begun = self.tells(word)
            if p:
                told[word] = p
            n.update(begun)
        if thick:
            times = Counter(written)
            for w, begun in thick:
                for x in begun:
                    n[x] += times[w]
        clean = 1.0 - self.prior
        for p in told.values():
            clean *= 1.0 - p
        return 1.0 - clean * (1.0 - max((self.lexicon.get(f"{x}{k}", 0.0) for x in n for k in _levels(n[x], len(written))), default=0.0))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = 100_000, text: str = "text", key: str = "doc_id", score: str = "toxic_score") -> DataFrame:
    """Adds a score (0 to 1) of the given name to all columns of docs.

    labels has key and toxic and should hold training rows only. The score of a text without any
    word of the lexicon, empty and null ones included, is the prior 0.01; with no toxic labelled row
    all have it. Rows that repeat score alike; an earlier column of the score's name is replaced. Counts of the
    character model cover all texts; the model and the lexicon have a fixed size.
    """
    learnt = trigram_counts(docs.select(text)).toPandas()
    grams = (learnt["gram"].to_numpy(np.int64), learnt["n"].to_numpy(np.float64))
    lexicon = train_lexicon(docs, labels, grams, rows, text=text, key=key)
    docs = docs.drop(score)
    kept = docs.columns

    def scored(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Channel(*grams), lexicon)
        for batch in T.small(tables):
            body = batch.column(kept.index(text)).to_pylist()
            out = pa.array([scorer.score(x or "") for x in body], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*kept, score])

    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    return docs.mapInArrow(scored, schema)
