"""Spelling variants: words one edit apart, found in a trie of letter counts.

1. Words are counted over whole texts, in numpy a piece of text at a time, then by Spark.
2. A word becomes a vector: how many letters of each group it has. The words of a branch, which agree
in the counts of the first groups, are arranged by those of one group after another as a trie.
3. A word walks down the tries of all branches it can reach. It may spend one surplus (the other word has
one letter more of a group) and after it one deficit (one letter less): an inserted letter is a surplus, a replaced one a
surplus and a deficit or neither. The other direction of each pair is left to the other word.
4. Words of a leaf that share either half with the asking word are compared letter by letter.

A task holds one part of a branch's words at a time; what it returns is summed up for each word, no pair becomes a row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as T
from ._shared import checkpointed

#: Letter groups, level after level of the trie; all other letters are one more group.
GROUPS = ["ea", "io", "nr", "ts", "lu", "dc", "mp", "gbh", "fvwy"]
#: Groups whose counts choose a branch, which is one trie of a task.
BRANCH = 4
#: Branches up to which their sizes are broadcast; beyond it they are joined by shuffle.
BROADCAST_BRANCHES = 100_000
#: Words of a branch that one task holds; a larger branch is cut.
HELD = 500_000
#: Least number of asking words for which a branch is dealt out to more tasks.
ASKING = 4096

LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
#: Lead byte of U+00C0 to U+00FF in UTF-8; the byte after it is the code point less 0x40.
LEAD = 0xC3
_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c
_LEVEL = np.full(256, len(GROUPS), np.uint8)
for _i, _group in enumerate(GROUPS):
    _LEVEL[[ord(c) for c in _group]] = _i


def _crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray, most: int = 64) -> np.ndarray:
    """CRC-32 of each span, carried on from the CRC-32 in begun."""
    order = np.argsort(starts - ends, kind="stable")
    s, size = starts[order], (ends - starts)[order]
    state = ~begun[order].astype(np.uint32)
    for k in range(min(most, int(size[0]) if len(size) else 0)):
        on = int(np.searchsorted(-size, -k, "left"))
        state[:on] = _CRC[(state[:on] ^ data[s[:on] + k]) & 255] ^ (state[:on] >> np.uint32(8))
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in order[: int(np.searchsorted(-size, -most, "left"))]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(begun[i]))
    return out


def _counted(least: int, every: int):
    """Words of at least `least` code points and how often they stand in a piece of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.small(batches, 4096):
            data, offs = T.buffers(batch.column("text"))
            names = [f"{x}:".encode() for x in batch.column("id").to_pylist()]
            for i, j in T.pieces(offs, 4 << 20):
                yield _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], names[i:j], least, every)

    return run


def _words(data: np.ndarray, offs: np.ndarray, names: list[bytes], least: int, every: int) -> pa.RecordBatch:
    lead = data == LEAD
    inside = LETTER[data] | lead
    inside[1:] |= lead[:-1]
    s, e, begin = T.runs(inside, offs)
    letters = e - s - np.diff(np.concatenate([[0], np.cumsum(lead)])[np.stack([s, e])], axis=0)[0] if len(s) else e - s
    row = np.searchsorted(begin, np.arange(len(s)), "right") - 1
    long = letters >= least
    s, e, letters, row = s[long], e[long], letters[long], row[long]
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    crc = _crc32(low, s, e, np.array([zlib.crc32(x) for x in names], np.uint32)[row])
    cut = crc % every == 0
    shorter: Counter[str] = Counter()
    for a, b, n, h in zip(s[cut].tolist(), e[cut].tolist(), letters[cut].tolist(), crc[cut].tolist(), strict=True):
        if n > least:
            word = low[a:b].tobytes().decode("utf-8", "replace")
            shorter[word[: h % n] + word[h % n + 1 :]] += 1
    s, e = s[~cut], e[~cut]
    _, first, n = np.unique(T.word_hashes(low, s, e), return_index=True, return_counts=True)
    words = pa.concat_arrays([T.strings(low, s[first], e[first]), pa.array(list(shorter), pa.string())])
    return pa.RecordBatch.from_arrays([words, pa.array(np.concatenate([n, list(shorter.values())]).astype(np.int64))], ["word", "n"])


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 6, often: int = 5, every: int = 199) -> DataFrame:
    """(word, n) of the words of at least `least` code points and `often` occurrences.

    Words are runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased. Where `every` divides the CRC-32 of
    '<key>:<run>', the run's code point at that CRC-32 modulo its length is left out first. A null key is an empty one.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_counted(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


class _Words:
    """Words in Latin-1 bytes, with letter counts and hashes of their halves."""

    def __init__(self, words: pa.Array, n: pa.Array):
        data, offs = T.buffers(words)
        lead = data == LEAD
        after = np.zeros(len(data), bool)
        after[1:] = lead[:-1]
        kept = np.concatenate([[0], np.cumsum(~lead)])
        self.data = np.where(after, data + np.uint8(0x40), data).astype(np.uint8)[~lead]
        self.at = kept[offs]
        self.size = np.diff(self.at)
        self.words, self.n = words, n.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(words)), self.size)
        levels = len(GROUPS) + 1
        self.counts = np.bincount(row * levels + _LEVEL[self.data], minlength=len(words) * levels).reshape(-1, levels)
        self.sums = T.prefix(T.byte_table(1)[self.data])

    def halves(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the beginning and the end of each word, as long as the halves of a word of length `of` are."""
        lo, hi = self.at[:-1], self.at[1:]
        return T.span_hash(self.sums, lo, lo + of // 2), T.span_hash(self.sums, hi - (of - of // 2), hi)

    def bytes(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether b is a with one sign inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) <= 1 and a != b and a[i + (len(a) == len(b)) :] == b[i + 1 :]


class _Trie:
    """The words of a branch, arranged by length and then by the counts of one letter group after another."""

    def __init__(self, words: pa.Array, n: pa.Array):
        self.w = w = _Words(words, n)
        self.order = np.lexsort([*w.counts.T[::-1], w.size])
        self.counts, self.size = w.counts[self.order], w.size[self.order]
        self.same = [x[self.order] for x in w.halves(w.size)]
        self.longer = [x[self.order] for x in w.halves(np.maximum(w.size - 1, 0))]

    def leaves(self, q: _Words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Depth first: each leaf as a range of the arrangement, the asking words that reach it, and what they spent."""
        edge = [0, *(np.flatnonzero(np.diff(self.size)) + 1), len(self.size)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            size = self.size[lo] if hi > lo else 0
            asking = np.flatnonzero((q.size == size) | (q.size == size - 1))
            stack = [(lo, hi, 0, asking, np.zeros(len(asking), np.int8))]
            while stack:
                lo, hi, level, asking, spent = stack.pop()
                if level == self.counts.shape[1]:
                    yield lo, hi, asking, spent
                    continue
                column, wanted = self.counts[lo:hi, level], q.counts[asking, level]
                cut = [0, *(np.flatnonzero(np.diff(column)) + 1), hi - lo]
                for i, j in zip(cut, cut[1:], strict=False):
                    off = column[i] - wanted
                    on = (off == 0) | (off == 1) & (spent == 0) | (off == -1) & (spent == 1)
                    if on.any():
                        stack.append((lo + i, lo + j, level + 1, asking[on], spent[on] + (off[on] != 0)))

    def near(self, q: _Words) -> Iterator[tuple[int, int]]:
        """Pairs of an asking word and a word of the trie that are one edit apart, each pair from one of its words only."""
        first, second = q.halves(q.size)
        for lo, hi, asking, spent in self.leaves(q):
            found = []
            for mine, of_words in ((asking[spent != 1], self.same), (asking[spent == 1], self.longer)):
                for ask, words in zip((first, second), of_words, strict=True):
                    order = np.argsort(words[lo:hi], kind="stable")
                    there = words[lo:hi][order]
                    a, b = np.searchsorted(there, ask[mine], "left"), np.searchsorted(there, ask[mine], "right")
                    if (n := b - a).any():
                        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                        found.append(np.stack([np.repeat(mine, n), lo + order[at]]))
            if found:
                for i, k in np.unique(np.concatenate(found, axis=1), axis=1).T.tolist():
                    x, y = q.bytes(i), self.w.bytes(k := int(self.order[k]))
                    # Words with equal counts meet from both sides, and a word meets itself.
                    if (len(x) < len(y) or x < y or (q.counts[i] != self.w.counts[k]).any()) and one_edit(x, y):
                        yield i, k


FOUND = "word string, n_near long, n long, near string"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word how many near words this part of a branch has, and the most frequent of them."""
    trie, parts, side = None, [], None

    def told(w: _Words, near: dict[int, list]) -> pa.RecordBatch:
        rows = [(w.words[i].as_py(), x[0], -x[1], x[2]) for i, x in near.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "n", "near"])

    def add(near: dict[int, list], i: int, n: int, word: str) -> None:
        x = near.setdefault(i, [0, 0, ""])
        x[0] += 1
        if x[0] == 1 or (-n, word) < (x[1], x[2]):
            x[1:] = -n, word

    for (_, _, asks), batch, new in T.groups(batches, ["branch", "cell", "asks"]):
        if asks == 0:
            parts = [*([] if new else parts), batch]
            trie, side = None, "words"
            continue
        if new and side != "words":
            trie, parts = None, []
        side = "asks"
        if not parts and trie is None:
            continue
        if trie is None:
            held = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            trie, parts = _Trie(held.column("word"), held.column("n")), []
        q = _Words(batch.column("word"), batch.column("n"))
        of_asking: dict[int, list] = {}
        of_words: dict[int, list] = {}
        for i, k in trie.near(q):
            add(of_asking, i, int(trie.w.n[k]), trie.w.words[k].as_py())
            add(of_words, k, int(q.n[i]), q.words[i].as_py())
        for w, near in ((q, of_asking), (trie.w, of_words)):
            if near:
                yield told(w, near)


def near_words(words: DataFrame, held: int = HELD) -> DataFrame:
    """(word, n_near, n, near): how many of the words, a table of distinct (word, n), are one edit from each word that has any,
    and the most frequent of them (ties: the smallest)."""
    spark = words.sparkSession
    count = [F.length("word") - F.length(F.translate("word", g, "")) for g in GROUPS[:BRANCH]]
    shifts = [()] + [((i, 1),) for i in range(BRANCH)] + [((i, 1), (j, -1)) for i in range(BRANCH) for j in range(i + 1, BRANCH)]
    branch = lambda shift: F.xxhash64(*(c + dict(shift).get(i, 0) for i, c in enumerate(count)))
    index = words.select("word", "n", branch(()).alias("branch"))
    asking = words.select("word", "n", F.explode(F.array_distinct(F.array(*map(branch, shifts)))).alias("branch"))
    sizes = index.groupBy("branch").agg(F.count("*").alias("words")).join(asking.groupBy("branch").agg(F.count("*").alias("asking")), "branch")
    sizes = checkpointed(sizes)
    total = sizes.agg(F.count("*"), F.coalesce(F.sum("asking"), F.lit(0))).first()
    each = max(ASKING, total[1] // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # A branch's words are cut where a task could not hold them; the asking words, where they are many, and then each part of them
    # gets the words. That is at most as often as a word asks branches, so copies stay in proportion.
    grid = sizes.select("branch", F.ceil(F.col("words") / held).alias("down"), F.least(F.lit(len(shifts)).cast("long"), F.ceil(F.col("asking") / each)).alias("across"))
    if total[0] <= BROADCAST_BRANCHES:
        grid = F.broadcast(grid)
    own = lambda n: F.pmod(F.xxhash64("word", F.lit(1)), n)
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    index = index.join(grid, "branch").withColumn("x", to("across")).select("branch", (own(F.col("down")) * F.col("across") + F.col("x")).alias("cell"), F.lit(0).alias("asks"), "word", "n")
    asking = asking.join(grid, "branch").withColumn("x", to("down")).select("branch", (F.col("x") * F.col("across") + own(F.col("across"))).alias("cell"), F.lit(1).alias("asks"), "word", "n")
    rows = index.unionAll(asking).repartition("branch", "cell").sortWithinPartitions("branch", "cell", "asks")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("near"))).alias("best")
    found = rows.mapInArrow(_asked, FOUND).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.n")).alias("n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word that has a form: the last word that following forms leads to. Forms never go round."""
    out = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = checkpointed(out.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if out.filter("moved").isEmpty():
            return out.select("word", "root")


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 6, often: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """The words of whole texts with the form each is a variant of.

    Returns word, form, root, n, n_near, form_n for each word of vocabulary(). Two words are near if they differ by one inserted,
    deleted or replaced code point. form is the near word of largest n (ties: the smallest in code-point order) if that is at
    least `ratio` times the word's own, else null; root follows forms to the last, the word itself if it has
    none. Null and empty texts have no words; an empty table gives no rows; rows that repeat count again; words of any length are
    compared whole; other columns are not read.
    """
    words = checkpointed(vocabulary(docs, text, key, least, often, every))
    near = near_words(words).select("word", "n_near", F.col("n").alias("near_n"), "near")
    far = F.col("near_n") >= F.col("n") * ratio
    out = words.join(near, "word", "left").select("word", F.when(far, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("near_n")).alias("form_n"))
    out = checkpointed(out)
    out = out.join(roots(out.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
