"""Vectorised text helpers that run inside Spark tasks: tokens, rolling hashes and row batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_cache.get("p", ())) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for key, base in (("p", _BASE), ("q", _INVERSE)):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _cache[key] = np.cumprod(steps, dtype=U)
    return _cache["p"][:n], _cache["q"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection that spreads every input bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D) + U(seed * 2 + 1))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values weighted by position, for span_hash."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * _powers(len(values))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of values[lo:hi] for each pair, the same wherever the span stands; its length counts."""
    raw = (sums[hi] - sums[lo]) * _powers(len(sums))[1][lo]
    return mix(raw + (hi - lo).astype(U) * U(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column one after another, and each row's offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what is made of one batch stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def pieces(offsets: np.ndarray, most: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` bytes and `rows` rows; a longer row makes a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, i + rows, n)
        yield i, j
        i = j


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII that is neither letter nor digit; every byte of a non-ASCII character counts as a letter.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes outside gap), and for each row where its words begin."""
    return runs(~gap[data], offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are inside, none across rows, and for each row where its runs begin."""
    n = len(inside)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | cut[1:n]
        last[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    return span_hash(prefix(byte_table(seed)[data]), starts, ends)


def windows(begin: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of n consecutive items that stay inside one row; begin: each row's first item, and the end."""
    total = int(begin[-1]) if len(begin) else 0
    ok = np.zeros(total + 1, np.int32)
    lo, hi = begin[:-1], begin[1:] - n + 1
    keep = hi > lo
    np.add.at(ok, lo[keep], 1)
    np.add.at(ok, hi[keep], -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def spread(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of total items some run of `length` from one of starts covers."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + length, -1)
    return np.cumsum(step[:-1]) > 0


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


def member(sorted_values: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Which queries occur among the sorted values."""
    if not len(sorted_values):
        return np.zeros(len(queries), bool)
    at = np.searchsorted(sorted_values, queries)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == queries


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of UTF-8 bytes as a string column."""
    size = ends - starts
    offs = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offs[1:])
    body = data[np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(body.tobytes())]).cast(pa.string())


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 1 << 14) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """Rows that come ordered by keys, cut where a key changes and by rows: the key, rows, and whether a new key begins."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        edge = [0, *np.flatnonzero(new), batch.num_rows]
        for lo, hi in zip(edge, edge[1:], strict=False):
            key = tuple(c[lo].item() for c in columns)
            for i in range(lo, hi, most):
                yield key, batch.slice(i, min(most, hi - i)), key != last
                last = key
