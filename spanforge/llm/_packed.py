"""Corpus-wide questions about hashes, asked in packed form.

The rows go through one exchange in batches of neighbours, each batch as one compressed value. Every
later step reads that exchange (Spark reuses it), so a row's batch is settled once and a text is
shuffled once however often it is read. A batch makes its hashes unique and sends those of one bucket as
one binary value, so that Spark shuffles a few large rows in place of one row for each position of
the corpus, and a hot hash goes once for each batch. The task that owns a bucket sees all
sightings of its hashes and answers each batch, again in packed form. Buckets follow
spark.sql.shuffle.partitions, so what one task holds stays even when the input grows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from . import _text as T

SENT = "bid long, kind int, bucket int, body binary, tail binary"
BACK = "bid long, kind int, body binary"


def buckets(spark: SparkSession, each: int = 4) -> int:
    """As many buckets to a shuffle partition."""
    return each * max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def batches(rows: DataFrame, most_rows: int = 512, most_bytes: int = 8 << 20, more: Callable[[pa.Array], pa.Array] | None = None) -> GroupedData:
    """The rows (id, text) by bid: batches of neighbours, of at most most_rows rows and, unless one text is longer, most_bytes of text.

    bid is the place of a batch's first row in the scan. more makes a further column from the texts.
    """

    def pack(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            _, offs = T.buffers(table.column("text"))
            bids = table.column("uid").to_numpy()
            for i, j in T.pieces(offs, most_bytes, most_rows):
                columns = {k: table.column(k).slice(i, j - i) for k in ("id", "text")}
                if more:
                    columns["more"] = more(columns["text"])
                part = pa.record_batch(columns)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([bids[i]], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bid", "rows"])

    return rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(pack, "bid long, rows binary").groupBy("bid")


def unpacked(left: pa.Table) -> pa.Table:
    """The rows of a batch."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in bodies(left, "rows")])


def bid_of(left: pa.Table) -> int:
    return left.column("bid")[0].as_py()


def by_bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """The order of buckets, in which hashes of one bucket keep theirs."""
    return np.argsort(((hashes >> T.U(40)) % T.U(n)).astype(np.uint32), kind="stable")


def send(bid: int, kind: int, hashes: np.ndarray, n: int, body: Callable[[np.ndarray], bytes], tail: Callable[[np.ndarray], bytes] | None = None) -> pa.Table:
    """One row for each bucket; body and tail pack the chosen positions of hashes."""
    order = by_bucket(hashes, n)
    found, first = np.unique((hashes[order] >> T.U(40)) % T.U(n), return_index=True)
    parts = np.split(order, first[1:]) if len(order) else []
    columns = [[bid] * len(found), [kind] * len(found), found.astype(np.int32), [body(p) for p in parts], [tail(p) if tail else b"" for p in parts]]
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(_SENT.items(), columns, strict=True)})


_SENT = {"bid": pa.int64(), "kind": pa.int32(), "bucket": pa.int32(), "body": pa.binary(), "tail": pa.binary()}


def nothing() -> pa.Table:
    return pa.table({k: pa.array([], t) for k, t in _SENT.items()})


def ask(sent: DataFrame, answer: Callable[[pa.Table], list[bytes | None]]) -> DataFrame:
    """Gives each kind of each bucket to answer, which returns a value for each of its rows (None: nothing to say)."""

    def run(table: pa.Table) -> pa.Table:
        kind, out = table.column("kind").to_numpy(), []
        for k in np.unique(kind):
            part = table.filter(pa.array(kind == k))
            body = pa.array(answer(part), pa.binary())
            out.append(pa.table({"bid": part.column("bid"), "kind": part.column("kind"), "body": body}).filter(body.is_valid()))
        return pa.concat_tables(out)

    return sent.groupBy("bucket").applyInArrow(run, BACK)


def bodies(table: pa.Table, name: str = "body") -> list[bytes]:
    return table.column(name).to_pylist()


def of_kind(table: pa.Table, kind: int) -> list[bytes]:
    """The bodies of the answers of one kind."""
    return [b for k, b in zip(table.column("kind").to_pylist(), bodies(table), strict=True) if k == kind]


def hashes_of(raw: list[bytes]) -> np.ndarray:
    """The distinct 64-bit hashes of some answers, in order."""
    return np.unique(np.frombuffer(b"".join(raw), "<u8"))


def low5(h: np.ndarray) -> bytes:
    """The low 40 bits of each hash; the bucket holds further ones."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_low5(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(T.U)


WIDE = np.dtype([("a", "<u8"), ("b", "<u4")])


def wide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """96-bit hashes as records."""
    out = np.empty(len(a), WIDE)
    out["a"], out["b"] = a, (b >> T.U(32)).astype(np.uint32)
    return out


def wide_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal records together, and the number of the run of each in that order."""
    order = np.lexsort((x["b"], x["a"]))
    y = x[order]
    new = np.ones(len(y), bool)
    new[1:] = (y["a"][1:] != y["a"][:-1]) | (y["b"][1:] != y["b"][:-1])
    return order, np.cumsum(new) - 1


def repeated(raw: list[np.ndarray], twice: list[bytes], order: np.ndarray, run: np.ndarray) -> list[np.ndarray]:
    """Which entries of each row have two sightings or more; a batch says of each entry whether it has it twice."""
    seen = np.bincount(run, weights=(np.frombuffer(b"".join(twice), np.uint8) + 1.0)[order])
    hit = np.empty(len(order), bool)
    hit[order] = seen[run] >= 2
    return np.split(hit, np.cumsum([len(r) for r in raw])[:-1])


def repeated_wide(table: pa.Table) -> list[bytes | None]:
    """answer() for rows of unique 96-bit hashes (body) and whether the batch has each twice (tail).

    Those with two sightings go back by their first 64 bits, enough to tell the hashes of one batch apart.
    """
    raw = [np.frombuffer(b, WIDE) for b in bodies(table)]
    hits = repeated(raw, bodies(table, "tail"), *wide_runs(np.concatenate(raw)))
    return [np.ascontiguousarray(r["a"][h]).tobytes() or None for r, h in zip(raw, hits, strict=True)]


def repeated_hashes(table: pa.Table) -> list[bytes | None]:
    """The same for 64-bit hashes."""
    raw = [np.frombuffer(b, "<u8") for b in bodies(table)]
    x = np.concatenate(raw)
    order = np.argsort(x, kind="stable")
    run = np.cumsum(np.concatenate([[0], x[order][1:] != x[order][:-1]]))
    return [r[h].tobytes() or None for r, h in zip(raw, repeated(raw, bodies(table, "tail"), order, run), strict=True)]


def unique_wide(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unique 96-bit hashes and whether each occurs twice."""
    x = wide(a, b)
    order, run = wide_runs(x)
    if not len(x):
        return x, np.zeros(0, np.uint8)
    n = np.bincount(run)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    return x[order[first]], (n > 1).astype(np.uint8)
