"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

X holds the centred vectors, a row each. Each step makes a column u of U and a column v of V with X V = U B and
B bidiagonal: u from the product X v, the next v from the product of X transposed with u. Both products are one pass over all
rows, of which each task adds up a vector as long as a row. The columns of U are as long as the table; they are kept as
the combinations of X's columns that they are, u = X a, so that no step stores or moves a number for each row. Each new u and v
is made orthogonal to all before, twice. V, a and B are as large as a row is long; the singular values and
right vectors of B, a small matrix, give deviations and components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed
from ._vectors import is_vector, matrices

#: Deviations below this share of the total count as none.
LEAST = 1e-7
#: Entries are held within this distance of zero.
MOST = float(1 << 40)
#: Rows of a packed batch.
PACKED = 1024


def _whole(x: np.ndarray, scale: float, shift: int) -> np.ndarray:
    return np.clip(np.floor(scale * x), -MOST, MOST).astype(np.int64) + shift


class _Centred:
    """Rows less their mean: whole numbers less the mean's whole part, and what is left of it."""

    def __init__(self, sums: list[int], n: int):
        self.n, self.rest = n, [s % n for s in sums]
        self.base = np.array([s // n for s in sums], np.int64)
        self.part = np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base).astype(float) - self.part

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of squares of n * x - S for each row, exact; None where it is beyond 64 bits."""
        y, n = x - self.base, self.n
        if np.abs(y).max(initial=0) < 1 << 24 and y.shape[1] < 1 << 12 and n < 1 << 50:
            rest = np.array(self.rest, np.int64)
            high, low = y @ (rest >> 26), y @ (rest & (1 << 26) - 1)
            squares, last = (y * y).sum(1), sum(r * r for r in self.rest)
            out = [n * n * a - 2 * n * ((b << 26) + c) + last for a, b, c in zip(squares.tolist(), high.tolist(), low.tolist(), strict=True)]
        else:
            out = [sum((n * a - r) ** 2 for a, r in zip(row, self.rest, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def _summed(packed: DataFrame, d: int, what: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of what(batch of rows), an array of any shape: each task adds up its own, Spark those of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("x"):
                part = what(np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            flat = np.ravel(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat.astype(float))], ["at", "value"])

    got = packed.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["at"]] = r["value"]
    return out


def _orthogonal(w: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in to:
            w = w - v * (v @ w)
    return w


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], d: int, total: float, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """V and B of X V = U B after all d steps. product(a) is the product of X transposed with X a; total the sum of squares of X.

    Where the products die out, as with repeated deviations or fewer independent rows than columns, a new direction starts.
    """
    rng = np.random.default_rng(seed)
    small = LEAST * np.sqrt(total)
    vs: list[np.ndarray] = []
    us: list[tuple[np.ndarray, np.ndarray]] = []  # a of each column u = X a, and the product of X transposed with u
    b = np.zeros((d, d))
    beta, v = 0.0, None
    for k in range(d):
        if v is None:
            v = _orthogonal(rng.standard_normal(d), vs)
            v = v / np.linalg.norm(v)
        a = v - beta * us[-1][0] if k and beta else v
        g = product(a)
        for _ in range(2):
            for a0, g0 in us:
                c = a0 @ g
                a, g = a - c * a0, g - c * g0
        alpha = np.sqrt(max(a @ g, 0.0))
        alive = alpha > small
        us.append((a / alpha, g / alpha) if alive else (np.zeros(d), np.zeros(d)))
        vs.append(v)
        b[k, k] = alpha if alive else 0.0
        if k + 1 < d:
            w = _orthogonal(us[-1][1] - b[k, k] * v, vs)
            beta = float(np.linalg.norm(w))
            beta, v = (beta, w / beta) if beta > small else (0.0, None)
            b[k, k + 1] = beta
    return np.array(vs).T, b


def whitened(rows: DataFrame, components: int = 32, scale: float = 64, shift: int = 1_000_000, embedding: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Each vector on the components of all vectors, at unit deviation.

    Entries c become whole numbers x = floor(scale * c) + shift; floor(scale * c) stays within 2**40 of zero. Vectors that are null or empty, or hold null, NaN
    or infinite entries, go, and so do those that are not as long as most are (ties: longer). Returns for each vector left one row with the array
    of its components: key, n, deviation (sum of squares of n * x - S, null beyond 64 bits), whitened (projections of x - S / n over
    the components' deviations, by falling deviation), explained (each component's share of the variance) and identity_error (largest entry of the
    covariance of whitened less the identity). Components of no deviation (LEAST) are left out: equal vectors, or
    one alone, have none and arrays are empty. Rows that repeat count again; an empty table gives no rows; other
    columns are not read.
    """
    spark = rows.sparkSession
    good = rows.select(F.col(key).alias("vec_id"), F.col(embedding).alias("embedding")).filter(is_vector(F.col("embedding")))
    most = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"vec_id {good.schema['vec_id'].dataType.simpleString()}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if most is None:
        return spark.createDataFrame([], schema)
    d, n = most["d"], most["count"]
    good = good.filter(F.size("embedding") == d)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in matrices(batches, "embedding", PACKED * d):
            yield pa.RecordBatch.from_arrays([pa.array([_whole(x, scale, shift).tobytes()], pa.binary())], ["x"])

    packed = checkpointed(good.select("embedding").mapInArrow(pack, "x binary"))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * d
        for batch in batches:
            for raw in batch.column("x"):
                part = np.frombuffer(raw.as_buffer(), np.int64).reshape(-1, d).sum(0)
                total = [a + b for a, b in zip(total, part.tolist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"at": list(range(d)), "value": [str(x) for x in total]})

    sums = packed.mapInArrow(added, "at long, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")).orderBy("at").collect()
    mean = _Centred([int(r["value"]) for r in sums], n)

    total = float(_summed(packed, d, lambda x: np.array([(mean.rows(x) ** 2).sum()]))[0])
    keep, e = np.zeros((d, 0)), np.zeros(0)
    if total > 0:

        def product(a: np.ndarray) -> np.ndarray:
            return _summed(packed, d, lambda x: (xc := mean.rows(x)).T @ (xc @ a))

        v, b = bidiagonalise(product, d, total)
        _, sigma, right = np.linalg.svd(b)
        m = min(components, int((sigma > LEAST * np.sqrt(total)).sum()))
        e = sigma[:m] ** 2 / n
        keep = (v @ right[:m].T) / np.sqrt(e)
    m, error = len(e), 0.0
    if m:
        middle = _summed(packed, d, lambda x: (mean.rows(x) @ keep).sum(0)) / n
        cov = _summed(packed, d, lambda x: (z := mean.rows(x) @ keep - middle).T @ z).reshape(m, m) / n
        error = float(np.abs(cov - np.eye(m)).max())

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, "embedding"):
            x = _whole(x, scale, shift)
            z = mean.rows(x) @ keep
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * m, pa.int32()), pa.array(z.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(mean.deviation(x), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    told = good.mapInArrow(out, f"vec_id {good.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")
    shares = F.array(*(F.lit(float(x)) for x in e * n / total)) if m else F.array().cast("array<double>")
    return told.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
