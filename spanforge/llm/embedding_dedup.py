"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosines, connected components.

1. Equal vectors make one node. A node's signature is the signs of its products with a pool of random planes; a table's key is some of
these bits. The number of bits follows the number of nodes, and that of tables the bits, so that two vectors at the
cosine asked for miss each other in all tables with probability MISSED.
2. Rows of a bucket compare signatures; a pair counts in the first table that has both in one bucket. Only rows with a
close signature in their bucket fetch their vectors, and cosines are computed in double precision.
3. Tasks return for each row how many it links with, and one link into each group that hangs together: no pair becomes a row.
4. Hot buckets are cut into blocks that meet pairwise. Where much of a bucket lies within half the angle of one direction (a ball), all of
that links by the triangle inequality: its links are counted without comparing it with itself.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import checkpointed, free_name, with_place
from ._text import groups, mix
from ._vectors import is_vector, matrices
from .graph import components

#: Bits of a signature, a multiple of 64.
POOL = 256
#: Rows that a bucket holds by chance.
BY_CHANCE = 64
#: Probability that all tables miss a pair at the cosine asked for.
MISSED = 0.001
#: Standard deviations of a signature's distance by which a pair may be off.
SLACK = 5.5
#: Rows of a block; two blocks are compared in one place.
BLOCK = 1024
#: Rows of a bucket from which balls are looked for, in the first tables; rows looked at; most balls. What no ball holds is compared.
HOT, BALL_TABLES, LOOKED_AT, BALLS = 8192, 4, 256, 2048
#: Hot buckets up to which their list is broadcast; beyond it they are joined by shuffle.
BROADCAST_BUCKETS = 50_000

#: Two tables, or lengths of vectors, whose keys are equal by chance stay apart.
BUCKET = ["key", "t", "d", "i", "j"]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; rows of zeros stay."""
    most = np.abs(x).max(1, keepdims=True, initial=0)
    x = x / np.where(most > 0, most, 1)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    planes: dict[int, np.ndarray] = {}
    for batch, x in matrices(batches, "embedding"):
        d = x.shape[1]
        if d not in planes:
            planes[d] = np.random.default_rng([13, d]).standard_normal((d, POOL))
        raw = x + 0.0  # one zero
        digest = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() if r.any() else None for r in raw]
        sign = np.packbits(unit(x) @ planes[d] > 0, axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), pa.array(digest, pa.binary()), pa.array([d] * len(x), pa.int32()), pa.array([s.tobytes() for s in sign], pa.binary())], ["uid", "id", "digest", "d", "sign"])


def tables_for(nodes: int, cosine: float) -> np.ndarray:
    """The bits of the pool that make each table's key: a row for each table."""
    bits = min(48, max(6, math.ceil(math.log2(max(nodes, 1) / BY_CHANCE)))) if nodes > BY_CHANCE else 6
    agree = 1 - math.acos(min(1.0, cosine)) / math.pi
    count = max(1, math.ceil(math.log(MISSED) / math.log1p(-min(agree**bits, 1 - 1e-9))))
    rng = np.random.default_rng(bits)
    each = POOL // bits
    pool = np.concatenate([rng.permutation(POOL)[: each * bits].reshape(each, bits) for _ in range(-(-count // each))])
    return pool[:count]


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, POOL // 8)


def _masks(tables: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(tables), POOL), bool)
    np.put_along_axis(bits, tables, True, axis=1)
    return np.packbits(bits, axis=1).view(np.uint64)


def _keyed(tables: np.ndarray):
    """A row for each table with the node's key there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(tables.shape[1], dtype=np.uint64)
        for big in batches:
            for k in range(0, big.num_rows, 2048):
                batch = big.slice(k, 2048)
                bits = np.unpackbits(_signs(batch.column("sign")), axis=1).astype(np.uint64)
                d = batch.column("d").to_numpy().astype(np.uint64)
                for t, chosen in enumerate(tables):
                    key = mix(mix((bits[:, chosen] * weights).sum(1)) ^ mix(d * np.uint64(1 << 16) + np.uint64(t)))
                    yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("ball"), batch.column("sign"), batch.column("d"), pa.array([t] * batch.num_rows, pa.int32()), pa.array(key.view(np.int64))], ["uid", "ball", "sign", "d", "t", "key"])

    return run


def _middle(cosine: float):
    """The direction in which most of the rows looked at lie, and how many of them its ball holds."""

    def run(table: pa.Table) -> pa.Table:
        found: dict[str, list] = {"share": [], "d": [], "pivot": []}
        for _, x in matrices(iter(table.combine_chunks().to_batches()), "embedding", 1 << 22):
            x = unit(x)
            near = x @ x.T >= cosine
            pivot = unit(x[near[np.argmax(near.sum(1))]].mean(0, keepdims=True))
            held = int((x @ pivot[0] >= math.sqrt((1 + cosine) / 2)).sum())
            if held * 8 >= len(x):
                found["share"].append(held / len(x))
                found["d"].append(x.shape[1])
                found["pivot"].append(pivot[0].tolist())
        return pa.Table.from_pydict(found, pa.schema([("share", pa.float64()), ("d", pa.int32()), ("pivot", pa.list_(pa.float64()))]))

    return run


def _balls(nodes: DataFrame, member: DataFrame, vectors: DataFrame, cosine: float, hot: int) -> DataFrame | None:
    """(uid, ball) of the nodes within half the angle of a direction around which a hot bucket lies."""
    sizes = member.filter(F.col("t") < BALL_TABLES).groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > hot).orderBy(F.desc("size"), "key").limit(BALLS)
    sizes = checkpointed(sizes)
    if sizes.isEmpty():
        return None
    # At most BALLS buckets, of each about LOOKED_AT rows.
    seen = member.join(F.broadcast(sizes), "key").filter(F.pmod(F.xxhash64("uid", "key"), "size") < LOOKED_AT).select("uid", "key", "size")
    pivots = seen.join(vectors, "uid").groupBy("key", "size").applyInArrow(_middle(cosine), "share double, d int, pivot array<double>").orderBy(F.desc("share")).collect()
    chosen: dict[int, list[np.ndarray]] = {}
    for p in pivots:
        there = chosen.setdefault(p["d"], [])
        if all(float(q @ p["pivot"]) < 0.995 for q in there):
            there.append(np.array(p["pivot"]))
    if not chosen:
        return None
    stacks = {d: np.array(p) for d, p in chosen.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, "embedding"):
            if (d := x.shape[1]) in stacks:
                close = unit(x) @ stacks[d].T
                best = close.argmax(1)
                inside = close[np.arange(len(x)), best] >= math.sqrt((1 + cosine) / 2) + 1e-9
                ball = d * BALLS + best[inside] + 1
                yield pa.RecordBatch.from_arrays([batch.column("uid").filter(pa.array(inside)), pa.array(ball.astype(np.int64))], ["uid", "ball"])

    return vectors.join(nodes.select("uid"), "uid", "left_semi").mapInArrow(run, "uid long, ball long")


def _blocks(member: DataFrame, block: int) -> DataFrame:
    """Adds the row's block in its bucket and the pair (i, j) of blocks that meet; a row for each such pair.

    Blocks hold rows of one ball, and blocks of one ball do not meet.
    """
    counts = member.groupBy("key", "ball").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("size"), F.array_sort(F.collect_list(F.struct("ball", F.ceil(F.col("n") / block).alias("parts")))).alias("of"))
    big = counts.filter(F.col("size") > block)
    before = lambda k: F.aggregate(F.slice("of", F.lit(1), k), F.lit(0).cast("long"), lambda n, x: n + x["parts"])
    big = checkpointed(big.select("key", F.transform("of", lambda x, k: F.struct(x["ball"].alias("ball"), x["parts"].alias("parts"), before(k).alias("at"))).alias("of")))
    few = big.count() <= BROADCAST_BUCKETS
    rows = member.join(F.broadcast(big) if few else big, "key", "left")
    own = F.filter("of", lambda x: x["ball"] == F.col("ball"))[0]
    others = F.flatten(F.transform("of", lambda x: F.when((x["ball"] == F.col("ball")) & (F.col("ball") != 0), F.array().cast("array<bigint>")).otherwise(F.sequence(x["at"], x["at"] + x["parts"] - 1))))
    zero = F.lit(0).cast("long")
    rows = rows.withColumn("block", F.coalesce(own["at"] + F.pmod(F.xxhash64("uid"), own["parts"]), zero)).withColumn("other", F.explode(F.coalesce(others, F.array(zero))))
    return rows.select("uid", "ball", "sign", "d", "t", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _close(sign: np.ndarray, ball: np.ndarray, left: np.ndarray, right: np.ndarray, masks: np.ndarray, t: int, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the two blocks with close signatures that no earlier table has in one bucket."""
    own = left is right
    for k in range(0, len(left), 64):
        x = left[k : k + 64]
        off = np.bitwise_count(sign[x][:, None, :] ^ sign[right][None]).sum(2, dtype=np.int32)
        near = (off <= most) & ((ball[x][:, None] != ball[right][None]) | (ball[x][:, None] == 0))
        if own:
            near &= x[:, None] < right[None]
        a, b = np.nonzero(near)
        a, b = x[a], right[b]
        for mask in masks[:t]:
            if not len(a):
                break
            new = ((sign[a] ^ sign[b]) & mask).any(1)
            a, b = a[new], b[new]
        if len(a):
            yield a, b


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that hangs together with each of n rows by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(tables: np.ndarray, cosine: float, exact: bool):
    """Over blocks that come together: rows with a close signature, or if exact what their vectors link with."""
    off = math.acos(cosine) / math.pi
    most = POOL * off + SLACK * math.sqrt(POOL * off * (1 - off))

    def block(parts: list[pa.RecordBatch], masks: np.ndarray) -> pa.RecordBatch | None:
        part = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        uid, ball, at = (part.column(c).to_numpy() for c in ("uid", "ball", "block"))
        i, j, t = (part.column(c)[0].as_py() for c in ("i", "j", "t"))
        if len(uid) < 2:
            return None
        sign = _signs(part.column("sign")).view(np.uint64)
        left = np.flatnonzero(at == i)
        right = left if i == j else np.flatnonzero(at == j)
        if exact:
            x = unit(next(matrices(iter([part]), "embedding", 1 << 30))[1])
            m = part.column("m").to_numpy()
        found = []
        for a, b in _close(sign, ball, left, right, masks, t, most):
            if exact:
                linked = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                a, b = a[linked], b[linked]
            found.append(np.stack([a, b]).astype(np.int32))
        if not found or not (links := np.concatenate(found, axis=1)).size:
            return None
        a, b = links
        if not exact:
            return part.take(pa.array(np.unique(links))).select(["uid", "ball", "sign", "d", "t", "key", "block", "i", "j"])
        n = np.bincount(a, m[b], len(uid)) + np.bincount(b, m[a], len(uid))
        rows = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(uid[rows]), pa.array(n[rows].astype(np.int64)), pa.array(uid[_joined(len(uid), a, b)[rows]])], ["uid", "n", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, parts = _masks(tables), []
        for _, batch, new in groups(batches, BUCKET):
            if new and parts:
                if (out := block(parts, masks)) is not None:
                    yield out
                parts = []
            parts.append(batch)
        if parts and (out := block(parts, masks)) is not None:
            yield out

    return run


MEMBER = "uid long, ball long, sign binary, d int, t int, key long, block long, i long, j long"


def embedding_duplicates(rows: DataFrame, cosine: float = 0.9, embedding: str = "embedding", key: str = "vec_id", block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """Vectors linked by a cosine of at least `cosine`, in double precision.

    Returns for each row key, uid (the row's place in the files), n_links (other rows linked directly), component_id (the smallest key that links lead
    to, its own included; null last) and kept: one row of a component, that with the smallest key, of rows that tie the first by place.
    Vectors that are null, empty or zero or hold null, NaN or infinite entries link with nothing; vectors of different lengths don't
    link. Rows that repeat link with each other. An empty table gives no rows; other columns are not read.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    place = free_name(rows, "place")
    rows = with_place(rows, place).select(F.col(place).alias("uid"), F.col(key).alias("id"), F.col(embedding).alias("embedding"))
    kind = rows.schema["id"].dataType.simpleString()
    good = rows.filter(is_vector(F.col("embedding")))
    signed = checkpointed(good.mapInArrow(_signed, f"uid long, id {kind}, digest binary, d int, sign binary"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first")
    same = checkpointed(signed.filter("digest is not null").groupBy("digest", "d").agg(F.min("uid").alias("node"), first, F.count("*").alias("m")))
    nodes = checkpointed(signed.select("uid", "d", "sign").join(same.select(F.col("node").alias("uid"), "m"), "uid"))
    vectors = good.select("uid", "embedding")

    tables = tables_for(nodes.count(), cosine)
    none = F.lit(0).cast("long").alias("ball")
    keyed = lambda rows: rows.mapInArrow(_keyed(tables), "uid long, ball long, sign binary, d int, t int, key long")
    balls = _balls(nodes, keyed(nodes.select("uid", none, "sign", "d")), vectors, cosine, hot)
    if balls is None:
        nodes = nodes.select("*", none)
    else:
        nodes = checkpointed(nodes.join(balls, "uid", "left").select("uid", "d", "sign", "m", F.coalesce("ball", F.lit(0).cast("long")).alias("ball")))

    dealt = lambda rows: rows.repartition("key", "i", "j").sortWithinPartitions(*BUCKET, "uid")
    member = keyed(nodes.select("uid", "ball", "sign", "d"))
    near = checkpointed(dealt(_blocks(member, block)).mapInArrow(_compared(tables, cosine, False), MEMBER))
    fetched = near.join(nodes.select("uid", "m"), "uid").join(vectors, "uid")
    found = checkpointed(dealt(fetched).mapInArrow(_compared(tables, cosine, True), "uid long, n long, to long"))
    links = found.filter("uid <> to").select(F.col("uid").alias("a"), F.col("to").alias("b"))

    counted = nodes.join(found.groupBy("uid").agg(F.sum("n").alias("n")), "uid", "left").select("uid", "ball", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n"), "m")
    if balls is not None:
        held = checkpointed(nodes.filter("ball <> 0").groupBy("ball").agg(F.sum("m").alias("held"), F.min("uid").alias("to")))
        counted = counted.join(F.broadcast(held), "ball", "left")  # at most BALLS for each length of vectors
        links = links.unionAll(counted.filter("uid <> to").select(F.col("uid").alias("a"), F.col("to").alias("b")))
        counted = counted.withColumn("n", F.col("n") + F.coalesce(F.col("held") - F.col("m"), F.lit(0)))
    label = components(links)

    # Joined by two columns, which deals both sides anew, so that Spark can split a hot component or copy.
    known = same.join(counted.select(F.col("uid").alias("node"), "n"), "node").join(label, "node", "left").select("digest", "d", "first", "n", F.coalesce("label", "node").alias("label"))
    odd = F.pmod("label", F.lit(2)).alias("parity")
    classes = known.groupBy("label").agg(F.min("first").alias("keep")).select("*", odd)
    known = known.select("*", odd).join(classes, ["label", "parity"]).select("digest", "d", "n", "keep")
    linked = signed.select("uid", "id", "digest", "d").join(known, ["digest", "d"]).select("uid", "id", "n", F.col("keep.id").alias("component_id"), (F.col("keep.uid") == F.col("uid")).alias("kept"))
    alone = signed.filter("digest is null").select("uid", "id").unionAll(rows.filter(~is_vector(F.col("embedding"))).select("uid", "id"))
    out = linked.unionAll(alone.select("uid", "id", F.lit(0).cast("long"), "id", F.lit(True)))
    return out.select(F.col("id").alias(key), "uid", F.col("n").alias("n_links"), "component_id", "kept")
