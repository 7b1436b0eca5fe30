"""Centroid clustering with Drake's adaptive bounds, in whole numbers.

A vector keeps its nearest centroid with an upper bound of the distance, the next nearest ones in order with a lower bound
each, and one remainder bound for all others.  When centroids move, bounds are widened by how far; a vector whose upper bound
is strictly below all lower ones keeps its centroid unseen.  Otherwise its own distance is computed anew, and then those of
as many of its next ones as come before the first bound that certifies the rest; only if none does are all centroids looked
at.  Bounds are floating-point numbers rounded outwards, while every comparison that they can't decide is one of exact whole
numbers, so ties go to the smaller number and results are those of comparing everything.  How many bounds are kept adapts:
a round that needed fewer has the next one keep fewer.

Vectors stay where they are: a round reads their table, and writes them with new bounds beside the sums of each task, which
Spark adds up.  What the driver holds are the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import new_path
from .common import gathered, small_batches, tidied

DIMS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Components beyond this, either way, are taken as this, so that sums of 10^10 of them fit 38 digits.
MOST = 10**27
_MOST_LONG = 2**63 - 1
#: Lower bounds that a vector starts with: a quarter of the centroids, and so many at least; later an eighth at least.
FEWEST = 3
#: Bounds are rounded outwards by more than the errors of the few operations behind them.
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12
_BATCH_BYTES = 4_000_000
_STATE = "vec_id long, v binary, near binary, bounds binary, part int, n long, sums array<decimal(38,0)>, deep int, looked long"


def usable(embedding: Column, dims: int = DIMS) -> Column:
    """Whether a vector has so many components, none of them null or non-finite."""
    return embedding.isNotNull() & (F.size(embedding) == dims) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component, as whole numbers of Python where they are wide."""
    low = np.floor(np.clip(values.astype("f8"), -MOST, MOST) * scale)
    if not len(low) or np.abs(low).max() < 2**31:
        return low.astype("i8")
    return np.array([[max(-MOST, min(MOST, int(x))) for x in row] for row in low], object)


def encoded(values: np.ndarray) -> list[bytes]:
    """Rows as little-endian numbers of four bytes, or of sixteen where one of a row's needs them."""
    if values.dtype != object:
        raw = values.astype("<i4").tobytes()
        width = 4 * values.shape[1]
        return [raw[i : i + width] for i in range(0, len(raw), width)]
    wide = [any(not -(2**31) <= x < 2**31 for x in row) for row in values]
    return [b"".join(x.to_bytes(16 if w else 4, "little", signed=True) for x in row) for row, w in zip(values.tolist(), wide, strict=True)]


def decoded(column: pa.Array, dims: int) -> np.ndarray:
    """The rows as 64-bit numbers, or as numbers of Python if one is wide."""
    if not len(column):
        return np.zeros((0, dims), "i8")
    if pc.max(pc.binary_length(column)).as_py() == 4 * dims:
        return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype("i8")
    rows = column.to_pylist()
    step = [len(r) // dims for r in rows]
    return np.array([[int.from_bytes(r[i : i + w], "little", signed=True) for i in range(0, len(r), w)] for r, w in zip(rows, step, strict=True)], object)


class Distances:
    """Exact squared distances of the rows of ``x`` from the centroids: whole numbers, in double precision where that holds them."""

    def __init__(self, x: np.ndarray, centroids: list[list[int]]):
        c = np.array(centroids, object).reshape(len(centroids), -1)
        dims = max(1, c.shape[1])
        most = max((abs(int(v)) for v in (c.min(initial=0), c.max(initial=0), x.min(initial=0), x.max(initial=0))), default=0)
        kind = "f8" if dims * (2 * most) ** 2 <= 2**53 else object
        self.x, self.c = x.astype(kind), c.astype(kind)
        self.xx, self.cc = (self.x * self.x).sum(axis=1), (self.c * self.c).sum(axis=1)
        self.looked = 0

    def all(self, rows: np.ndarray) -> np.ndarray:
        self.looked += len(rows) * len(self.c)
        return self.xx[rows][:, None] + self.cc[None, :] - 2 * (self.x[rows] @ self.c.T)

    def some(self, rows: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of each of ``rows`` from the centroids in its row of ``of``."""
        self.looked += of.size
        columns = [self.xx[rows] + self.cc[k] - 2 * (self.x[rows] * self.c[k]).sum(axis=1) for k in of.T]
        return np.stack(columns, axis=1)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype("f8"))


@dataclass
class Bounds:
    """Of each vector: ``near``, its centroid and the next ones in order; ``upper``, ``lower`` of those, ``rest`` of all others."""

    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    rest: np.ndarray

    @classmethod
    def read(cls, near: pa.Array, bounds: pa.Array, kept: int) -> Bounds:
        order = np.frombuffer(b"".join(near.to_pylist()), "<u2").reshape(-1, kept + 1).astype("i8")
        numbers = np.frombuffer(b"".join(bounds.to_pylist()), "<f8").reshape(-1, kept + 2)
        return cls(order, numbers[:, 0].copy(), numbers[:, 1:-1].copy(), numbers[:, -1].copy())

    def written(self) -> tuple[list[bytes], list[bytes]]:
        near = self.near.astype("<u2").tobytes()
        numbers = np.concatenate([self.upper[:, None], self.lower, self.rest[:, None]], axis=1).astype("<f8").tobytes()
        a, b = 2 * self.near.shape[1], 8 * (self.lower.shape[1] + 2)
        return [near[i : i + a] for i in range(0, len(near), a)], [numbers[i : i + b] for i in range(0, len(numbers), b)]

    def fewer(self, kept: int) -> None:
        """Keep so many lower bounds; the remainder's takes in the others."""
        if kept < self.lower.shape[1]:
            self.rest = np.minimum(self.rest, self.lower[:, kept:].min(axis=1))
            self.near, self.lower = self.near[:, : kept + 1], self.lower[:, :kept]


def scanned(distances: Distances, rows: np.ndarray, kept: int) -> Bounds:
    """Bounds of ``rows`` from their distances to all centroids."""
    squares = distances.all(rows)
    order = np.argsort(squares, axis=1, kind="stable")
    roots = _root(np.take_along_axis(squares, order[:, : kept + 2], axis=1))
    rest = roots[:, kept + 1] * _DOWN if order.shape[1] > kept + 1 else np.full(len(rows), np.inf)
    return Bounds(order[:, : kept + 1], roots[:, 0] * _UP, roots[:, 1 : kept + 1] * _DOWN, rest)


def moved(bounds: Bounds, distances: Distances, shifts: np.ndarray, kept: int) -> int:
    """Bring ``bounds`` up to date with centroids that moved by at most ``shifts``; how many lower bounds were needed at most."""
    bounds.fewer(kept)
    if not len(bounds.near):
        return 0
    furthest = shifts.max()
    bounds.upper = (bounds.upper + shifts[bounds.near[:, 0]]) * _UP
    bounds.lower = bounds.lower - shifts[bounds.near[:, 1:]]
    bounds.lower -= np.abs(bounds.lower) * (1 - _DOWN) + shifts[bounds.near[:, 1:]] * (1 - _DOWN)
    with np.errstate(invalid="ignore"):
        bounds.rest = np.where(np.isinf(bounds.rest), np.inf, bounds.rest - furthest - (np.abs(bounds.rest) + furthest) * (1 - _DOWN))
    # What holds for the z-th next centroid and all after it.
    holds = np.minimum.accumulate(np.concatenate([bounds.lower, bounds.rest[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
    rows = np.flatnonzero(bounds.upper >= holds[:, 0])
    own = distances.some(rows, bounds.near[rows, :1])
    bounds.upper[rows] = _root(own[:, 0]) * _UP
    still = bounds.upper[rows] >= holds[rows, 0]
    rows, own = rows[still], own[still]
    needed = (holds[rows] <= bounds.upper[rows][:, None]).sum(axis=1)
    for z in np.unique(needed[needed <= kept]).tolist():
        here = needed == z
        at = rows[here]
        names = bounds.near[at, : z + 1]
        squares = np.concatenate([own[here], distances.some(at, names[:, 1:])], axis=1)
        by_name = np.argsort(names, axis=1, kind="stable")
        names, squares = np.take_along_axis(names, by_name, axis=1), np.take_along_axis(squares, by_name, axis=1)
        order = np.argsort(squares, axis=1, kind="stable")
        roots = _root(np.take_along_axis(squares, order, axis=1))
        bounds.near[at, : z + 1] = np.take_along_axis(names, order, axis=1)
        bounds.upper[at], bounds.lower[at, :z] = roots[:, 0] * _UP, roots[:, 1:] * _DOWN
    at = rows[needed > kept]
    if len(at):
        new = scanned(distances, at, kept)
        bounds.near[at], bounds.upper[at], bounds.lower[at], bounds.rest[at] = new.near, new.upper, new.lower, new.rest
    return int(min(needed.max(initial=0), kept))


def prepared(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``, the whole numbers of each vector that is kept."""
    small_batches(vectors.sparkSession)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoded(whole(values, scale)), pa.binary())], ["vec_id", "v"])

    kept = vectors.where(usable(F.col("embedding"), dims)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return kept.mapInArrow(tidied(prepare), "vec_id long, v binary")


def first_centroids(rows: DataFrame, clusters: int = CLUSTERS, seed: int = SEED, dims: int = DIMS) -> list[list[int]]:
    """Those of least sha256 of ``seed:vec_id``; rows without vec_id come last, ties go by the numbers."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.orderBy(hashed.asc_nulls_last(), "v").limit(clusters).select("v").toArrow().column("v").combine_chunks()
    return [[int(x) for x in row] for row in decoded(got, dims)]


def _passed(rows: DataFrame, old: list[list[int]] | None, now: list[list[int]], had: int, kept: int, dims: int) -> DataFrame:
    """One round over ``rows``: vectors with new bounds, and of each task and cluster a row of sums."""
    sent = rows.sparkSession.sparkContext.broadcast((now, _shifts(old, now) if old else None))  # the centroids alone
    blank = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.int32(), pa.int64()]
    names = ["vec_id", "v", "near", "bounds", "part", "n", "sums", "deep", "looked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, shifts = sent.value
        counts, sums, deep, looked = [0] * len(centroids), [[0] * dims for _ in centroids], 0, 0
        for batch in gathered(batches, _BATCH_BYTES):
            column = batch.column("v")
            distances = Distances(decoded(column, dims), centroids)
            if shifts is None:
                bounds = scanned(distances, np.arange(len(column)), kept)
                deep = kept
            else:
                bounds = Bounds.read(batch.column("near"), batch.column("bounds"), had)
                deep = max(deep, moved(bounds, distances, shifts, kept))
            looked += distances.looked
            for k in np.unique(bounds.near[:, 0]).tolist():
                own = distances.x[bounds.near[:, 0] == k]
                counts[k] += len(own)
                sums[k] = [a + int(b) for a, b in zip(sums[k], own.sum(axis=0), strict=True)]
            near, numbers = bounds.written()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column, pa.array(near, pa.binary()), pa.array(numbers, pa.binary()), *(pa.nulls(len(column), t) for t in blank)], names)
        some = [k for k, n in enumerate(counts) if n]
        made = [some, [counts[k] for k in some], [[Decimal(x) for x in sums[k]] for k in some], [deep] * len(some), [looked if k == some[0] else 0 for k in some]]
        empty = [pa.nulls(len(some), t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, *(pa.array(x, t) for x, t in zip(made, blank, strict=True))], names)

    return rows.mapInArrow(tidied(run), _STATE)


def _shifts(old: list[list[int]], now: list[list[int]]) -> np.ndarray:
    squares = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(old, now, strict=True)]
    return np.sqrt(np.array(squares, "f8")) * _UP


class _Tables:
    """The table of the last round; earlier ones are deleted as soon as the next is whole."""

    def __init__(self, spark):
        self.spark, self.path = spark, None

    def next(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "cluster-round")
        df.write.parquet(path)
        old, self.path = self.path, path
        if old is not None:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return self.spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Clustered:
    """``rows``: vec_id, cluster, distance (squared, the largest long if it is larger); the centroids; distances computed in each round."""

    rows: DataFrame
    centroids: list[list[int]]
    looked: list[int]


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> Clustered:
    """Cluster the rows of ``vectors`` (vec_id, embedding) with exactly ``dims`` components, none null or non-finite.

    Other rows are left out.  Rows that repeat, or share a vec_id, are so many vectors; rows without vec_id are clustered like
    others, and start a centroid only if there are too few with one.  Fewer vectors than clusters make fewer clusters, an empty
    table an empty result.  Ties in distance go to the smaller cluster.  Whole numbers beyond MOST are taken as MOST.  Other
    columns aren't read, so names can't clash.  Once no centroid moves, further rounds would change nothing and aren't run.
    """
    if clusters >= 2**16:
        raise ValueError("cluster numbers have 16 bits")
    spark = vectors.sparkSession
    tables = _Tables(spark)
    rows = tables.next(prepared(vectors.select("vec_id", "embedding"), dims, scale))
    now, old, looked = first_centroids(rows, clusters, seed, dims), None, []
    kept = had = max(0, min(len(now) - 1, max(FEWEST, len(now) // 4)))
    done = 0
    while now:
        rows = tables.next(_passed(rows, old, now, had, kept, dims))
        had = kept
        parts = rows.where("part is not null").groupBy("part").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(d))).alias(f"s{d}") for d in range(dims)], F.max("deep").alias("deep"), F.sum("looked").alias("looked")).collect()  # a row a cluster
        looked.append(sum(r["looked"] for r in parts))
        rows = rows.where("part is null")
        if done == rounds:
            break
        new = {r["part"]: [int(r[f"s{d}"]) // r["n"] for d in range(dims)] for r in parts}
        old, now = now, [new.get(k, c) for k, c in enumerate(now)]
        done += 1
        if old == now:
            break
        kept = min(kept, max(1, len(now) // 8, *(r["deep"] for r in parts))) if len(now) > 1 else 0

    sent = spark.sparkContext.broadcast(now)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, _BATCH_BYTES):
            near = np.frombuffer(b"".join(batch.column("near").to_pylist()), "<u2").reshape(batch.num_rows, -1)[:, 0].astype("i8")
            exact = Distances(decoded(batch.column("v"), dims), sent.value).some(np.arange(len(near)), near[:, None])[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near, pa.int32()), pa.array([min(_MOST_LONG, int(x)) for x in exact], pa.int64())], ["vec_id", "cluster", "distance"])

    kinds = "vec_id long, cluster int, distance long"
    measured = rows.select("vec_id", "v", "near").mapInArrow(tidied(measure), kinds) if now else spark.createDataFrame([], kinds)
    return Clustered(tables.next(measured), now, looked)


def digest(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector; longs end at the largest there is."""
    found = cluster(vectors, **options)
    sums = {r["cluster"]: int(r["s"]) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    total = min(_MOST_LONG, sum(sums.values()))
    named = [(k, min(_MOST_LONG, s), total, hashlib.sha256(",".join(map(str, found.centroids[k])).encode()).hexdigest()) for k, s in sorted(sums.items())]
    of = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
