"""Embedding near-dedup by a pivot-permutation index.

Pivots are vectors of a bounded sample.  Each vector is described by its nearest pivots in order, and stands in the
inverted list of each of them.  Two vectors are candidates if they share enough of their nearest pivots, which the lists
count; they are compared in the list of the smallest pivot that they share, and verified by cosine in double precision.
A list that is larger than a part is divided by the second smallest pivot that two of its members share, where that leaves less
to compare, so that lists don't grow with the vectors while these lie apart.  Lists are compared in blocks of bounded size, and what leaves a block is a count for each vector and a spanning forest of
its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import PART, blocked, forest, local_components, streamed, tiles
from .common import small_batches, small_side, staged, tidied
from .graph import components

LEAST, NEAREST, SHARED, SEED = 0.93, 10, 4, 7
#: Pivots are less alike than this.
APART = 0.8
#: Vectors for each pivot, and the fewest and most pivots.  The most bounds the sample and what tasks are sent.
PER_PIVOT, FEWEST, MOST = 128, 64, 4096
#: Members of a list beyond which it is divided by second pivots.
DIVIDED = PART


def pivot_count(n: int) -> int:
    return min(MOST, max(FEWEST, 1 << max(0, math.ceil(math.log2(max(1, n / PER_PIVOT))))))


def nearest_count(pivots: int) -> int:
    """How many of so many pivots describe a vector: NEAREST, and more among many, whose order small changes turn about."""
    return NEAREST + 2 * max(0, math.ceil(math.log2(max(1, pivots) / FEWEST)) - 1)


def clean(vectors: DataFrame) -> DataFrame:
    """One row for each vec_id: vec_id, label, dims, v (null where the vector can't link).

    Of rows that share a vec_id the one with the smallest label and then embedding stands for all; vectors are moved for that
    only if some id repeats.
    """
    one = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    if not one.groupBy("vec_id").count().where("count > 1").isEmpty():
        one = one.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    v = F.col("v")
    fine = F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return one.select("vec_id", "label", F.size(v).alias("dims"), F.when(fine, v).alias("v"))


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = vectors.astype("f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(usable: DataFrame, n: int, seed: int = SEED, apart: float = APART) -> dict[int, np.ndarray]:
    """Pivots of each number of dimensions, from the 2 * pivot_count(n) vectors whose hashes are least.

    A vector nearer than ``apart`` to a pivot is no further one: pivots that lie together would be ordered at random by the
    vectors around them, which would then share few of their nearest.
    """
    most = pivot_count(n)
    rows = usable.select("dims", "v", F.xxhash64("vec_id", F.lit(seed)).alias("h"), "vec_id").orderBy("h", "vec_id").limit(2 * most).select("dims", "v").toArrow()
    found: dict[int, np.ndarray] = {}
    dims = rows.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        sample = units(_rows_of(rows.column("v").filter(pa.array(dims == d)), d))
        chosen = np.empty((0, d))
        for x in sample:
            if len(chosen) < most and not (chosen @ x >= apart).any():
                chosen = np.vstack([chosen, x])
        found[d] = chosen
    return found


def _rows_of(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy().reshape(-1, width)


def described(usable: DataFrame, pivots: dict[int, np.ndarray], nearest: int | None = None) -> DataFrame:
    """vec_id, label, dims and ``pivots``, the ``nearest`` ones in order, or as many as nearest_count gives.  Where there are none of their dimensions: [-1]."""
    small_batches(usable.sparkSession)
    sent = usable.sparkSession.sparkContext.broadcast(pivots)  # at most MOST vectors

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            out: list[list[int]] = [[-1]] * len(dims)
            for d in np.unique(dims).tolist():
                if (known := sent.value.get(d)) is None:
                    continue
                at = np.flatnonzero(dims == d)
                x = units(_rows_of(batch.column("v").take(pa.array(at)), d))
                order = np.argsort(-(x @ known.T), axis=1, kind="stable")[:, : nearest or nearest_count(len(known))]
                for k, row in zip(at.tolist(), order.tolist(), strict=True):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _DESCRIBED), pa.array(out, pa.list_(pa.int32()))], [*_DESCRIBED, "pivots"])

    kept = usable.select(*_DESCRIBED).schema.fields
    return usable.mapInArrow(tidied(describe), T.StructType([*kept, T.StructField("pivots", T.ArrayType(T.IntegerType()))]))


_DESCRIBED = ["vec_id", "label", "dims"]
_LIST = ["label", "dims", "pivot", "second"]
_BLOCK = [*_LIST, "lo", "hi"]


def _candidates(table: pa.Table, starts: np.ndarray, shared: int) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Ranges of rows of a block and which two share enough pivots, the block's being the smallest one or two of them."""
    parts, lo, hi, pivot, second = (table.column(c).to_numpy() for c in ("part", "lo", "hi", "pivot", "second"))
    pivots = table.column("pivots").combine_chunks()

    def held(rows: slice, known: np.ndarray) -> np.ndarray:
        own = lists[rows.start - at : rows.stop - at]
        out = np.zeros((len(own), len(known)), "f4")
        out[np.arange(len(own))[:, None], np.searchsorted(known, own)] = 1
        return out

    at, lists, local = -1, np.empty((0, 0)), np.empty(0)
    for i, j in tiles(starts, parts, lo, hi, over=1):
        block = int(np.searchsorted(starts, i.start, side="right")) - 1
        if at != starts[block]:
            at, end = int(starts[block]), int(starts[block + 1])
            lists = pivots[at:end].flatten().to_numpy().reshape(end - at, -1)
            local = np.unique(lists)
        x = held(i, local)
        y = x if i == j else held(j, local)
        before = int(np.searchsorted(local, max(pivot[at], second[at])))
        smaller = 0 if second[at] < 0 else 1  # shared ones before the block's last
        close = (x @ y.T >= min(shared, lists.shape[1])) & (x[:, :before] @ y[:, :before].T == smaller)
        yield i, j, np.triu(close, 1) if i == j else close


def inverted(indexed: DataFrame, shared: int = SHARED) -> DataFrame:
    """The inverted lists of ``indexed`` (vec_id, label, dims, pivots): its columns with ``pivot`` and ``second``, -1 or the second
    pivot by which a large list is divided."""
    # Two that share so many of their pivots share one of the first of them in order of number, all but shared - 1.
    needed = F.least(F.lit(shared), F.size("pivots"))
    first = F.slice(F.array_sort("pivots"), F.lit(1), F.size("pivots") - needed + 1)
    lists = indexed.select("label", "dims", F.explode(first).alias("pivot"), "vec_id", "pivots")
    counts = lists.groupBy("label", "dims", "pivot").agg(F.count("*").alias("n")).where(F.col("n") > DIVIDED)
    counts = staged(counts, "large-lists")
    whole = lists.withColumn("second", F.lit(-1))
    if counts.isEmpty():
        return whole
    later = F.array_sort(F.filter("pivots", lambda p: p > F.col("pivot")))
    large = lists.join(small_side(counts.drop("n")), ["label", "dims", "pivot"]).where(needed > 1)
    divided = large.withColumn("later", later).select(*lists.columns, F.explode(F.slice("later", F.lit(1), F.greatest(F.lit(0), F.size("later") - needed + 2))).alias("second"))
    work = divided.groupBy("label", "dims", "pivot", "second").agg(F.count("*").cast("double").alias("n")).groupBy("label", "dims", "pivot").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
    better = counts.join(work, ["label", "dims", "pivot"]).where(F.col("work") < F.col("n").cast("double") * F.col("n") / 2).select("label", "dims", "pivot")
    better = small_side(staged(better, "divided-lists"))
    return whole.join(better, ["label", "dims", "pivot"], "left_anti").unionByName(divided.join(better, ["label", "dims", "pivot"]).select(*whole.columns))


def _needed(members: DataFrame, shared: int) -> DataFrame:
    """The members that have something to be compared with in their block, from the lists of pivots alone."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in streamed(batches, _BLOCK):
            used = np.zeros(len(table), bool)
            for i, j, close in _candidates(table, starts, shared):
                used[i] |= close.any(axis=1)
                used[j] |= close.any(axis=0)
            yield from table.filter(pa.array(used)).combine_chunks().to_batches(max_chunksize=10_000)

    return members.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "part").mapInArrow(tidied(pick), members.schema)


def _compared(members: DataFrame, least: float, shared: int) -> DataFrame:
    """vec_id, links (in one block), root (a vec_id for all that are joined there)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in streamed(batches, _BLOCK):
            names, dims, vectors = table.column("vec_id").to_numpy(), table.column("dims").to_numpy(), table.column("v").combine_chunks()
            links, from_, to = np.zeros(len(table), "i8"), [np.empty(0, "i8")], [np.empty(0, "i8")]
            for i, j, close in _candidates(table, starts, shared):
                if not close.any():
                    continue
                x = units(_rows_of(vectors[i.start : i.stop], dims[i.start]))
                y = x if i == j else units(_rows_of(vectors[j.start : j.stop], dims[j.start]))
                linked = close & (x @ y.T >= least)
                links[i] += linked.sum(axis=1)
                links[j] += linked.sum(axis=0)
                a, b = np.nonzero(linked)
                a, b = forest(len(x) + len(y), a, b if i == j else b + len(x))
                from_.append(np.where(a < len(x), a + i.start, a - len(x) + j.start))
                to.append(np.where(b < len(x), b + i.start, b - len(x) + j.start))
            roots = local_components(len(table), np.concatenate(from_), np.concatenate(to))
            kept = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(names[kept]), pa.array(links[kept]), pa.array(names[roots[kept]])], ["vec_id", "links", "root"])

    return members.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "part").mapInArrow(tidied(compare), "vec_id long, links long, root long")


def deduplicate(vectors: DataFrame, least: float = LEAST, nearest: int | None = None, shared: int = SHARED) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors are compared where labels are equal and not null.  Vectors that are null, zero, or hold null or non-finite
    components link with nothing, nor do vectors of different lengths with each other; a vector may be of any length.  Rows
    without vec_id are returned each by itself, linked with nothing, component_id null and kept.  Rows that share a vec_id are
    one vector, that of the smallest label and then embedding, and are returned as often as they are there, all alike.  Ties,
    that is vectors as near to two pivots, take the pivot of the smaller number.  An empty table gives an empty one; columns
    other than vec_id, label and embedding aren't read, so names can't clash.
    """
    vectors = vectors.select("vec_id", "label", "embedding")
    known = clean(vectors)
    usable = known.where("v is not null")
    indexed = staged(described(usable, fit(usable, vectors.count()), nearest), "pivot-lists")
    needed = staged(_needed(blocked(inverted(indexed, shared), _LIST, "vec_id", 8 * F.col("dims")), shared), "vector-candidates")
    wanted = usable.select("vec_id", "v").join(small_side(staged(needed.select("vec_id").distinct(), "wanted-vectors")), "vec_id", "left_semi")
    found = staged(_compared(needed.join(wanted, "vec_id"), least, shared), "vector-links")
    reached = components(found.select("vec_id", F.col("root").alias("other")))
    counted = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    linked = counted.join(reached, counted["vec_id"] == reached["node"]).select("vec_id", "n_links", "component")
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"))
    named = rows.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    nameless = vectors.where("vec_id is null").select(F.lit(None).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return named.unionByName(nameless).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
