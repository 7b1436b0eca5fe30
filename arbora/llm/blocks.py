"""Comparing the members of buckets in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, staged

#: Members of a bucket's part and their bytes; a block has two parts at most.  A part is as large as a task can hold, since n
#: members are sent n / PART times each, while comparing them takes n * n steps however they are dealt.
PART, PART_BYTES = 8192, 24_000_000
#: Rows on a side of a tile, which is compared at once; blocks up to SMALL rows are compared many at a time instead.
TILE, SMALL = 512, 64


def blocked(members: DataFrame, bucket: list[str], name: str, size: Column | None = None, part: int = PART, part_bytes: int = PART_BYTES) -> DataFrame:
    """The members with ``lo``, ``hi`` and ``part``: blocks that hold any two members of a bucket together exactly once.

    A bucket of n members is dealt by a hash of ``name`` to so many parts that each has about ``part`` members and, by ``size``,
    ``part_bytes`` bytes, and each two parts make a block.  Two members of one part meet in the block lo = hi; others in that
    of their parts.  Buckets of one member are left out.  So rows are as many as members up to ``part`` of them in a bucket, and
    n / ``part`` times as many beyond.  Sizes are counted before rows are dealt, so no large bucket ever stands in one task.
    """
    counted = members.groupBy(*bucket).agg(F.count("*").alias("in_bucket"), F.sum(F.lit(0) if size is None else size).alias("bytes"))
    counted = counted.where("in_bucket > 1")
    parts = F.least(F.col("in_bucket"), F.greatest(F.ceil(F.col("in_bucket") / F.lit(part)), F.ceil(F.col("bytes") / F.lit(part_bytes))))
    sizes = staged(counted.select(*bucket, parts.cast("int").alias("parts")), "bucket-sizes")
    dealt = members.join(small_side(sizes), bucket).withColumn("part", F.pmod(F.xxhash64(name, F.lit(3)), F.col("parts")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return other.withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")}).drop("other", "parts")


def streamed(batches: Iterator[pa.RecordBatch], key: list[str], enough_rows: int = 20_000, enough_bytes: int = 16_000_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole blocks of rows sorted by ``key``, many at a time, with where each block starts, and the end."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def starts(table: pa.Table) -> np.ndarray:
        if not len(table):
            return np.zeros(1, "i8")
        new = np.zeros(len(table) - 1, bool)
        for k in key:
            column = table.column(k).combine_chunks()
            new |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(new) + 1, [len(table)]])

    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= enough_rows or size >= enough_bytes:
            table = pa.Table.from_batches(held)
            at = starts(table)
            if len(at) > 2:  # the last block may go on
                yield table.slice(0, at[-2]), at[:-1]
                held = table.slice(at[-2]).to_batches()
                rows = len(table) - at[-2]
                size = sum(x.get_total_buffer_size() for x in held) // max(1, len(table)) * rows
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 reaches by the links i-j."""
    label = np.arange(n)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
        while (label[label] != label).any():
            label = label[label]
    return label


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n links that join what the links i-j of 0..n-1 do."""
    roots = local_components(n, i, j)
    own = np.flatnonzero(roots != np.arange(n))
    return own, roots[own]


def pairs_within(starts: np.ndarray, parts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows to compare in blocks of up to SMALL rows, in pieces of bounded size: within a block lo = hi all two, else one of each
    part."""
    sizes = np.diff(starts)
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        at = starts[:-1][sizes == n]
        i, j = np.triu_indices(n, 1)
        step = max(1, 400_000 // len(i))
        for k in range(0, len(at), step):
            a, b = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
            kept = (lo[a] == hi[a]) | (parts[a] != parts[b])
            yield a[kept], b[kept]


def tiles(starts: np.ndarray, parts: np.ndarray, lo: np.ndarray, hi: np.ndarray, over: int = SMALL) -> Iterator[tuple[slice, slice]]:
    """Ranges of rows to compare with each other in blocks of more than ``over`` rows, which are sorted by part.  A range with
    itself stands for all two of its rows."""
    sizes = np.diff(starts)
    for a, b in zip(starts[:-1][sizes > over].tolist(), starts[1:][sizes > over].tolist(), strict=True):
        one_part = lo[a] == hi[a]
        cut = b if one_part else a + int(np.searchsorted(parts[a:b], parts[a], side="right"))
        for i in range(a, cut, TILE):
            for j in range(i if one_part else cut, b, TILE):
                yield slice(i, min(i + TILE, cut)), slice(j, min(j + TILE, b))
