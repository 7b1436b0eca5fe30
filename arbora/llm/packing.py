"""Packing documents into training sequences by first-fit decreasing in randomised groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, same_rows, small_batches, text_of, tidied
from .tokens import SLICE_BYTES, encoder

CAPACITY, END_ID, GROUP_DOCS, SEED = 2048, 1, 1024, 17
#: Groups of a task at most.
GROUPS = 32
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Tournament:
    """A tournament tree over the free room of bins; each inner node holds the most of its two.  The first bin that fits
    an item is found in one walk from the root."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The leftmost bin with room for ``size``, which it takes."""
        most, k = self.most, 1
        if most[1] < size:
            raise ValueError("no bin has room")
        while k < self.leaves:
            k *= 2
            if most[k] < size:
                k += 1
        found = k - self.leaves
        most[k] -= size
        k //= 2
        while k:
            a, b = most[2 * k], most[2 * k + 1]
            now = a if a >= b else b
            if most[k] == now:
                break
            most[k] = now
            k //= 2
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """The items of each bin; items of one size keep their order."""
    tree, bins = Tournament(len(sizes), room), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = tree.take(sizes[i])
        if k == len(bins):
            bins.append([])
        bins[k].append(i)
    return bins


def cut_bin(sizes: list[int], room: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """The sequences of one bin as (item, start, length): one, or where over ``slack`` would be padding, powers of two."""
    total = sum(sizes)
    lengths = [total] if room - total <= slack else [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
    out, item, at = [], 0, 0
    for left in lengths:
        parts = []
        while left:
            n = min(left, sizes[item] - at)
            parts.append((item, at, n))
            left, at = left - n, at + n
            if at == sizes[item]:
                item, at = item + 1, 0
        out.append(parts)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = SEED) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` ids.

    A document's ids are those of its text (null: empty) and ``end_id``.  Documents are dealt by a hash of doc_id, text and
    seed to groups of about ``group_docs``, and each group is packed by itself: whole ``capacity`` stretches of a document
    are sequences at once, so that only the rest of each document, less than one sequence, is held until its group ends, or
    has four times as many as meant.  The rests are packed by first-fit decreasing; those of one length, in order of doc_id and
    text.  A bin that would have more than an eighth of padding is cut into sequences whose lengths are powers of two, which
    need none.  Sequence ids are group * 2^32 + number, and do not change from run to run.  A task has at most GROUPS groups,
    however many documents there are.  Rows that repeat are so many documents; rows that repeat very often are numbered, by which they
    are dealt to many groups.  doc_id may be null.  A very long text is encoded whole, in slices of its words, and its
    pieces leave at once.  An empty table gives an empty one.  Columns other than doc_id and text aren't read, so names can't
    clash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    counts = same_rows(own)
    groups = max(1, -(-counts.n // group_docs))
    group = F.pmod(F.xxhash64("doc_id", "text", "copy", F.lit(seed)), F.lit(groups)).cast("int").alias("group")
    tasks = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // GROUPS)))
    numbered = counts.spread(own).select(group, "doc_id", "text")
    dealt = numbered.repartitionById(tasks, F.pmod("group", F.lit(tasks)).cast("int")).sortWithinPartitions("group", "doc_id", "text")
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        now: int | None = None
        number = 0
        rests: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start, doc_tokens, ids

        def rows(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

        def ended() -> Iterator[tuple]:
            nonlocal number
            for held in first_fit_decreasing([len(r[3]) // 4 for r in rests], capacity):
                for parts in cut_bin([len(rests[i][3]) // 4 for i in held], capacity, capacity // 8):
                    offset = 0
                    for item, at, n in parts:
                        doc, start, tokens, ids = rests[held[item]]
                        yield doc, start + at, n, tokens, (now << 32) + number, offset, ids[4 * at : 4 * (at + n)]
                        offset += n
                    number += 1

        out: list[tuple] = []
        for batch in gathered(batches, SLICE_BYTES):
            for group, doc, got in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), codec.encode(batch.column(2)), strict=True):
                if group != now:
                    out += ended()
                    now, number, rests = group, 0, []
                ids = got.tobytes() + end
                tokens = len(ids) // 4
                whole = tokens - tokens % capacity
                for start in range(0, whole, capacity):
                    out.append((doc, start, capacity, tokens, (now << 32) + number, 0, ids[4 * start : 4 * (start + capacity)]))
                    number += 1
                if whole < tokens:
                    rests.append((doc, whole, tokens, ids[4 * whole :]))
                    if len(rests) >= 4 * group_docs:  # rows that repeat a lot fall into one group
                        out += ended()
                        rests = []
                if len(out) >= 2000:
                    yield rows(out)
                    out = []
        out += ended()
        for i in range(0, len(out), 2000):
            yield rows(out[i : i + 2000])

    return dealt.mapInArrow(tidied(place, encodes=True), PIECES)
