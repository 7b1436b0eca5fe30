"""Periodic runs of words: repeated k-gram masking, then Main and Lorentz's search in what survives.

A run of period q and length n >= max(LEAST, 2 * q) agrees with itself moved by q in n - q >= LEAST / 2 words, and every word of
it lies in one of the two copies.  So each word of a run lies in a k-gram that its document holds twice, with k = LEAST / 2
words.  Words outside such k-grams can't belong to runs and cut the text into segments, which alone are searched.

A segment is halved again and again.  A run is found where it first crosses a middle: of a run that reaches a period's
length to the right of it, the word before the middle equals the one a period later, and of one that reaches so far to the
left the word at the middle equals the one a period before.  From these two words it is extended both ways as far as words
agree.  The halves of all segments of a batch are searched at once, and how far two places agree comes from exact names of the
segments' blocks of 1, 2, 4, ... words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, small_batches, text_of, tidied
from .words import Words, mixed, strings, window_hashes, window_starts, words

LEAST = 12
_BATCH_BYTES = 4_000_000
#: Pairs of places that are compared at once.
_CHUNK = 1 << 20


def surviving(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Which words lie in a k-gram that its text holds twice, k being the least overlap of a run with itself."""
    size = max(1, least // 2)
    found = Words(codes, pa.array([], pa.large_string()), bounds)
    starts, of = window_starts(found, size)
    hashes = window_hashes(mixed(codes.astype("u8") + np.uint64(1)), starts, size) ^ mixed(of.astype("u8") + np.uint64(1))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edges = np.zeros(len(codes) + 1, "i8")
    edges[starts[twice]] += 1
    edges[starts[twice] + size] -= 1
    return np.cumsum(edges)[:-1] > 0


class Agreements:
    """How far two places of one segment agree, to the right and to the left."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """``codes`` of all segments, one after another, and where each place's segment starts and ends."""
        self.starts, self.ends = starts, ends
        longest = int((ends - starts).max(initial=0))
        self.names = [codes]
        while 2 << (len(self.names) - 1) <= longest:
            last, step = self.names[-1], 1 << (len(self.names) - 1)
            key = last[:-step] * np.int64(int(last.max()) + 1) + last[step:]
            self.names.append(np.unique(key, return_inverse=True)[1].astype("i8"))

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from ``a`` and ``b`` > a on."""
        n, room = np.zeros(len(a), "i8"), self.ends[np.minimum(a, len(self.ends) - 1)] - b
        for j in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(n + (1 << j) <= room)
            same = self.names[j][(a + n)[fits]] == self.names[j][(b + n)[fits]]
            n[fits[same]] += 1 << j
        return n

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree before ``a`` and ``b`` > a."""
        n, room = np.zeros(len(a), "i8"), a - self.starts[a - 1]
        for j in range(len(self.names) - 1, -1, -1):
            fits = np.flatnonzero(n + (1 << j) <= room)
            same = self.names[j][(a - n)[fits] - (1 << j)] == self.names[j][(b - n)[fits] - (1 << j)]
            n[fits[same]] += 1 << j
        return n


def crossing(codes: np.ndarray, agree: Agreements, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(start, end, period) of stretches of two periods or more that cross the middles of the parts low..high."""
    middle = (low + high) // 2
    found = [np.empty((0, 3), "i8")]
    sizes = high - low
    done = 0
    while done < len(low):  # as many parts as fit a chunk, at least one
        upto = max(done + 1, int(np.searchsorted(np.cumsum(sizes[done:]), _CHUNK, side="right")) + done)
        part = np.repeat(np.arange(done, upto), sizes[done:upto])
        place = np.arange(len(part)) - np.repeat(np.cumsum(sizes[done:upto]) - sizes[done:upto], sizes[done:upto]) + low[part]
        m = middle[part]
        later = (place >= m) & (codes[place] == codes[m - 1])  # the word before the middle, a period later
        earlier = (place < m) & (codes[place] == codes[m])  # the one at the middle, a period before
        at = np.concatenate([m[later] - 1, place[earlier]])
        period = np.concatenate([place[later] - m[later] + 1, m[earlier] - place[earlier]])
        # Both places agree themselves, so that they are counted to the right.
        start, end = at - _left(agree, at, period), at + agree.right(at, at + period) + period
        whole = end - start >= 2 * period
        found.append(np.stack([start[whole], end[whole], period[whole]], axis=1))
        done = upto
    return np.concatenate(found)


def _left(agree: Agreements, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    n = np.zeros(len(at), "i8")
    inside = at > 0
    inside[inside] = agree.starts[at[inside]] < at[inside]
    n[inside] = agree.left(at[inside], (at + period)[inside])
    return n


def maximal(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(text, start, end, period) of every run, in this order; places are words of the text."""
    none = np.empty((0, 4), "i8")
    kept = surviving(codes, bounds, least)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    joins = kept[1:] & kept[:-1] & (text[1:] == text[:-1])
    places = np.flatnonzero(kept)
    if not len(places):
        return none
    first = places[np.concatenate([[True], ~joins[places[1:] - 1]])]
    last = places[np.concatenate([~joins[places[:-1]], [True]])] + 1
    long = last - first >= least
    first, last = first[long], last[long]
    if not len(first):
        return none
    sizes = last - first
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    shift = np.repeat(first - begin, sizes)
    own = codes[np.arange(len(shift)) + shift]
    agree = Agreements(own, np.repeat(begin, sizes), np.repeat(begin + sizes, sizes))
    low, high, found = begin, begin + sizes, []
    while len(low):
        found.append(crossing(own, agree, low, high))
        middle = (low + high) // 2
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        long = high - low >= least
        low, high = low[long], high[long]
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # of one stretch the smallest period
    rows = rows[new]
    rows = rows[rows[:, 1] - rows[:, 0] >= np.maximum(least, 2 * rows[:, 2])]
    if not len(rows):
        return none
    of, back = text[rows[:, 0] + shift[rows[:, 0]]], shift[rows[:, 0]]
    start = rows[:, 0] + back - bounds[of]
    out = np.stack([of, start, start + rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def dropped(runs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which words stand in a run after its first period."""
    edges = np.zeros(int(bounds[-1]) + 1, "i8")
    np.add.at(edges, bounds[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(edges, bounds[runs[:, 0]] + runs[:, 2], -1)
    return np.cumsum(edges)[:-1] > 0


def collapsed(found: Words, gone: np.ndarray) -> pa.Array:
    """The words of each text that are left, joined by one space."""
    left = ~gone
    before = np.concatenate([[0], np.cumsum(left)])
    lists = pa.LargeListArray.from_arrays(pa.array(before[found.bounds], pa.int64()), found.values.cast(pa.large_string()).take(pa.array(found.codes[left])))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's periodic texts: in one of ten documents the words from a place on repeat."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _rewritten(found: Words, ids: list, place: Callable | None) -> Words:
    if place is None:
        return found
    codes = found.codes.copy()
    for doc_id, a, b in zip(ids, found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
        at = place(doc_id, b - a)
        if at is not None:
            codes[a:b] = found.codes[a:b][at]
    return Words(codes, found.values, found.bounds)


def scan(docs: DataFrame, least: int = LEAST, place: Callable | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period in words, in order), collapsed (the text without what repeats) of each row.

    A null text has no words.  A very long text is searched whole, in memory in proportion to it.  Rows that repeat are searched
    each by itself.  Runs can't tie in both start and period.  An empty table gives an empty one.  ``place`` gives the word that
    stands at each place of a document instead of its own, for tests.  Columns other than doc_id and text aren't read, so
    names can't clash.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, _BATCH_BYTES):
            found = _rewritten(words(strings(batch.column(1))), batch.column(0).to_pylist(), place)
            runs = maximal(found.codes, found.bounds, least)
            made = pa.StructArray.from_arrays([pa.array(runs[:, 1]), pa.array(runs[:, 2] - runs[:, 1]), pa.array(runs[:, 3])], fields=list(kind.value_type))
            offsets = np.searchsorted(runs[:, 0], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), made), collapsed(found, dropped(runs, found.bounds)).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(tidied(run), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(docs: DataFrame, least: int = LEAST, place: Callable | None = planted) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    made = scan(docs, least, place).select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return made.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
