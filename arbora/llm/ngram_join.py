"""N-gram Jaccard join by MinHash banding.

Every document is the set of its windows of five words.  Equal sets are one class, compared once.  Classes meet where a
band of their MinHash signatures is equal; bands and rows follow from the recall wanted at the least similarity.  Buckets
are compared in blocks of bounded size, two classes only in the bucket of the first band they share, and every candidate is
verified on the full sets.  What leaves a block is a count for each class and a spanning forest of its links, while every link
is counted.  Counting the links of n near copies takes n * n comparisons; rows moved for that are n up to PART of them in a
bucket, and n * n / PART beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, forest, local_components, pairs_within, streamed, tiles
from .common import small_batches, small_side, staged, text_of, tidied
from .graph import components
from .words import WINDOW, mixed, strings, window_hashes, window_starts, words

LEAST, RECALL, MOST_HASHES, SEED = 0.8, 0.9995, 160, 11
_CHUNK = 1 << 15


def band_shape(least: float = LEAST, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows, and so the fewest false candidates, with which ``most`` hashes reach the recall."""
    best = None
    for rows in range(1, most + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(least**rows)))) if least < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("too few hashes for that recall")
    return best


def gram_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts that have words, the 64-bit hashes of their different windows, and the bounds of each text's among them.

    A text of fewer than five words has one window, all of its words.
    """
    found = words(strings(texts))
    value_hash = np.array([_word_hash(x) for x in found.values.cast(pa.large_binary()).to_pylist()], "u8")
    of_word = value_hash[found.codes] if len(found.codes) else np.empty(0, "u8")
    starts, of = window_starts(found, WINDOW)
    grams = [window_hashes(of_word, starts, WINDOW)]
    texts_of = [of]
    for size in range(1, WINDOW):
        short = np.flatnonzero(found.counts == size)
        grams.append(window_hashes(of_word, found.bounds[short], size) ^ np.uint64(size))
        texts_of.append(short)
    gram, of = np.concatenate(grams), np.concatenate(texts_of)
    order = np.argsort(gram, kind="stable")
    order = order[np.argsort(of[order], kind="stable")]
    gram, of = gram[order], of[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])
    gram, of = gram[new], of[new]
    having, first = np.unique(of, return_index=True)
    return having, gram, np.concatenate([first, [len(gram)]]).astype("i8")


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def set_keys(gram: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 128-bit key of each set, as rows of two numbers."""
    if len(bounds) == 1:
        return np.empty((0, 2), "u8")
    return np.stack([np.add.reduceat(mixed(gram ^ np.uint64(salt)), bounds[:-1]) for salt in (0x5BF03635, 0x7F4A7C159E3779B9)], axis=1)


def band_hashes(gram: np.ndarray, bounds: np.ndarray, bands: int, rows: int, seed: int = SEED) -> np.ndarray:
    """One hash for each set and band."""
    n = len(bounds) - 1
    draw = np.random.default_rng(seed).integers(0, 2**64, (bands * rows, 2), "u8")
    least = np.full((bands * rows, n), np.iinfo("u8").max, "u8")
    at = 0
    while at < n:  # as many whole sets as fit a chunk that stays in the processor's cache, at least one
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _CHUNK, side="right")) - 1)
        some, cuts = gram[bounds[at] : bounds[end]], bounds[at:end] - bounds[at]
        room = np.empty(len(some), "u8")
        for k, (a, b) in enumerate(draw):
            np.multiply(some, a | np.uint64(1), out=room)
            np.add(room, b, out=room)
            least[k, at:end] = np.minimum.reduceat(room, cuts)
        at = end
    out = np.empty((n, bands), "u8")
    for k in range(bands):
        total = np.full(n, k + 1, "u8")
        for r in range(rows):
            total = mixed(total ^ least[k * rows + r])
        out[:, k] = total
    return out


def _binary(keys: np.ndarray) -> list[bytes]:
    raw = np.ascontiguousarray(keys, "<u8").tobytes()
    return [raw[i : i + 16] for i in range(0, len(raw), 16)]


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, set (its key; null without words), grams (how many), bands (array of hashes) of each row."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            having, gram, bounds = gram_sets(batch.column(1))
            n = batch.num_rows
            keys: list[bytes | None] = [None] * n
            for k, key in zip(having.tolist(), _binary(set_keys(gram, bounds)), strict=True):
                keys[k] = key
            counts = np.zeros(n, "i8")
            counts[having] = np.diff(bounds)
            offsets = np.concatenate([[0], np.cumsum(counts > 0)]) * bands
            flat = band_hashes(gram, bounds, bands, rows).astype("i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["doc_id", "set", "grams", "bands"])

    return text_of(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(tidied(sign), "doc_id long, set binary, grams long, bands array<long>")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """set, members: the sorted hashes of the sets of the wanted documents (column rep)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            having, gram, bounds = gram_sets(batch.column(0))
            raw = gram.astype("<u8").tobytes()
            members = [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_binary(set_keys(gram, bounds)), pa.binary()), pa.array(members, pa.binary())], ["set", "members"])

    texts = text_of(docs, F.col("doc_id").cast("long").alias("rep")).join(small_side(wanted), "rep", "left_semi").select("text")
    return texts.mapInArrow(tidied(gather), "set binary, members binary")


def _bands_of(table: pa.Table) -> np.ndarray:
    column = table.column("bands").combine_chunks()
    return column.flatten().to_numpy().reshape(len(table), -1)


_BLOCK = ["bucket", "lo", "hi"]
_ROOM = 12_000_000  # cells of a matrix of sets


class _Blocks:
    """The pairs of a table's blocks whose first shared band is the block's."""

    def __init__(self, table: pa.Table, starts: np.ndarray):
        self.starts, self.bands = starts, _bands_of(table)
        self.by_band = np.ascontiguousarray(self.bands.T)
        self.parts, self.lo, self.hi, self.bucket = (table.column(c).to_numpy() for c in ("part", "lo", "hi", "bucket"))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of small blocks."""
        for a, b in pairs_within(self.starts, self.parts, self.lo, self.hi):
            for k in range(0, len(a), 50_000):
                i, j = a[k : k + 50_000], b[k : k + 50_000]
                same = self.bands[i] == self.bands[j]
                first = same.argmax(axis=1)
                kept = same[np.arange(len(i)), first] & (self.bands[i, first] == self.bucket[i])
                yield i[kept], j[kept]

    def tiles(self) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Ranges of rows of larger blocks, and which two of them are pairs: all of a block share its band, so the others are told
        by the bands before it."""
        for i, j in tiles(self.starts, self.parts, self.lo, self.hi):
            own = int((self.bands[i.start] == self.bucket[i.start]).argmax())
            earlier = np.zeros((i.stop - i.start, j.stop - j.start), bool)
            for band in self.by_band[:own]:
                earlier |= band[i, None] == band[None, j]
            close = ~earlier
            yield i, j, np.triu(close, 1) if i == j else close


def _needed(members: DataFrame) -> DataFrame:
    """The members that have something to be compared with in their block, from the signatures alone."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in streamed(batches, _BLOCK):
            used, found = np.zeros(len(table), bool), _Blocks(table, starts)
            for i, j in found.pairs():
                used[i] = used[j] = True
            for i, j, close in found.tiles():
                used[i] |= close.any(axis=1)
                used[j] |= close.any(axis=0)
            yield from table.filter(pa.array(used)).combine_chunks().to_batches(max_chunksize=10_000)

    return members.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "part").mapInArrow(tidied(pick), members.schema)


class _Sets:
    """The sets of a table's rows, as numbers of their different members, row after row."""

    def __init__(self, column: pa.BinaryArray):
        n = len(column)
        at = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + n + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", "u1")[at[0] : at[-1]].view("<u8")
        self.bounds = (at - at[0]).astype("i8") // 8
        self.sizes = np.diff(self.bounds)
        values, codes = np.unique(raw, return_inverse=True)
        self.codes = codes.astype("i4" if len(values) < 2**31 else "i8")
        self.inside = np.zeros(len(values), bool)
        self.of_range: dict[int, np.ndarray] = {}

    def shared(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of pairs i, j, one i after another: i, its j and how many members they share."""
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for one, at, count in zip(*np.unique(i, return_index=True, return_counts=True), strict=True):
            others = j[at : at + count]
            own = self.codes[self.bounds[one] : self.bounds[one + 1]]
            self.inside[own] = True
            each = self.sizes[others]
            ends = np.cumsum(each)
            places = np.repeat(self.bounds[others] - (ends - each), each) + np.arange(ends[-1])
            both = np.add.reduceat(self.inside[self.codes[places]].astype("i8"), ends - each)
            self.inside[own] = False
            yield np.full(len(others), one), others, both

    def _range(self, rows: slice) -> np.ndarray:
        """The different members of a range of rows, sorted."""
        if rows.start not in self.of_range:
            self.of_range[rows.start] = np.unique(self.codes[self.bounds[rows.start] : self.bounds[rows.stop]])
        return self.of_range[rows.start]

    def _matrix(self, rows: slice, members: np.ndarray) -> np.ndarray:
        own = self.codes[self.bounds[rows.start] : self.bounds[rows.stop]]
        row = np.repeat(np.arange(rows.stop - rows.start), self.sizes[rows])
        at = np.minimum(np.searchsorted(members, own), len(members) - 1)
        held = members[at] == own
        out = np.zeros((rows.stop - rows.start, len(members)), "f4")
        out[row[held], at[held]] = 1
        return out

    def overlaps(self, i: slice, j: slice) -> np.ndarray:
        """How many members each two rows of two ranges share: products of matrices over the members that both ranges have."""
        common = np.intersect1d(self._range(i), self._range(j), assume_unique=True)
        total = np.zeros((i.stop - i.start, j.stop - j.start), "f4")  # whole numbers below 2^24 are exact
        step = max(1, _ROOM // max(i.stop - i.start, j.stop - j.start))
        for k in range(0, len(common), step):
            one = self._matrix(i, common[k : k + step])
            total += one @ (one if i == j else self._matrix(j, common[k : k + step])).T
        return total


def _verified(members: DataFrame, least: float) -> DataFrame:
    """For each member of a block its set and ``links`` (documents of the classes linked with it), and as ``a`` and ``b`` a
    link to the smallest member that it reaches there."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in streamed(batches, _BLOCK):
            # A set comes twice where a row of the documents does; the first one stays.
            block = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            seen, first = set(), np.zeros(len(table), bool)
            for k, name in enumerate(zip(block.tolist(), table.column("set").to_pylist(), strict=True)):
                if name not in seen:
                    seen.add(name)
                    first[k] = True
            if not first.all():
                table, block = table.filter(pa.array(first)), block[first]
                starts = np.searchsorted(block, np.arange(block[-1] + 2)) if len(block) else np.zeros(1, "i8")
            n = len(table)
            found, sets, copies = _Blocks(table, starts), _Sets(table.column("members").combine_chunks()), table.column("copies").to_numpy()
            links, sizes = np.zeros(n, "i8"), sets.sizes
            from_, to = [np.empty(0, "i8")], [np.empty(0, "i8")]
            for i, j in found.pairs():
                near = np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j]) - 1e-9
                for one, others, both in sets.shared(i[near], j[near]):
                    linked = both >= least * (sizes[others] + sizes[one] - both) - 1e-9
                    a, b = one[linked], others[linked]
                    links[a[:1]] += copies[b].sum()
                    links[b] += copies[a]
                    from_.append(a)
                    to.append(b)
            for i, j, close in found.tiles():
                x, y = sizes[i, None], sizes[None, j]
                close &= np.minimum(x, y) >= least * np.maximum(x, y) - 1e-9
                if close.any():
                    both = sets.overlaps(i, j)
                    linked = close & (both >= least * (x + y - both.astype("f8")) - 1e-9)
                    links[i] += linked @ copies[j]
                    links[j] += copies[i] @ linked
                    a, b = np.nonzero(linked)
                    width = i.stop - i.start
                    a, b = forest(width + j.stop - j.start, a, b if i == j else b + width)
                    from_.append(np.where(a < width, a + i.start, a - width + j.start))
                    to.append(np.where(b < width, b + i.start, b - width + j.start))
            roots = local_components(n, np.concatenate(from_), np.concatenate(to))
            reps = table.column("rep").to_numpy()
            kept = links > 0
            yield pa.RecordBatch.from_arrays([table.column("set").combine_chunks().filter(pa.array(kept)), pa.array(links[kept]), pa.array(reps[kept]), pa.array(reps[roots[kept]])], ["set", "links", "a", "b"])

    return members.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "part").mapInArrow(tidied(verify), "set binary, links long, a long, b long")


def link(docs: DataFrame, least: float = LEAST, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_links, class_id, kept.

    ``n_links`` counts the other documents whose sets of five-word windows have a Jaccard similarity of ``least`` or more,
    exact copies among them; ``class_id`` is the smallest doc_id that links reach, and ``kept`` marks it.  Words are runs of
    characters other than white space, as they are written.  A text without words (null, empty) links with nothing.  A null
    doc_id links with nothing and is kept, its class being null.  Rows that repeat are copies of each other, and rows
    sharing a doc_id are in one class.  A very long text is one set like others; a part of a bucket has fewer members where
    they are long.  Ties don't arise: all links at the threshold or above count.  An empty table gives an empty one.  Columns
    other than doc_id and text aren't read, so names can't clash.
    """
    bands, rows = band_shape(least, recall, most_hashes)
    signed = staged(signatures(docs, bands, rows), "signatures")
    known = signed.where("doc_id is not null and set is not null")
    classes = staged(known.groupBy("set").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("set", "grams", F.explode("bands").alias("bucket"))
    members = blocked(buckets, ["bucket"], "set", 8 * (F.col("grams") + bands)).drop("grams").join(classes.drop("grams"), "set")
    needed = staged(_needed(members), "candidates")
    sets = _full_sets(docs, staged(needed.select("rep").distinct(), "wanted"))
    found = staged(_verified(needed.join(sets, "set"), least), "links")
    reached = components(found.select("a", "b"))
    counted = found.groupBy("set").agg(F.sum("links").alias("links"))
    many = classes.select("set", "rep", "copies").join(counted, "set", "left").where("copies > 1 or links is not null")
    named = staged(many.join(reached, many["rep"] == reached["node"], "left").select("set", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("class")), "classes-named")
    # A doc_id that has several rows is in the class of any of them.
    all_rows = signed.select("doc_id", "set").join(named, "set", "left")
    return all_rows.select("doc_id", F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("class_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def deduplicate(docs: DataFrame, least: float = LEAST, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """The rows of ``docs`` but for all documents other than the first of each class, with their columns.

    Of rows that share a doc_id one stays, that with the smallest text (null: empty), any one if these are alike.  Rows without
    doc_id and texts without words stay.  An empty table gives an empty one.  Columns may have any name.
    """
    linked = staged(link(docs, least, recall, most_hashes), "linked")
    dropped = staged(linked.where("not kept").select("doc_id").distinct(), "dropped")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("dedup_id"))
    rows = rows.join(small_side(dropped.withColumnRenamed("doc_id", "dedup_id")), "dedup_id", "left_anti")
    repeated = staged(linked.where("doc_id is not null").groupBy(F.col("doc_id").alias("dedup_id")).count().where("count > 1").select("dedup_id"), "repeated")
    if not repeated.isEmpty():
        many = rows.join(small_side(repeated), "dedup_id", "left_semi").groupBy("dedup_id").agg(F.min_by("row", F.coalesce("row.text", F.lit(""))).alias("row"))
        rows = rows.join(small_side(repeated), "dedup_id", "left_anti").unionByName(many.select("dedup_id", "row"))
    return rows.select("row.*")
