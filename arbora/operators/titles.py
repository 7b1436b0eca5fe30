"""Where titles stand on pages, without regard to case and white space: one index for placing, filling gaps and repairing.

Every title of a document is looked for on all of its pages in one pass.  A title of 2 ** j to 2 ** (j + 1) - 1 characters is
known by its first and its last 2 ** j: rolling fingerprints of 1, 2, 4, ... characters are made of the pages, each from two of
the one before, and where the first part's is met, that of both parts is looked up among the titles of the same length.  What is
met so is compared itself.  The work is in proportion to the text and to what is found in it, however many titles there are.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import squeezed

#: Fingerprints are of 2 ** MOST_BLOCK characters at most.
MOST_BLOCK = 5
#: Titles times characters up to which each title is looked for on each page, which takes less than to make ready for more.
SMALL = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _fingerprints(text: str) -> list[np.ndarray]:
    """Of each place, those of the next 1, 2, 4, ... characters; blocks past the end have none."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype("u8") + np.uint64(1)
    codes *= _ODD
    codes ^= codes >> np.uint64(29)
    found = [codes]
    for j in range(MOST_BLOCK):
        step, last = 1 << j, found[-1]
        if len(last) <= step:
            break
        joint = last[:-step] * np.uint64(0xBF58476D1CE4E5B9 + 2 * j) + last[step:]
        joint ^= joint >> np.uint64(31)
        found.append(joint)
    return found


def _both(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first * _ODD + last


class Titles:
    """The squeezed titles of one document, ready to be found."""

    def __init__(self, titles: list[str]):
        self.titles, self.made = titles, False

    def _make(self) -> None:
        self.made, titles = True, self.titles
        lengths = np.array([len(t) for t in titles], "i8")
        self.everywhere = np.flatnonzero(lengths == 0)
        made = [_fingerprints(t) for t in titles]
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]] = {}
        block = np.minimum(MOST_BLOCK, np.array([n.bit_length() - 1 for n in lengths.tolist()], "i8"))
        for j in np.unique(block[lengths > 0]).tolist():
            of = np.flatnonzero((block == j) & (lengths > 0))
            first = np.array([made[k][j][0] for k in of.tolist()], "u8")
            seen = np.zeros(1 << 16, bool)
            seen[(first >> np.uint64(48)).astype("i8")] = True
            by_length = {}
            for n in np.unique(lengths[of]).tolist():
                own = of[lengths[of] == n]
                both = _both(first[lengths[of] == n], np.array([made[k][j][n - (1 << j)] for k in own.tolist()], "u8"))
                order = np.argsort(both, kind="stable")
                by_length[n] = both[order], own[order]
            self.blocks[j] = np.unique(first), seen, by_length

    def on(self, pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of titles and of the pages that have them, each two once, in order of pages."""
        if len(self.titles) * sum(map(len, pages)) <= SMALL:
            both = [(k, n) for n, page in enumerate(pages) for k, title in enumerate(self.titles) if title in page]
            return np.array([k for k, _ in both], "i8"), np.array([n for _, n in both], "i8")
        if not self.made:
            self._make()
        text = "".join(pages)
        ends = np.cumsum([len(p) for p in pages])
        prints = _fingerprints(text)
        titles, found = [np.repeat(self.everywhere, len(pages))], [np.tile(np.arange(len(pages)), len(self.everywhere))]
        for j, (firsts, seen, by_length) in self.blocks.items():
            if j >= len(prints):
                continue
            own = prints[j]
            at = np.flatnonzero(seen[(own >> np.uint64(48)).astype("i8")])
            at = at[np.isin(own[at], firsts)]
            if not len(at):
                continue
            page = np.searchsorted(ends, at, side="right")
            for n, (known, of) in by_length.items():
                inside = at + n <= ends[page]
                some, on = at[inside], page[inside]
                both = _both(own[some], own[some + n - (1 << j)])
                low, high = np.searchsorted(known, both, side="left"), np.searchsorted(known, both, side="right")
                for p, k, a, b in zip(some[high > low].tolist(), on[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    here = [t for t in of[a:b].tolist() if text.startswith(self.titles[t], p)]
                    titles.append(np.array(here, "i8"))
                    found.append(np.full(len(here), k))
        pairs = np.unique(np.stack([np.concatenate(found).astype("i8"), np.concatenate(titles).astype("i8")], axis=1), axis=0)
        return pairs[:, 1], pairs[:, 0]


def finds(items: DataFrame, pages: DataFrame, starts: bool = False) -> DataFrame:
    """doc_id, key, physical_index: the pages (doc_id, physical_index, text) that have a title of their document's ``items``.

    ``key`` is the squeezed title; each is there once for a page, however many items have it.  A task takes in a document's titles
    and then reads its pages one batch after another.  An empty title stands on every page, a null one on none.
    With ``starts`` there is a column of that name: whether the page begins with the title.
    """
    named = items.select("doc_id", F.lit(None).cast("int").alias("physical_index"), squeezed(F.col("title")).alias("text"))
    rows = named.unionByName(pages.select("doc_id", F.col("physical_index").cast("int").alias("physical_index"), squeezed(F.col("text")).alias("text"))).where("text is not null")
    rows = rows.repartition("doc_id").sortWithinPartitions("doc_id", F.col("physical_index").asc_nulls_first())
    kinds = T.StructType([rows.schema["doc_id"], T.StructField("key", T.StringType()), T.StructField("physical_index", T.IntegerType())])
    return rows.mapInArrow(partial(_searched, starts), kinds.add("starts", T.BooleanType()) if starts else kinds)


def _searched(starts: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, begun, titles, known = None, False, {}, None
    for batch in batches:
        docs, numbers, texts = (batch.column(c).to_pylist() for c in range(3))
        keys, places, rows, begins, at = [], [], [], [], 0
        while at < len(docs):
            end, doc, names = at, docs[at], numbers[at] is None
            while end < len(docs) and docs[end] == doc and (numbers[end] is None) == names:
                end += 1
            if not begun or doc != now:
                now, begun, titles, known = doc, True, {}, None
            if names:
                titles |= dict.fromkeys(texts[at:end])
            elif titles:
                known = known or Titles(list(titles))
                of, on = known.on(texts[at:end])
                keys += [known.titles[k] for k in of.tolist()]
                rows += (on + at).tolist()
                places += [numbers[at + k] for k in on.tolist()]
                if starts:
                    begins += [texts[at + p].startswith(known.titles[k]) for k, p in zip(of.tolist(), on.tolist(), strict=True)]
            at = end
        if rows:
            columns = {"doc_id": batch.column(0).take(pa.array(rows)), "key": pa.array(keys, pa.string()), "physical_index": pa.array(places, pa.int32())}
            yield pa.RecordBatch.from_pydict(columns | ({"starts": pa.array(begins, pa.bool_())} if starts else {}))


def judged(items: DataFrame, found: DataFrame) -> DataFrame:
    """``items`` with ``answer`` and ``appear_start``: whether their page has their title, and begins with it, by ``found``, which
    has ``starts`` and all their titles."""
    hit = found.select("doc_id", "key", "physical_index", "starts")
    met = items.withColumn("key", squeezed(F.col("title"))).join(hit, ["doc_id", "key", "physical_index"], "left")
    return met.withColumns({"answer": F.when(F.col("starts").isNotNull(), "yes").otherwise("no"), "appear_start": F.when(F.col("starts"), "yes").otherwise("no")}).drop("key", "starts")


def of_titles(found: DataFrame, items: DataFrame) -> DataFrame:
    """What is found of the titles of ``items``."""
    return found.join(items.select("doc_id", squeezed(F.col("title")).alias("key")).distinct(), ["doc_id", "key"], "left_semi")


def first_pages(items: DataFrame, found: DataFrame) -> DataFrame:
    """``items`` with ``physical_index``, the first page of ``found`` that has their title."""
    first = found.groupBy("doc_id", "key").agg(F.min("physical_index").alias("physical_index"))
    return items.withColumn("key", squeezed(F.col("title"))).join(first, ["doc_id", "key"], "left").drop("key")


def first_within(ranged: DataFrame, found: DataFrame, first: str, last: str) -> DataFrame:
    """``ranged`` (doc_id, list_index, title, ...) with ``fixed_index``, the first page from ``first`` to ``last`` that has the title.

    Finds and questions of a title are put in one order, from the last page to the first, in which the running last find is the
    nearest one at or after a question.
    """
    asked = ranged.select("doc_id", squeezed(F.col("title")).alias("key"), F.col(first).cast("long").alias("at"), "list_index", F.lit(None).cast("int").alias("page"))
    seen = found.select("doc_id", "key", F.col("physical_index").cast("long").alias("at"), F.lit(None).cast(dict(ranged.dtypes)["list_index"]).alias("list_index"), F.col("physical_index").alias("page"))
    order = Window.partitionBy("doc_id", "key").orderBy(F.col("at").desc(), F.col("page").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    near = asked.unionByName(seen).withColumn("near", F.last("page", ignorenulls=True).over(order)).where("list_index is not null")
    near = near.select("doc_id", "list_index", "near")
    return ranged.join(near, ["doc_id", "list_index"], "left").withColumn("fixed_index", F.when(F.col("near") <= F.col(last), F.col("near"))).drop("near")


def filled(items: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, list_index, fixed_index of ``items`` (doc_id, list_index, title, physical_index) without an index.

    They are looked for between the nearest known items, those of a gap one after another, so that one that is found narrows the
    next one's range; after the last known item there is no range.  One pass over each document's finds and then its items.
    """
    after = F.last("physical_index", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy(F.col("list_index").desc()).rowsBetween(Window.unboundedPreceding, -1))
    asked = items.select("doc_id", squeezed(F.col("title")).alias("key"), F.lit(None).cast("int").alias("page"), F.col("list_index").cast("long").alias("list_index"), F.col("physical_index").cast("long").alias("known"), after.cast("long").alias("after"))
    blank = F.lit(None).cast("long")
    seen = found.select("doc_id", "key", F.col("physical_index").alias("page"), blank.alias("list_index"), blank.alias("known"), blank.alias("after"))
    rows = seen.unionByName(asked).repartition("doc_id").sortWithinPartitions("doc_id", F.col("page").asc_nulls_last(), "list_index")
    kinds = T.StructType([rows.schema["doc_id"], T.StructField("list_index", T.LongType()), T.StructField("fixed_index", T.IntegerType())])
    return rows.mapInArrow(_walked, kinds)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, pages, before, begun = None, {}, 0, False
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
        rows, fixed = [], []
        for k, (doc, key, page, index, known, after) in enumerate(zip(*columns, strict=True)):
            if not begun or doc != now:
                now, pages, before, begun = doc, {}, 0, True
            if index is None:
                pages.setdefault(key, []).append(page)
                continue
            if known is not None:
                before = known
            elif after is not None and key in pages:
                own = pages[key]
                at = bisect_left(own, before)
                if at < len(own) and own[at] <= after:
                    before = own[at]
                    rows.append(k)
                    fixed.append(before)
        if rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(3).take(pa.array(rows)), pa.array(fixed, pa.int32())], ["doc_id", "list_index", "fixed_index"])
