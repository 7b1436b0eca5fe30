"""Tables of contents: finding them, matching them with pages, verifying and repairing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import dots_to_colon, page_tag, squeezed
from .common import joined_in_order



def _items() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("list_index")


def _nearest(value: Column) -> tuple[Column, Column]:
    """The last value before an item and the first one after it that is not null.

    Both are running last values, the second from the document's end: a frame that only loses rows would be evaluated anew
    for each of them.
    """
    end = Window.partitionBy("doc_id").orderBy(F.col("list_index").desc())
    return tuple(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) for w in (_items(), end))


def page_runs(pages: DataFrame, limit: int, start: int = 1) -> DataFrame:
    """The pages of each document's first table of contents: ``pages`` (doc_id, physical_index, is_toc: yes, no or other).

    The run begins at the first yes among pages ``start`` to ``limit``, goes on past the limit, and ends before the first no;
    answers that are neither end nothing and are no part of it.
    """
    begin = F.min(F.when((F.col("is_toc") == "yes") & F.col("physical_index").between(start, limit), F.col("physical_index")))
    whole = Window.partitionBy("doc_id")
    marked = pages.withColumn("run_start", begin.over(whole))
    stop = F.min(F.when((F.col("is_toc") == "no") & (F.col("physical_index") > F.col("run_start")), F.col("physical_index")))
    ended = marked.withColumn("run_stop", stop.over(whole))
    return ended.where("is_toc = 'yes' and physical_index >= run_start and (run_stop is null or physical_index < run_stop)").drop("run_start", "run_stop")


def all_runs(pages: DataFrame, limit: int, start: int = 1) -> DataFrame:
    """The pages of every run that begins within the limit, with ``run``, the number of noes before it.

    Between two noes all yes pages are one run, so runs need no scan: the first one is that of ``page_runs``.
    """
    noes = F.sum((F.col("is_toc") == "no").cast("int")).over(Window.partitionBy("doc_id").orderBy("physical_index"))
    inside = pages.where(F.col("physical_index") >= start).withColumn("run", noes).where("is_toc = 'yes'")
    begins = F.min("physical_index").over(Window.partitionBy("doc_id", "run"))
    return inside.withColumn("begins", begins).where(F.col("begins") <= limit).drop("begins")


def chosen_runs(tocs: DataFrame) -> DataFrame:
    """Of each document's ``tocs`` (doc_id, run, numbered, ...) the first that has page numbers, else the first."""
    order = Window.partitionBy("doc_id").orderBy(F.when(F.col("numbered") == "yes", 0).otherwise(1), "run")
    return tocs.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def last_pages(runs: DataFrame) -> DataFrame:
    """doc_id, last_page: the page after which the content starts."""
    return runs.groupBy("doc_id").agg(F.max("physical_index").alias("last_page"))


def toc_text(runs: DataFrame, *key: str) -> DataFrame:
    """doc_id and other keys, toc_text with leader dots as colons."""
    return runs.groupBy("doc_id", *key).agg(dots_to_colon(joined_in_order(F.col("physical_index"), F.col("text"))).alias("toc_text"))


def page_pairs(by_page: DataFrame, by_index: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, ord, title, page, physical_index: every two items of the same title, null titles too.

    ``by_page`` has titles and logical pages, ``by_index`` titles and physical indexes, ``starts`` (doc_id, start_page) the
    least physical index of each document.  ``ord`` orders a document's pairs.
    """
    p = by_page.select("doc_id", F.col("title").alias("p_title"), "page", F.col("list_index").alias("p_ord"))
    x = by_index.where("physical_index is not null").select("doc_id", "title", "physical_index", F.col("list_index").alias("x_ord"))
    x = x.join(starts, "doc_id").where("physical_index >= start_page")
    pairs = x.join(p, (x["doc_id"] == p["doc_id"]) & x["title"].eqNullSafe(p["p_title"])).drop(p["doc_id"])
    return pairs.select("doc_id", F.struct("x_ord", "p_ord").alias("ord"), "title", "page", "physical_index")


def page_offsets(pairs: DataFrame) -> DataFrame:
    """doc_id, offset: the most frequent difference of physical index and page, of equal ones that seen first.

    Counted in two steps of map-side sums; null pages have no difference.
    """
    differences = pairs.where("page is not null").groupBy("doc_id", (F.col("physical_index") - F.col("page")).alias("offset")).agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "first", "offset"))
    return differences.groupBy("doc_id").agg(best.alias("best")).select("doc_id", "best.offset")


def with_offset(items: DataFrame, offsets: DataFrame) -> DataFrame:
    """``physical_index`` from the page where an item has one and its document an offset; ``page`` is then null."""
    joined = items.join(offsets, "doc_id", "left")
    given = F.col("page").isNotNull() & F.col("offset").isNotNull()
    index = F.when(given, F.col("page") + F.col("offset")).otherwise(F.col("physical_index"))
    return joined.withColumns({"physical_index": index, "page": F.when(~given, F.col("page"))}).drop("offset")


def neighbours(items: DataFrame) -> DataFrame:
    """``prev_index`` and ``next_index`` of items without an index: the nearest known ones, else 0 and -1."""
    before, after = _nearest(F.col("physical_index"))
    return items.withColumns({"prev_index": F.coalesce(before, F.lit(0)), "next_index": F.coalesce(after, F.lit(-1))}).where("physical_index is null")


def repair_ranges(items: DataFrame, wrong: DataFrame, counts: DataFrame, start_index: int = 1) -> DataFrame:
    """The wrong items with ``prev_correct`` and ``next_correct``, the nearest indexes of items that aren't wrong.

    ``wrong`` has doc_id and list_index, ``counts`` doc_id and n_pages.  Defaults are the page before the first and the last.
    """
    marked = items.join(wrong.select("doc_id", "list_index", F.lit(True).alias("is_wrong")).distinct(), ["doc_id", "list_index"], "left")
    before, after = _nearest(F.when(F.col("is_wrong").isNull(), F.col("physical_index")))
    ranged = marked.withColumns({"before": before, "after": after}).where("is_wrong").join(counts.select("doc_id", "n_pages"), "doc_id", "left")
    first, last = F.lit(start_index - 1), F.col("n_pages") + (start_index - 1)
    return ranged.withColumns({"prev_correct": F.coalesce("before", first), "next_correct": F.coalesce("after", last)}).drop("is_wrong", "before", "after", "n_pages")


def range_text(ranged: DataFrame, pages: DataFrame, first: str, last: str) -> DataFrame:
    """doc_id, list_index, content: the tagged pages of each item's range, those that are there."""
    listed = ranged.where(F.col(first) <= F.col(last)).select("doc_id", "list_index", F.explode(F.sequence(first, last)).alias("physical_index"))
    text = page_tag(F.col("physical_index"), F.col("text"), "\n\n")
    return listed.join(pages, ["doc_id", "physical_index"]).groupBy("doc_id", "list_index").agg(joined_in_order(F.col("physical_index"), text).alias("content"))


def with_page_text(items: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_text`` of each item's page; null where it has no index or the page is missing.

    ``page_squeezed``, the text as titles are compared with it, is made once for each page, not for each item.
    """
    texts = pages.select("doc_id", "physical_index", F.col("text").alias("page_text"), squeezed(F.col("text")).alias("page_squeezed"))
    return items.join(texts, ["doc_id", "physical_index"], "left")


def accuracy(verified: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, accuracy, n_wrong of ``verified`` (doc_id, list_index, physical_index, answer).

    Items without an index aren't checked.  A document whose last index is null or before the middle of its pages has
    accuracy 0 and nothing wrong, so that it isn't repaired.
    """
    checked = F.col("physical_index").isNotNull()
    last = F.max_by("physical_index", F.when(checked, F.col("list_index"))).alias("last_index")
    right = F.count(F.when(checked & (F.col("answer") == "yes"), 1))
    got = verified.groupBy("doc_id").agg(last, F.count(F.when(checked, 1)).alias("n"), right.alias("right"))
    early = F.col("last_index").isNull() | (F.col("last_index") < F.col("n_pages") / 2)
    share = F.when(early | (F.col("n") == 0), F.lit(0.0)).otherwise(F.col("right") / F.col("n"))
    return got.join(counts.select("doc_id", "n_pages"), "doc_id").select("doc_id", share.alias("accuracy"), F.when(early, 0).otherwise(F.col("n") - F.col("right")).cast("long").alias("n_wrong"))


def gate(accuracies: DataFrame) -> DataFrame:
    """``decision``: accept, repair or fall_back."""
    accept = (F.col("accuracy") == 1.0) & (F.col("n_wrong") == 0)
    repair = (F.col("accuracy") > 0.6) & (F.col("n_wrong") > 0)
    return accuracies.withColumn("decision", F.when(accept, "accept").when(repair, "repair").otherwise("fall_back"))


def merged_fixes(items: DataFrame, fixes: DataFrame) -> DataFrame:
    """``physical_index`` of ``fixes`` (doc_id, list_index, fixed_index, is_valid) where they are valid, and ``appear_start`` if both
    have it."""
    both = {"physical_index", "appear_start"} & {"physical_index", *fixes.columns} & set(items.columns)
    valid = fixes.where("is_valid").select("doc_id", "list_index", *[F.col("fixed_index" if c == "physical_index" else c).alias(f"fixed_{c}") for c in both])
    return items.join(valid, ["doc_id", "list_index"], "left").withColumns({c: F.coalesce(f"fixed_{c}", c) for c in both}).drop(*[f"fixed_{c}" for c in both])


def sampled(items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` items of each document at random, without replacement: those with the least digests of document, index and seed."""
    order = Window.partitionBy("doc_id").orderBy(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("list_index").cast("string"), F.lit(seed)).cast("binary")), "list_index")
    return items.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")
