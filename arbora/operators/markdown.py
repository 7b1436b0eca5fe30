"""Markdown documents as lines, sections and section trees.

Every step partitions by ``doc_id`` alone, so a document's lines are shuffled once.  A section's parent and the end of its
subtree come from windows with one running value for each of the six heading levels, not from joins of sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import counted_tokens, header_level, header_title, strip, token_count
from ..functions.text import Counter
from .common import joined_in_order

LEVELS = range(1, 7)
#: Lines that are gone through in one piece where a document may have any number.
BLOCK_LINES = 8192


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_num (from 1), line of ``docs`` (doc_id, text); CR and CR LF end a line like LF."""
    whole = F.regexp_replace("text", "\r\n?", "\n")
    return docs.select("doc_id", F.posexplode(F.split(whole, "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_num"), "line")


def headers(lines: DataFrame) -> DataFrame:
    """The lines with ``level`` and ``title``, null where a line is no header; headers inside fences are none."""
    stripped = strip(F.col("line"))
    fence = F.startswith(stripped, F.lit("```"))
    fences = F.sum(fence.cast("int")).over(_doc().orderBy("line_num"))
    header = ~fence & (fences % 2 == 0)
    return lines.select("*", F.when(header, header_level(stripped)).cast("int").alias("level"), F.when(header & header_level(stripped).isNotNull(), header_title(stripped)).alias("title"))


def sections(lines: DataFrame, counter: Counter | None = None) -> DataFrame:
    """doc_id, ord (from 0), level, title, line_num, text, n_tokens of each section.

    A header that is indented starts no section, and its lines stay in the section before.  Lines before the first section
    belong to none.
    """
    marked = headers(lines).withColumn("starts", F.col("title").isNotNull() & F.startswith("line", F.lit("#")))
    numbered = marked.withColumn("ord", F.sum(F.col("starts").cast("int")).over(_doc().orderBy("line_num")) - 1).where("ord >= 0")
    return _joined(numbered, counter)


def sections_of_long(lines: DataFrame, counter: Counter | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """As ``sections``, for documents of any number of lines, none of which goes through one task whole.

    A document is cut into blocks of lines.  Each block is counted as if it began outside a fence and as if inside one; the
    blocks' counts in order, a narrow table, say which holds and how many sections come before.
    """
    stripped, block = strip(F.col("line")), F.floor((F.col("line_num") - 1) / F.lit(block_lines)).cast("long")
    fence, level = F.startswith(stripped, F.lit("```")), header_level(stripped)
    header = F.coalesce(~fence & level.isNotNull() & F.startswith("line", F.lit("#")), F.lit(False))
    marked = lines.select("doc_id", "line_num", "line", block.alias("block"), F.coalesce(fence, F.lit(False)).cast("int").alias("fence"), header.alias("header"))
    order = Window.partitionBy("doc_id", "block").orderBy("line_num")
    inside = F.sum("fence").over(order)
    counted = marked.drop("line").withColumn("odd", inside % 2 == 1).groupBy("doc_id", "block")
    counted = counted.agg(F.sum("fence").alias("fences"), *[F.count(F.when(F.col("header") & (F.col("odd") == odd), 1)).alias(c) for c, odd in (("outside", False), ("within", True))])
    before = _doc().orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    turned = counted.withColumn("turned", F.coalesce(F.sum("fences").over(before), F.lit(0)) % 2)
    ran = turned.withColumn("ran", F.coalesce(F.sum(F.when(F.col("turned") == 0, F.col("outside")).otherwise(F.col("within"))).over(before), F.lit(0)))
    placed = marked.join(ran.select("doc_id", "block", "turned", "ran"), ["doc_id", "block"])
    placed = placed.withColumn("starts", F.col("header") & ((F.col("turned") + inside) % 2 == 0))
    numbered = placed.withColumn("ord", F.col("ran") + F.sum(F.col("starts").cast("int")).over(order) - 1).where("ord >= 0")
    return _joined(numbered.withColumn("title", F.when(F.col("starts"), header_title(strip(F.col("line"))))), counter)


def _joined(numbered: DataFrame, counter: Counter | None) -> DataFrame:
    """The sections of lines with ``starts``, ``title`` and ``ord``."""
    first = lambda c: F.max(F.when(F.col("starts"), F.col(c))).alias(c)
    text = strip(joined_in_order(F.col("line_num"), F.col("line"), "\n")).alias("text")
    level = F.max(F.when(F.col("starts"), F.length(F.regexp_extract("line", "^(#{1,6})", 1)))).cast("int").alias("level")
    return numbered.groupBy("doc_id", F.col("ord").cast("long").alias("ord")).agg(level, first("title"), first("line_num"), text).withColumn("n_tokens", counted_tokens(F.col("text"), counter))


def _last_of() -> Column:
    """For each level the last section before that has it."""
    before = _doc().orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return F.array(*[F.last(F.when(F.col("level") == k, F.col("ord")), ignorenulls=True).over(before) for k in LEVELS])


def with_parents(sections: DataFrame) -> DataFrame:
    """``parent_ord``: the nearest section before with a smaller level; null for a root."""
    with_last = sections.withColumn("last_of", _last_of())
    return with_last.withColumn("parent_ord", F.array_max(F.slice("last_of", 1, F.col("level") - 1))).drop("last_of")


def with_depth(sections: DataFrame) -> DataFrame:
    """``depth``: how many ancestors a section has.

    The last section of a smaller level is one, unless a section of a level smaller still came after it.
    """
    with_last = sections.withColumn("last_of", _last_of())
    open_ = [(F.get("last_of", F.lit(k - 1)) > F.coalesce(F.array_max(F.slice("last_of", 1, k - 1)), F.lit(-1))) & (F.col("level") > k) for k in LEVELS]
    return with_last.withColumn("depth", sum((F.coalesce(x, F.lit(False)).cast("int") for x in open_), F.lit(0))).drop("last_of")


def with_node_ids(sections: DataFrame, first: int = 1) -> DataFrame:
    """``node_id``: the place in list order, which is pre-order, with at least four digits."""
    number = (F.col("ord") + first).cast("string")
    return sections.withColumn("node_id", F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))


def _next_of(value: Column) -> Column:
    """For each level the ``value`` of the first section after this one that is of it or a smaller one: a running last value from
    the document's end, since a frame that only loses rows would be evaluated anew for each."""
    after = _doc().orderBy(F.col("ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return F.array(*[F.last(F.when(F.col("level") <= k, value), ignorenulls=True).over(after) for k in LEVELS])


def with_subtree_end(sections: DataFrame) -> DataFrame:
    """``subtree_end``: the ord after the section's last descendant."""
    ends = sections.select("*", _next_of(F.col("ord")).alias("next_of"), F.count("*").over(_doc()).alias("sections_of"))
    return ends.withColumn("subtree_end", F.coalesce(F.get("next_of", F.col("level") - 1), F.col("sections_of"))).drop("next_of", "sections_of")


def with_subtree_tokens(sections: DataFrame) -> DataFrame:
    """``subtree_end``, and ``subtree_tokens`` of a section's text and those of its descendants, joined by line breaks.

    Running sums of lengths make it a difference of two rows, of which the later one comes with the subtree's end; no text is
    built and nothing is joined.
    """
    before = _doc().orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    length, some = F.length("text").cast("long"), (F.length("text") > 0).cast("long")
    sums = lambda x, over: F.coalesce(F.sum(x).over(over), F.lit(0).cast("long"))
    place = F.struct("ord", sums(length, before).alias("ran"), sums(some, before).alias("some"))
    whole = F.struct(F.count("*").over(_doc()).alias("ord"), sums(length, _doc()).alias("ran"), sums(some, _doc()).alias("some"))
    placed = sections.select("*", place.alias("from"), whole.alias("whole"))
    ended = placed.withColumn("to", F.coalesce(F.get(_next_of(F.col("from")), F.col("level") - 1), F.col("whole")))
    below = F.col("to.some") - F.col("from.some") - some
    characters = F.col("to.ran") - F.col("from.ran") + below
    return ended.withColumns({"subtree_end": F.col("to.ord"), "subtree_tokens": F.shiftright(characters, 2).cast("long")}).drop("from", "whole", "to")


def thinned(sections: DataFrame, least_tokens: int) -> DataFrame:
    """Sections with fewer subtree tokens than ``least_tokens`` take in all their descendants.

    A section goes if any ancestor has too few; the survivor's text is its own and theirs with blank lines between, and
    ``subtree_tokens`` is counted anew.
    """
    counted = with_subtree_tokens(sections)
    order = _doc().orderBy("ord")
    reach = F.max(F.when(F.col("subtree_tokens") < least_tokens, F.col("subtree_end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = counted.withColumn("stays", ~F.coalesce(reach > F.col("ord"), F.lit(False)))
    of = F.last(F.when(F.col("stays"), F.col("ord")), ignorenulls=True).over(order)
    kept = lambda c: F.max(F.when(F.col("stays"), F.col(c))).alias(c)
    text = joined_in_order(F.col("ord"), F.when(F.col("stays") | (F.length("text") > 0), F.col("text")), "\n\n")
    merged = marked.withColumn("of", of).groupBy("doc_id", "of").agg(*[kept(c) for c in ("level", "title", "line_num", "subtree_tokens")], text.alias("text"), F.count("*").alias("n"))
    tokens = F.when(F.col("n") > 1, token_count(F.col("text"))).otherwise(F.col("subtree_tokens"))
    again = F.row_number().over(_doc().orderBy("of")) - 1
    return merged.select("doc_id", again.cast("long").alias("ord"), "level", "title", "line_num", "text", token_count(F.col("text")).alias("n_tokens"), tokens.alias("subtree_tokens"))


def with_leaves(sections: DataFrame) -> DataFrame:
    """``is_leaf``: the next section isn't deeper."""
    following = F.lead("level").over(_doc().orderBy("ord"))
    return sections.withColumn("is_leaf", ~F.coalesce(following > F.col("level"), F.lit(False)))


def outline(sections: DataFrame) -> DataFrame:
    """doc_id, ord, line: titles indented by depth."""
    return with_depth(sections).select("doc_id", "ord", F.concat(F.repeat(F.lit(" "), F.col("depth")), "title").alias("line"))
