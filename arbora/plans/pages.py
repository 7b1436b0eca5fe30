"""Page-oriented documents to section trees.

A document's sections come from its table of contents with page numbers, from one without, or from its pages alone, in that
order: what a way finds is verified against the pages, repaired if most of it is right, and else the next way is tried, for
those documents only.  All documents go through each step together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Options, load
from ..config import reasoner as chosen_reasoner
from ..config import token_counter
from ..operators import pages as pg
from ..operators import titles, toc, tree
from ..reasoner import RuleReasoner
from ..staging import staged

REPAIRS = 3
ITEM = ["doc_id", "list_index", "structure", "title", "physical_index"]
#: With ``appear_start``, null where it is asked for later.
STARTED = [*ITEM, "appear_start"]
ITEM_TYPES = "doc_id {0}, list_index long, structure string, title string, page int"


def _exploded(tocs: DataFrame) -> DataFrame:
    return tocs.select("doc_id", F.posexplode("items").alias("k", "i")).select("doc_id", F.col("k").cast("long").alias("list_index"), "i.structure", "i.title", "i.page")


def _after_toc(pages: DataFrame, after: DataFrame, most: int | None = None) -> DataFrame:
    """The pages after each document's table of contents, ``most`` of them at most."""
    window = pages.join(after, "doc_id").where(F.col("physical_index") > F.col("last_page"))
    return (window if most is None else window.where(F.col("physical_index") <= F.col("last_page") + most)).drop("last_page")


def by_numbers(items: DataFrame, searched: DataFrame, after: DataFrame, options: Options, reasoner: RuleReasoner) -> DataFrame:
    """Items with pages: some are found after the table of contents, and the usual difference serves for all."""
    found = reasoner.placed(items, _after_toc(searched, after, options.toc_check_page_num))
    starts = after.select("doc_id", F.col("last_page").alias("start_page"))
    offsets = toc.page_offsets(toc.page_pairs(items, found, starts))
    placed = toc.with_offset(found.withColumn("physical_index", F.lit(None).cast("int")), offsets)
    placed = staged(placed.select(*ITEM), "placed")
    found = reasoner.gaps_filled(placed, searched)
    return toc.merged_fixes(placed, found.withColumn("is_valid", F.lit(True))).select(*ITEM)


def verified(items: DataFrame, pages: DataFrame, reasoner: RuleReasoner, searched: DataFrame | None = None) -> DataFrame:
    """``answer`` and, where it costs nothing more, ``appear_start``, else null."""
    if reasoner.indexed and searched is not None:
        return titles.judged(items, searched)
    rows = reasoner.title_appears(toc.with_page_text(items, pages))
    started = reasoner.title_starts(rows) if reasoner.indexed else rows.withColumn("appear_start", F.lit(None).cast("string"))
    return started.drop("page_text", "page_squeezed")


def repaired(items: DataFrame, wrong: DataFrame, pages: DataFrame, counts: DataFrame, reasoner: RuleReasoner, searched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with one round of repairs, and those that are still wrong; ``searched`` is what the reasoner looks for their titles in."""
    ranged = toc.repair_ranges(items, wrong, counts)
    located = reasoner.locate(ranged, searched, "prev_correct", "next_correct").select("doc_id", "list_index", "title", "fixed_index")
    again = verified(located.withColumn("physical_index", F.col("fixed_index")), pages, reasoner, searched)
    fixes = staged(again.select("doc_id", "list_index", "fixed_index", (F.col("answer") == "yes").alias("is_valid"), "appear_start"), "fixes")
    return staged(toc.merged_fixes(items, fixes), "repaired"), fixes.where("not is_valid").select("doc_id", "list_index")


def accepted(items: DataFrame, pages: DataFrame, counts: DataFrame, reasoner: RuleReasoner, searched: DataFrame | None = None) -> DataFrame:
    """The items of documents whose items are right, or mostly and have been repaired, with ``appear_start``.

    ``searched`` is what the reasoner looks for titles in, if that is known.  Items that come with an ``answer`` aren't checked again.
    """
    known = [c for c in ("answer", "appear_start") if c in items.columns]
    checked = staged(tree.truncated(tree.with_index(items), counts).select(*ITEM, *known), "items")
    if not known:
        checked = staged(verified(checked, pages, reasoner, searched), "verified")
    items = checked.select(*STARTED)
    decided = staged(toc.gate(toc.accuracy(checked, counts)), "decided")
    good = items.join(decided.where("decision = 'accept'").select("doc_id"), "doc_id", "left_semi")
    mending = items.join(decided.where("decision = 'repair'").select("doc_id"), "doc_id", "left_semi")
    wrong = checked.where("physical_index is not null and answer <> 'yes'").join(decided.where("decision = 'repair'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "list_index")
    own = None
    for _ in range(REPAIRS):
        if wrong.isEmpty():
            break
        if own is None:
            asked = items.join(wrong, ["doc_id", "list_index"], "left_semi")
            if reasoner.indexed and searched is not None:
                own = staged(titles.of_titles(searched, asked), "finds")
            else:
                own = reasoner.searchable(asked, pages.join(decided.where("decision = 'repair'").select("doc_id"), "doc_id", "left_semi"))
        mending, wrong = repaired(mending, wrong, pages, counts, reasoner, own)
    return good.unionByName(mending)


def sections(pages: DataFrame, options: Options | dict | None = None, reasoner: RuleReasoner | None = None) -> DataFrame:
    """Items of each document: doc_id, list_index, structure, title, physical_index.  Documents for which no way works have none."""
    options = load(options)
    return _sections(pages, options, reasoner or chosen_reasoner(options)).select(*ITEM)


def _sections(pages: DataFrame, options: Options, reasoner: RuleReasoner) -> DataFrame:
    """``sections`` with ``appear_start``.

    Titles of contents are looked for once, on all pages; what is found serves to place, to fill gaps, to verify and to repair.
    """
    counts = staged(pg.totals(pages), "counts")
    near = reasoner.toc_pages(pages.where(F.col("physical_index") <= options.toc_check_page_num))
    hit = near.where("is_toc = 'yes'").select("doc_id").distinct()
    rest = reasoner.toc_pages(pages.where(F.col("physical_index") > options.toc_check_page_num).join(hit, "doc_id", "left_semi"))
    runs = staged(toc.all_runs(near.unionByName(rest), options.toc_check_page_num), "toc-runs")
    tocs = staged(toc.chosen_runs(reasoner.has_numbers(toc.toc_text(runs, "run"))), "tocs")
    after = toc.last_pages(runs.join(tocs.select("doc_id", "run"), ["doc_id", "run"], "left_semi"))
    listed = staged(_exploded(reasoner.toc_items(tocs.where("numbered = 'yes'"))), "toc-items")

    if listed.isEmpty():  # no document has a table of contents with pages
        return staged(accepted(reasoner.outline(pages), pages, counts, reasoner), "sections")
    searched = reasoner.searchable(listed, pages)
    done = accepted(by_numbers(listed, searched, after, options, reasoner), pages, counts, reasoner, searched)
    done = staged(done, "by-numbers")
    left = listed.join(done.select("doc_id").distinct(), "doc_id", "left_anti")
    plain = staged(accepted(reasoner.placed(left.drop("page"), _after_toc(searched, after)).select(*ITEM), pages, counts, reasoner, searched), "by-titles")
    done = done.unionByName(plain)
    alone = reasoner.headed(pages).join(done.select("doc_id").distinct().withColumn("has", F.lit(True)), "doc_id", "left").where("has is null").drop("has")
    return staged(done.unionByName(accepted(reasoner.outline(alone), pages, counts, reasoner)), "sections")


def with_starts(items: DataFrame, pages: DataFrame, reasoner: RuleReasoner) -> DataFrame:
    """``appear_start``; no where an item has no index.  With rules items come with it."""
    if reasoner.indexed:
        return items
    return reasoner.title_starts(toc.with_page_text(items.drop("appear_start"), pages)).drop("page_text", "page_squeezed")


def _child_path(parent: Column) -> Column:
    return F.concat(parent, F.array(F.col("list_index")))


def split_large(nodes: DataFrame, pages: DataFrame, options: Options, reasoner: RuleReasoner) -> DataFrame:
    """``nodes`` (doc_id, path, title, start_index, end_index), those with too many pages and tokens split by their pages.

    A split node loses the children it had; a first section with the node's own title is dropped, and the node ends where
    the first of the rest begins.  What is split off is looked at again if it has fewer pages than its
    parent, until nothing is.
    """
    frontier, heads = nodes, None
    while True:
        keyed = frontier.withColumn("list_index", F.col("path"))
        big = staged(pg.large(keyed, pages, options.max_page_num_each_node, options.max_token_num_each_node).select("doc_id", F.col("path").alias("parent_path"), F.col("title").alias("own"), "start_index", "end_index"), "large")
        if big.isEmpty():
            break
        # A node stands for a document of its own, so that the steps above work on each by itself.
        part = F.struct("doc_id", "parent_path")
        spans = big.where(F.col("start_index") <= F.col("end_index")).select("doc_id", "parent_path", F.explode(F.sequence("start_index", "end_index")).alias("physical_index"))
        heads = heads or staged(reasoner.headed(pages), "heads")
        inside = spans.join(heads, ["doc_id", "physical_index"])
        inside = staged(inside.select(part.alias("part"), *[c for c in heads.columns if c != "doc_id"]).withColumnRenamed("part", "doc_id"), "parts")
        counts = inside.groupBy("doc_id").agg(F.max("physical_index").alias("n_pages"))
        items = with_starts(accepted(reasoner.outline(inside), inside, counts, reasoner), inside, reasoner)
        ends = big.select(part.alias("doc_id"), "end_index", "own")
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("list_index")) == 1
        rest = tree.with_index(items).withColumn("first", first).join(ends.drop("end_index"), "doc_id").where(~(F.col("first") & (F.trim("title") == F.trim("own"))))
        rest = staged(tree.with_spans(rest, ends.drop("own")), "split")
        begins = rest.groupBy("doc_id").agg(F.min_by("start_index", "list_index").alias("begins")).select("doc_id.*", "begins")
        children = rest.select("doc_id.doc_id", _child_path(F.col("doc_id.parent_path")).alias("path"), "title", "start_index", "end_index")
        whole = big.select("doc_id", "parent_path", F.col("start_index").alias("from_page"), F.col("end_index").alias("to_page"))
        smaller = (F.col("start_index") > F.col("from_page")) | (F.col("end_index") < F.col("to_page"))
        again = children.withColumn("parent_path", F.slice("path", F.lit(1), F.size("path") - 1)).join(whole, ["doc_id", "parent_path"]).where(smaller).select(children.columns)
        kept = tree.without_below(nodes, big.select("doc_id", F.col("parent_path").alias("path"))).join(begins.withColumnRenamed("parent_path", "path"), ["doc_id", "path"], "left")
        kept = kept.withColumn("end_index", F.coalesce("begins", "end_index")).drop("begins")
        nodes, frontier = staged(kept.unionByName(children), "nodes"), staged(again, "frontier")
    return nodes


def build(pages: DataFrame, options: Options | dict | None = None, reasoner: RuleReasoner | None = None) -> DataFrame:
    """``pages`` (doc_id, physical_index, text) as nodes: doc_id, path, node_ord, node_id, depth, title, start_index,
    end_index, is_leaf, text and summary as asked for."""
    options = load(options)
    reasoner = reasoner or chosen_reasoner(options)
    pages = staged(pg.with_tokens(pages, token_counter(options)), "pages")
    counts = pg.totals(pages)
    items = with_starts(tree.with_preface(_sections(pages, options, reasoner)), pages, reasoner)  # nothing ends by where a preface starts
    spanned = tree.with_spans(tree.with_index(items), counts.select("doc_id", F.col("n_pages").alias("end_index")))
    flat = staged(tree.with_paths(tree.with_parents(spanned)).select("doc_id", "path", "title", "start_index", "end_index"), "flat")
    nodes = tree.with_node_ids(split_large(flat, pages, options, reasoner)).withColumn("depth", F.size("path") - 1)
    deeper = F.lead("depth").over(Window.partitionBy("doc_id").orderBy("path")) > F.col("depth")
    nodes = nodes.withColumn("is_leaf", ~F.coalesce(deeper, F.lit(False)))
    if options.if_add_node_text == "yes" or options.if_add_node_summary == "yes":
        nodes = pg.with_text(nodes, pages, key=("doc_id", "path"), most=None if options.if_add_node_text == "yes" else reasoner.summary_reads)
    if options.if_add_node_summary == "yes":
        nodes = reasoner.summary(nodes, "text", "summary")
    return nodes if options.if_add_node_text == "yes" else nodes.drop("text")


class Indexer:
    """Options and a reasoner, for one set of pages after another."""

    def __init__(self, options: Options | dict | None = None, reasoner: RuleReasoner | None = None):
        self.options = load(options)
        self.reasoner = reasoner or chosen_reasoner(self.options)

    def process(self, pages: DataFrame) -> DataFrame:
        return build(pages, self.options, self.reasoner)
