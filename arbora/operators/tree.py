"""Section trees as flat nodes: (doc_id, list_index) with ``parent`` a list_index, in list order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parent_code, shortened
from .common import joined_in_order



def _items() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("list_index")


def with_parents(items: DataFrame) -> DataFrame:
    """``parent``: the latest earlier item whose code is this one's without its last part; null without one.

    Items stand once under their own code and once under their parent's, and a running last value links the two, so that
    codes that repeat multiply nothing.
    """
    own = items.select("doc_id", "list_index", F.col("structure").cast("string").alias("code"), F.col("list_index").alias("defines"))
    asked = items.select("doc_id", "list_index", parent_code(F.col("structure").cast("string")).alias("code"), F.lit(None).cast("long").alias("defines")).where("code is not null")
    seen = Window.partitionBy("doc_id", "code").orderBy("list_index").rowsBetween(Window.unboundedPreceding, -1)
    found = own.unionByName(asked).withColumn("parent", F.last("defines", ignorenulls=True).over(seen)).where("defines is null and parent is not null")
    return items.join(found.select("doc_id", "list_index", "parent"), ["doc_id", "list_index"], "left")


def with_paths(nodes: DataFrame) -> DataFrame:
    """``path`` (list positions of a node's ancestors and itself) and ``depth``.

    One pass over each document's nodes in list order, in which parents come before their children; a parent that doesn't is
    none.  A path is its parent's with the node's own position, so the pass is as long as the paths are.  Built-in folds copy
    what they have gathered at each step, so this is done over Arrow batches, of which a document may have any number.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in nodes.columns])
    placed = nodes.select(F.col("doc_id").alias("doc"), F.col("list_index").cast("long").alias("k"), F.col("parent").cast("long").alias("parent"), row.alias("row"))
    placed = placed.repartition("doc").sortWithinPartitions("doc", "k")
    kinds = placed.select("row").schema.add("path", T.ArrayType(T.LongType()))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            paths = []
            for doc, k, parent in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if doc != now:
                    now, known = doc, {}
                paths.append([*known.get(parent, ()), k])
                known.setdefault(k, paths[-1])
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(paths, pa.list_(pa.int64()))], ["row", "path"])

    return placed.mapInArrow(follow, kinds).select("row.*", "path").withColumn("depth", F.size("path") - 1)


def with_node_ids(nodes: DataFrame) -> DataFrame:
    """``node_ord`` and ``node_id``: the place in pre-order from 0, the id with at least four digits."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    number = order.cast("string")
    return nodes.withColumns({"node_ord": order.cast("long"), "node_id": F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)})


def with_spans(items: DataFrame, ends: DataFrame) -> DataFrame:
    """``start_index`` and ``end_index``: up to the next item's page, or the one before it where the next begins its page.

    ``ends`` (doc_id, end_index) has where each document ends.
    """
    following, at_start = F.lead("physical_index").over(_items()), F.lead("appear_start").over(_items())
    last = F.lead("list_index").over(_items()).isNull()
    end = F.when(last, F.col("doc_end")).when(at_start == "yes", following - 1).otherwise(following)
    spanned = items.join(ends.select("doc_id", F.col("end_index").alias("doc_end")), "doc_id", "left")
    return spanned.select("*", F.col("physical_index").alias("start_index"), end.alias("end_index")).drop("doc_end")


def with_preface(items: DataFrame) -> DataFrame:
    """A first item ``Preface`` on page 1 in each document whose first item starts later."""
    first = F.row_number().over(_items()) == 1
    late = items.withColumn("first", first).where("first and physical_index > 1")
    given = {"structure": F.lit("0"), "title": F.lit("Preface"), "physical_index": F.lit(1), "list_index": F.col("list_index") - 1}
    row = [(given[c] if c in given else F.col(c) if c == "doc_id" else F.lit(None)).cast(t).alias(c) for c, t in items.dtypes]
    return items.unionByName(late.select(*row))


def truncated(items: DataFrame, counts: DataFrame, start_index: int = 1) -> DataFrame:
    """``physical_index`` is null where it is past the document's last page; ``counts`` has doc_id and n_pages."""
    last = F.col("n_pages") + (start_index - 1)
    index = F.when(F.col("physical_index") > last, None).otherwise(F.col("physical_index"))
    return items.join(counts.select("doc_id", "n_pages"), "doc_id", "left").withColumn("physical_index", index).drop("n_pages")


def with_index(items: DataFrame) -> DataFrame:
    return items.where("physical_index is not null")


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("list_index")).distinct()
    return nodes.join(parents, ["doc_id", "list_index"], "left_anti")


def is_leaf(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (doc_id, node_id) with ``is_leaf``: whether the first node with that id is there and has no children."""
    ranked = nodes.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "node_id").orderBy("node_ord"))).where("k = 1")
    found = leaves(nodes).select("doc_id", "list_index", F.lit(True).alias("leaf"))
    known = ranked.join(found, ["doc_id", "list_index"], "left").select("doc_id", "node_id", "leaf")
    return ids.join(known, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("leaf", F.lit(False)).alias("is_leaf"))


def without_below(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """``nodes`` (doc_id, path, ...) without those below one of ``cuts`` (doc_id, path).

    A node meets cuts by the paths of its ancestors, of which it has as many as it is deep.
    """
    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    cut = cuts.select("doc_id", F.col("path").alias("above")).distinct()
    below = nodes.where(F.size("path") > 1).select("doc_id", "path", F.explode(above).alias("above")).join(cut, ["doc_id", "above"], "left_semi")
    return nodes.join(below.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_anti")


def without(nodes: DataFrame, *fields: str) -> DataFrame:
    """Without these columns, those that are there."""
    return nodes.drop(*(fields or ("text",)))


def in_order(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The columns of ``order`` that are there, in that order; an empty order keeps all."""
    return nodes.select(*[c for c in order if c in nodes.columns]) if order else nodes


def description_view(nodes: DataFrame) -> DataFrame:
    return in_order(nodes, ["doc_id", "list_index", "parent", "node_ord", "title", "node_id", "summary", "prefix_summary"])


def toc_lines(nodes: DataFrame) -> DataFrame:
    """doc_id, node_ord, line: titles indented by depth."""
    return nodes.select("doc_id", "node_ord", F.concat(F.repeat(F.lit(" "), F.col("depth")), "title").alias("line"))


def limited(nodes: DataFrame, most_depth: int = 3) -> DataFrame:
    """Nodes up to a depth, with ``more`` where children are left out."""
    parents = nodes.where("parent is not null").select("doc_id", F.col("parent").alias("list_index"), F.lit(True).alias("inner")).distinct()
    shown = nodes.where(F.col("depth") <= most_depth).join(parents, ["doc_id", "list_index"], "left")
    return shown.withColumn("more", (F.col("depth") == most_depth) & F.coalesce("inner", F.lit(False))).drop("inner")


def drawn(nodes: DataFrame, most_depth: int = 3, label: Column | None = None) -> DataFrame:
    """doc_id, node_ord, line: the tree as lines of text up to a depth, with branches, and dots where children are left out.

    ``nodes`` has doc_id, node_ord (pre-order), depth and title.  Whether a node has a later sibling, and so a branch that goes on
    past its descendants, is told by the next node that isn't deeper: a running last value for each depth from the end.
    """
    later = Window.partitionBy("doc_id").orderBy(F.col("node_ord").desc()).rowsBetween(Window.unboundedPreceding, -1)
    next_of = [F.last(F.when(F.col("depth") <= d, F.col("depth")), ignorenulls=True).over(later) for d in range(most_depth + 1)]
    deeper = F.lead("depth").over(Window.partitionBy("doc_id").orderBy("node_ord")) > F.col("depth")
    placed = nodes.select("doc_id", "node_ord", "depth", (F.col("title") if label is None else label).alias("label"), F.array(*[F.coalesce(n == d, F.lit(False)) for d, n in enumerate(next_of)]).alias("goes_on"), F.coalesce(deeper, F.lit(False)).alias("inner"))
    shown = placed.where(F.col("depth") <= most_depth)
    stem_ = F.array_join(F.transform(F.slice("goes_on", F.lit(1), F.col("depth")), lambda g: F.when(g, F.lit("│   ")).otherwise(F.lit("    "))), "")
    branch = F.when(F.get("goes_on", F.col("depth")), F.lit("├── ")).otherwise(F.lit("└── "))
    more = F.when((F.col("depth") == most_depth) & F.col("inner"), F.lit(" ...")).otherwise(F.lit(""))
    return shown.select("doc_id", "node_ord", F.concat(stem_, branch, F.coalesce("label", F.lit("")), more).alias("line"))


def shortened_strings(nodes: DataFrame, most: int = 40) -> DataFrame:
    return nodes.select(*[shortened(F.col(c), most).alias(c) if t == "string" else F.col(c) for c, t in nodes.dtypes])


def as_json(nodes: DataFrame, fields: list[str], children: str = "nodes") -> DataFrame:
    """doc_id, json: each document's nested nodes, with ``fields`` of each and its children last if it has any.

    ``node_ord`` is pre-order: a node's text opens a list if the next node is deeper, and else closes as many as the next one
    is higher, so that the texts in order are the whole.  Fields that are null are left out.
    """
    own, order = F.to_json(F.struct(*fields)), Window.partitionBy("doc_id").orderBy("node_ord")
    following = F.lead("depth").over(order)
    opened = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.when(own == "{}", F.lit("")).otherwise(F.lit(",")), F.lit(f'"{children}":['))
    closed = F.concat(own, F.repeat(F.lit("]}"), F.col("depth") - F.coalesce(following, F.lit(0))), F.when(following.isNotNull(), F.lit(",")).otherwise(F.lit("")))
    texts = nodes.select("doc_id", "node_ord", F.when(following > F.col("depth"), opened).otherwise(closed).alias("text"))
    return texts.groupBy("doc_id").agg(F.concat(F.lit("["), joined_in_order(F.col("node_ord"), F.col("text")), F.lit("]")).alias("json"))
