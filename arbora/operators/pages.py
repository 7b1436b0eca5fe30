"""Pages of documents: (doc_id, physical_index from 1, text, n_tokens)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import counted_tokens, page_tag
from ..functions.text import Counter
from .common import joined_in_order


def with_tokens(pages: DataFrame, counter: Counter | None = None) -> DataFrame:
    return pages.withColumn("n_tokens", counted_tokens(F.col("text"), counter))


def tagged(pages: DataFrame, end: str = "\n") -> DataFrame:
    """``tagged``: each page's text between its tags."""
    return pages.withColumn("tagged", page_tag(F.col("physical_index"), F.col("text"), end))


def totals(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, n_tokens."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum("n_tokens").alias("n_tokens"))


def between(pages: DataFrame, start: int, end: int, with_tags: bool = False) -> DataFrame:
    """doc_id, text of the pages start to end, those that are there."""
    text = page_tag(F.col("physical_index"), F.col("text")) if with_tags else F.col("text")
    return pages.where(F.col("physical_index").between(start, end)).groupBy("doc_id").agg(joined_in_order(F.col("physical_index"), text).alias("text"))


def _paired(nodes: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """A row for each node and page of its span.  A span is exploded into page numbers, for an equality join in any size."""
    inside = (F.col("start_index") != 0) & (F.col("end_index") != 0) & (F.col("start_index") <= F.col("end_index"))
    counts = pages.groupBy("doc_id").agg(F.max("physical_index").alias("last_page"))
    spans = nodes.where(inside).select(*key, "start_index", "end_index").join(counts, "doc_id")
    first, last = F.greatest(F.col("start_index"), F.lit(1)), F.least(F.col("end_index"), F.col("last_page"))
    listed = spans.where(first <= last).select(*key, F.explode(F.sequence(first, last)).alias("physical_index"))
    return listed.join(pages, ["doc_id", "physical_index"])


def with_text(nodes: DataFrame, pages: DataFrame, with_tags: bool = False, key: tuple[str, ...] = ("doc_id", "list_index"), most: int | None = None) -> DataFrame:
    """``text`` of the pages of each node's span; null where the node has no start or end, empty where it ends before it starts.

    With ``most`` its first characters, of which no page holds more than as many.
    """
    if most is not None:
        pages = pages.select("doc_id", "physical_index", F.substring("text", 1, most).alias("text"))
    text = page_tag(F.col("physical_index"), F.col("text")) if with_tags else F.col("text")
    texts = _paired(nodes, pages, list(key)).groupBy(*key).agg(joined_in_order(F.col("physical_index"), text).alias("text"))
    if most is not None:
        texts = texts.withColumn("text", F.substring("text", 1, most))
    given = F.coalesce(F.col("start_index"), F.lit(0)) * F.coalesce(F.col("end_index"), F.lit(0)) != 0
    return nodes.join(texts, list(key), "left").withColumn("text", F.when(given, F.coalesce("text", F.lit(""))))


def with_span_tokens(nodes: DataFrame, pages: DataFrame, key: tuple[str, ...] = ("doc_id", "list_index")) -> DataFrame:
    """``span_tokens``: tokens of the pages of each node's span.

    Pages are summed up once; a span's tokens are the sum up to its end less that before its start.  Both are met as points in the
    order of the pages, as the running last sum, so that pages may be missing and no span is listed page by page.
    """
    names = list(key)
    given = nodes.where((F.col("start_index") != 0) & (F.col("end_index") != 0) & (F.col("start_index") <= F.col("end_index")))
    ends = F.array(F.struct((F.greatest(F.col("start_index"), F.lit(1)) - 1).cast("long").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("end_index").cast("long").alias("at"), F.lit(1).alias("sign")))
    points = given.select(*names, F.explode(ends).alias("p")).select("doc_id", F.col("p.at").alias("at"), F.struct(*[F.col(n).alias(f"k{i}") for i, n in enumerate(names)], F.col("p.sign").alias("sign")).alias("point"), F.lit(None).cast("long").alias("n_tokens"))
    summed = pages.where("physical_index >= 1").groupBy("doc_id", F.col("physical_index").cast("long").alias("at")).agg(F.sum("n_tokens").cast("long").alias("n_tokens"))
    rows = summed.select("doc_id", "at", F.lit(None).cast(points.schema["point"].dataType).alias("point"), "n_tokens").unionByName(points)
    upto = F.sum("n_tokens").over(Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))
    met = rows.withColumn("upto", F.coalesce(upto, F.lit(0))).where("point is not null")
    sums = met.groupBy(*[F.col(f"point.k{i}").alias(n) for i, n in enumerate(names)]).agg(F.sum(F.col("point.sign") * F.col("upto")).alias("span_tokens"))
    return nodes.join(sums, names, "left").withColumn("span_tokens", F.coalesce("span_tokens", F.lit(0)))


def large(nodes: DataFrame, pages: DataFrame, most_pages: int, most_tokens: int) -> DataFrame:
    """Nodes whose span is more than ``most_pages`` apart and holds ``most_tokens`` or more."""
    apart = F.col("end_index") - F.col("start_index") > most_pages
    return with_span_tokens(nodes.where(apart), pages).where(F.col("span_tokens") >= most_tokens)


def groups(pages: DataFrame, most_tokens: int = 20_000, overlap: int = 1) -> DataFrame:
    """doc_id, group_no, first_pi, last_pi: runs of pages of about the same number of tokens.

    A document of at most ``most_tokens`` is one group.  Others are filled up to the mean of ``most_tokens`` and an even
    share, and each group begins with the last ``overlap`` pages of the one before.  A first page that is too large leaves an
    empty group (last_pi = first_pi - 1) before it.  One pass over each document's pages in order, of which the last
    ``overlap`` and a few numbers are held.
    """
    whole, order = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("physical_index")
    total = F.sum("n_tokens").over(whole)
    parts = F.greatest(F.ceil(total / F.lit(most_tokens)), F.lit(1))
    target = F.when(total > most_tokens, F.ceil((total / parts + F.lit(most_tokens)) / 2)).cast("long")
    rows = pages.select("doc_id", "physical_index", "n_tokens").withColumn("target", target)
    rows = rows.select("doc_id", F.col("physical_index").cast("long").alias("at"), F.col("n_tokens").cast("long").alias("n_tokens"), "target", F.row_number().over(order).alias("k"))
    kinds = T.StructType([rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("group_no", "first_pi", "last_pi")]])
    page = pages.schema["physical_index"].dataType
    made = rows.mapInArrow(partial(_filled, overlap), kinds)
    return made.select("doc_id", "group_no", F.col("first_pi").cast(page).alias("first_pi"), F.col("last_pi").cast(page).alias("last_pi"))


@dataclass
class _Group:
    """What is known of a document's groups after some of its pages, which are counted from 0."""

    doc: object
    number: int = 0
    first: int = 0  # page that the group begins with
    first_pi: int = 0
    at: int = 0  # pages so far
    held: int = 0  # tokens of the group
    late: deque = field(default_factory=deque)  # tokens and numbers of the last pages


def _filled(overlap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Group | None = None
    for batch in batches:
        out: list[tuple] = []
        for doc, at, tokens, target, k in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
            if k == 1:
                if now is not None:
                    out.append(_ended(now))
                now = _Group(doc, first_pi=at)
            tokens = tokens or 0
            if target is not None and now.held + tokens > target:
                out.append(_ended(now))
                seeded = list(now.late)[-overlap:] if overlap else []
                now.number, now.first, now.held = now.number + 1, now.at - len(seeded), sum(n for n, _ in seeded)
                now.first_pi = seeded[0][1] if seeded else at
            now.at, now.held = now.at + 1, now.held + tokens
            now.late.append((tokens, at))
            if len(now.late) > overlap:
                now.late.popleft()
        if out:
            yield _group_rows(batch, out)
    if now is not None:
        yield _group_rows(batch, [_ended(now)])


def _ended(group: _Group) -> tuple:
    return group.doc, group.number, group.first_pi, group.first_pi + group.at - 1 - group.first


def _group_rows(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "group_no", "first_pi", "last_pi"])


def grouped_text(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """``groups`` with the tagged text of their pages."""
    spans = groups.withColumnsRenamed({"first_pi": "start_index", "last_pi": "end_index"})
    made = with_text(spans, pages, with_tags=True, key=("doc_id", "group_no")).withColumn("text", F.coalesce("text", F.lit("")))
    return made.withColumnsRenamed({"start_index": "first_pi", "end_index": "last_pi"})
