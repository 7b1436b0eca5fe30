"""Folders of documents to node tables: one job for all files, with a row for what became of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Options, load
from ..config import reasoner as chosen_reasoner
from ..functions import base_name
from ..operators.batch import CONVERTIBLE, MARKDOWN, output_names
from ..reasoner import RuleReasoner
from ..sinks import append_events
from ..sources.convert import Converter, converted
from ..sources.files import Extractor, contents, folder, most_readable, pdf_pages, pdf_text
from ..staging import staged
from . import markdown, pages


#: What is called with a file's name and what has become of it.
Progress = Callable[[str, str], None]


def _told(files: DataFrame, status: Column, on_progress: Progress | None, events: str | None, seq: int) -> None:
    """Say of ``files`` (doc_id, ...) what has become of them: to a function, one after another, and as rows of a table."""
    said = files.select("doc_id", status.alias("status"))
    if events is not None:
        rows = said.select("doc_id", F.lit(seq).alias("seq"), F.current_timestamp().alias("ts"), F.when(F.col("status") == "failed", "error").otherwise("info").alias("level"), F.to_json(F.struct("status")).alias("payload"))
        append_events(rows, events)
    if on_progress is not None:
        for row in said.toLocalIterator():
            on_progress(row["doc_id"], row["status"])


def build(
    spark: SparkSession,
    path: str,
    options: Options | dict | None = None,
    reasoner: RuleReasoner | None = None,
    converter: Converter | None = None,
    extract: Extractor = pdf_text,
    on_progress: Progress | None = None,
    events: str | None = None,
    most_bytes: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, node_ord, node_id, title, ...) and runs (path, fmt, output, status, error, description) of a folder's files.

    PDF files go through pages, Markdown and what ``converter`` makes of other files through headings; without a converter
    convertible files are skipped.  Each format's files are read by a scan of their own, so that no other file is touched.  A file
    that can't be read, isn't UTF-8, or is larger than ``most_bytes`` or what the session reads whole, is a row of the runs and stops
    nothing else.  Files without a byte are not seen by Spark's sources, and have no row.

    As formats are done with, what has become of their files is said to ``on_progress``, and added to the table ``events``
    (doc_id, seq, ts, level, payload), which others can read or stream meanwhile: reading, then done, failed or skipped.
    """
    options = load(options)
    reasoner = reasoner or chosen_reasoner(options)
    text = ["text"] if options.if_add_node_text == "yes" else []
    most = most_readable(spark) if most_bytes is None else min(most_bytes, most_readable(spark))
    files = staged(output_names(folder(spark, path)).where("fmt <> 'unsupported'").withColumn("doc_id", base_name(F.col("path"))), "files")
    skipped = (F.col("fmt") == "docling") & F.lit(converter is None)
    over = F.when(F.col("length") > most, F.concat(F.lit(f"larger than {most} bytes: "), "length"))
    told = on_progress is not None or events is not None
    if told:
        _told(files, F.when(skipped, "skipped").when(over.isNotNull(), "failed").otherwise("reading"), on_progress, events, 0)

    def finished(fmt: str, failed: DataFrame, seq: int) -> None:
        if told:
            own = files.where(over.isNull() & ~skipped & (F.col("fmt") == fmt)).join(failed.select("doc_id", "error").distinct(), "doc_id", "left")
            _told(own, F.when(F.col("error").isNotNull(), "failed").otherwise("done"), on_progress, events, seq)

    content = F.col("content").cast("string")
    own = contents(spark, path, MARKDOWN, most).select("path", F.try_validate_utf8(content).alias("text"), F.when(F.try_validate_utf8(content).isNull(), "not UTF-8").alias("error"))
    made = own if converter is None else own.unionByName(converted(contents(spark, path, CONVERTIBLE, most), converter))
    made = staged(made.withColumn("doc_id", base_name(F.col("path"))), "markdown")
    md = markdown.build(made.where("text is not null").select("doc_id", "text"), options, reasoner).select("doc_id", "node_ord", "node_id", "title", "depth", "line_num", *text, *(["summary", "prefix_summary"] if options.if_add_node_summary == "yes" else []))
    md = staged(md, "markdown-nodes")
    finished("markdown", made.where("error is not null"), 1)
    finished("docling", made.where("error is not null"), 2)

    read = staged(pdf_pages(spark, path, extract, most), "pdf-pages")
    pdf = pages.build(read.where("error is null").select("doc_id", "physical_index", "text"), options, reasoner).select("doc_id", "node_ord", "node_id", "title", "depth", "start_index", "end_index", *text, *(["summary"] if options.if_add_node_summary == "yes" else []))
    nodes = staged(pdf.unionByName(md, allowMissingColumns=True), "nodes")
    finished("pdf", read.where("error is not null"), 3)

    failed = read.where("error is not null").select("doc_id", "error").unionByName(made.where("error is not null").select("doc_id", "error"))
    tried = files.join(failed.withColumnRenamed("error", "why"), "doc_id", "left").withColumn("error", F.when(~skipped, F.coalesce(over, "why")))
    status = F.when(skipped, "skipped").when(F.col("error").isNotNull(), "failed").otherwise("success")
    described = options.if_add_doc_description == "yes" and options.if_add_node_summary == "yes"
    said = staged(markdown.described(nodes, reasoner), "descriptions") if described else nodes.select("doc_id", F.lit(None).cast("string").alias("description")).limit(0)
    return nodes, tried.join(said, "doc_id", "left").select("path", "fmt", "output", status.alias("status"), "error", "description")
