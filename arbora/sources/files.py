"""Files as tables, read by Spark's own sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import base_name, preview, stem, title_or_untitled, token_count
from ..operators.batch import classified
from ..staging import staged
from . import pdf


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_id (the stem), text of whole Markdown files."""
    named = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # this path is encoded
    read = spark.read.text(path, wholetext=True).select(named.alias("path"), F.col("value").alias("text"))
    return read.select("path", stem(F.col("path")).alias("doc_id"), "text")


def markdown_lines(spark: SparkSession, path: str, doc_id: Column | None = None) -> DataFrame:
    """doc_id (the stem), line_num (from 1), line of Markdown files of any size; CR and CR LF end a line like LF.

    Spark cuts large files, and no task reads one whole.  Lines are written once with the part of a file that they come from and
    numbers that rise in it, and the parts' counts in order say how many lines come before.  ``doc_id`` makes a document's name
    of ``path``; files of the same one are its parts, in the order of their paths.  An empty file has no lines.
    """
    named = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    read = spark.read.text(path).select(named.alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    lines = staged(read.select((stem(F.col("path")) if doc_id is None else doc_id).alias("doc_id"), "path", "at", "id", "line"), "markdown-lines")
    parts = lines.groupBy("doc_id", "path", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("doc_id").orderBy("path", "at").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "markdown-parts")
    return lines.join(parts, ["doc_id", "path", "at"]).select("doc_id", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_num"), "line")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """path, length, fmt of the files of one folder, without those below it; contents are not read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length")
    return classified(read)


def most_readable(spark: SparkSession) -> int:
    """Bytes of the largest file that the session reads whole."""
    return int(spark.conf.get("spark.sql.sources.binaryFile.maxLength"))


def contents(spark: SparkSession, path: str, suffixes: list[str], most_bytes: int | None = None) -> DataFrame:
    """path, content of a folder's files with these suffixes, in either case, up to a size; nothing of other files is read."""
    either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix) for suffix in suffixes]
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*{" + ",".join(either) + "}").option("recursiveFileLookup", "false").load(path)
    return read.where(F.col("length") <= (most_readable(spark) if most_bytes is None else min(most_bytes, most_readable(spark)))).select("path", "content")


def repository(spark: SparkSession, path: str, repo_id: str) -> DataFrame:
    """repo_id, path (under the root) of all files below a root; contents are not read."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    root = path.rstrip("/").split("://", 1)[-1].split(":", 1)[-1]
    inside = F.expr("regexp_replace(path, '^[a-z0-9+.-]+:(//[^/]*)?', '')")
    return read.select(F.lit(repo_id).alias("repo_id"), F.substring(inside, F.lit(len("/" + root.strip("/")) + 2), F.length(inside)).alias("path"))


def file_texts(spark: SparkSession, path: str, repo_id: str, names: list[str]) -> DataFrame:
    """repo_id, path, text of the files below a root that have one of these names."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split("://", 1)[-1].split(":", 1)[-1]
    inside = F.expr("regexp_replace(path, '^[a-z0-9+.-]+:(//[^/]*)?', '')")
    chosen = read.where(base_name(F.col("path")).isin(names))
    return chosen.select(F.lit(repo_id).alias("repo_id"), F.substring(inside, F.lit(len("/" + root.strip("/")) + 2), F.length(inside)).alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))


def previews(texts: DataFrame, lines: int = 50, characters: int = 2000) -> DataFrame:
    return texts.withColumn("preview", preview(F.col("text"), lines, characters))


#: Files, and about as many bytes, that a task of PDF files takes in at a time, and pages that it hands on at a time.
BATCH_FILES, BATCH_BYTES, BATCH_PAGES = 256, 16 << 20, 1024


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to these; they stay so, since a plan reads them when it runs.  Smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_FILES), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


Extractor = Callable[[bytes], list[str]]


def pdf_text(content: bytes) -> list[str]:
    """The text of each page, by pypdf where that is installed, else by the reader here."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return pdf.read(content)[0]
    from io import BytesIO

    return [page.extract_text() or "" for page in PdfReader(BytesIO(content)).pages]


def pdf_title(content: bytes) -> str | None:
    return pdf.title_of(content)


def pages_of(files: DataFrame, extract: Extractor = pdf_text) -> DataFrame:
    """doc_id (the file name), physical_index, text, n_tokens of each page of ``files`` (path, content); error where one can't be
    read."""

    def pages(batches: Iterator) -> Iterator:
        import pandas as pd

        made = lambda rows: pd.DataFrame(rows, columns=["path", "physical_index", "text", "error"]).astype({"physical_index": "Int32"})
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(name, k + 1, text or "", None) for k, text in enumerate(extract(content))]
                except Exception as why:  # a file that can't be read is a row, not the end of the job
                    rows.append((name, None, None, f"{type(why).__name__}: {why}"))
                while len(rows) >= BATCH_PAGES:
                    yield made(rows[:BATCH_PAGES])
                    rows = rows[BATCH_PAGES:]
            yield made(rows)

    small_batches(files.sparkSession)
    got = files.select("path", "content").mapInPandas(pages, "path string, physical_index int, text string, error string")
    return got.select(base_name(F.col("path")).alias("doc_id"), "physical_index", "text", token_count(F.col("text")).alias("n_tokens"), "error")


def pdf_pages(spark: SparkSession, path: str, extract: Extractor = pdf_text, most_bytes: int | None = None) -> DataFrame:
    """The pages of a folder's PDF files, or of one file, as ``pages_of`` has them."""
    return pages_of(contents(spark, path, [".pdf"], most_bytes), extract)


def titles_of(files: DataFrame) -> DataFrame:
    """doc_id, title (Untitled without one) of ``files`` (path, content); a file that can't be read is untitled."""

    def titles(batches: Iterator) -> Iterator:
        import pandas as pd

        def title(content: bytes) -> str | None:
            try:
                return pdf_title(content)
            except Exception:
                return None

        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "title": [title(x) for x in batch["content"]]}).astype({"title": "string"})

    small_batches(files.sparkSession)
    got = files.select("path", "content").mapInPandas(titles, "path string, title string")
    return got.select(base_name(F.col("path")).alias("doc_id"), title_or_untitled(F.col("title")).alias("title"))


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.where("physical_index is not null").groupBy("doc_id").agg(F.count("*").alias("n_pages"))
