"""Folders of documents: what each file is, and what became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stem, suffix

# Suffixes by what is done with them.
PDF = [".pdf"]
MARKDOWN = [".md", ".markdown"]
CONVERTIBLE = [".docx", ".pptx", ".xlsx", ".html", ".htm", ".png", ".jpg", ".jpeg", ".tiff", ".bmp"]
STATUSES = ["success", "failed", "skipped"]


def kind(path: Column) -> Column:
    end = suffix(path)
    return F.when(end.isin(PDF), "pdf").when(end.isin(MARKDOWN), "markdown").when(end.isin(CONVERTIBLE), "docling").otherwise("unsupported")


def classified(files: DataFrame) -> DataFrame:
    """Files (path) with ``fmt``."""
    return files.withColumn("fmt", kind(F.col("path")))


def counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("fmt").agg(F.count("*").alias("n"))


def output_names(files: DataFrame) -> DataFrame:
    """``output``: the file's stem and format, so that files which differ in suffix only don't overwrite each other."""
    return files.withColumn("output", F.concat(stem(F.col("path")), F.lit("_"), F.regexp_replace(suffix(F.col("path")), r"^\.", ""), F.lit("_structure.json")))


def statistics(runs: DataFrame) -> DataFrame:
    """total, success, failed, skipped of ``runs`` (fmt, status); unsupported files are in none of them."""
    tried = runs.where("fmt <> 'unsupported'")
    return tried.agg(F.count("*").alias("total"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES])
