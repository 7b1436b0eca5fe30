"""Indexing documents as they arrive, by file streams.

A micro-batch is indexed like a table of documents.  Documents that were seen before with the same content are left out by
a stateful operator with a bounded horizon, and each micro-batch writes its own folder, so that a batch which is run again
after a failure replaces what it wrote and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import markdown

SCHEMA = "doc_id long, text string, arrived timestamp"


def arriving(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """A stream of documents from Parquet files that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def changed(docs: DataFrame, horizon: str = "1 day") -> DataFrame:
    """Documents whose content was not seen within ``horizon``; what is older is forgotten, and so is its state."""
    keyed = docs.withColumn("content", F.sha2(F.coalesce("text", F.lit("")), 256)).withWatermark("arrived", horizon)
    return keyed.dropDuplicatesWithinWatermark(["doc_id", "content"])


def indexed(docs: DataFrame, out: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] = markdown.build, once: bool = True) -> StreamingQuery:
    """Index each micro-batch into ``out/batch=<n>``.  Of a document that comes twice in a batch the last stays."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("doc_id").agg(F.max_by("text", "arrived").alias("text"))
        build(latest).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The nodes of each document's last batch."""
    nodes = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    last = nodes.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return nodes.join(last, ["doc_id", "batch"], "left_semi")


def arrivals(docs: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Documents and tokens for each window of arrival; rows later than ``late`` are left out of their window."""
    tokens = F.shiftright(F.length(F.coalesce("text", F.lit(""))), 2)
    grouped = docs.withWatermark("arrived", late).groupBy(F.window("arrived", window).alias("w"))
    return grouped.agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens")).select("w.start", "w.end", "docs", "tokens")
