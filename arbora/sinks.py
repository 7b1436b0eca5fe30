"""Writers of node tables and their JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import tree


def write_nodes(nodes: DataFrame, path: str, buckets: int = 64) -> None:
    """The node table, in folders by a hash of the document, so that the number of folders doesn't grow with documents.

    Rows are rebalanced by folder: adaptive execution splits what is larger than its advisory size among tasks, each of which
    writes files of its own, and puts small folders together, so that tasks and files grow with the data and not with folders.
    """
    placed = nodes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def results(nodes: DataFrame, names: DataFrame, fields: list[str], descriptions: DataFrame | None = None) -> DataFrame:
    """doc_id, value: a JSON object for each document with doc_name, doc_description if there is one, and structure."""
    trees = tree.as_json(nodes, fields).join(names.select("doc_id", "doc_name"), "doc_id", "left")
    if descriptions is not None:
        trees = trees.join(descriptions.select("doc_id", "description"), "doc_id", "left")
    else:
        trees = trees.withColumn("description", F.lit(None).cast("string"))
    head = F.to_json(F.struct(F.col("doc_name"), F.col("description").alias("doc_description")))
    opened = F.when(head == "{}", F.lit("{")).otherwise(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(",")))
    return trees.select("doc_id", F.concat(opened, F.lit('"structure":'), "json", F.lit("}")).alias("value"))


def repository_results(index: DataFrame, statistics: DataFrame) -> DataFrame:
    """repo_id, value: a JSON object for each repository with repo_name, structure, statistics and flat_index."""
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    named = index.withColumns({"title": F.coalesce("title", "repo_id"), "depth": depth, "doc_id": F.col("repo_id"), "node_ord": F.col("ord")})
    trees = tree.as_json(named, ["title", "path", "type", "node_id", "summary", "file_count"])
    rows = F.sort_array(F.collect_list(F.struct("ord", F.struct("title", "path", "type", "summary", "file_count", "subdir_count").alias("row"))))
    flat = named.groupBy(F.col("repo_id").alias("doc_id")).agg(F.to_json(F.transform(rows, lambda r: r["row"])).alias("flat"))
    counts = statistics.select(F.col("repo_id").alias("doc_id"), F.to_json(F.struct("total_files", "total_directories")).alias("counts"))
    parts = [F.lit('{"repo_name":'), F.to_json(F.array("doc_id")), F.lit(',"structure":'), F.col("json"), F.lit(',"statistics":'), F.col("counts"), F.lit(',"flat_index":'), F.col("flat"), F.lit("}")]
    parts[1] = F.regexp_replace(parts[1], r"^\[|\]$", "")
    return trees.join(flat, "doc_id").join(counts, "doc_id").select(F.col("doc_id").alias("repo_id"), F.concat(*parts).alias("value"))


def write_json(results: DataFrame, path: str) -> None:
    """One line of JSON for each document."""
    results.select("value").write.mode("overwrite").text(path)


def append_events(events: DataFrame, path: str) -> None:
    """Steps (doc_id, seq, ts, level, payload) are added; nothing that was written is read or written again."""
    events.write.mode("append").parquet(path)
