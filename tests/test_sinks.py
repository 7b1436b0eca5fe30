from __future__ import annotations

import json

from pyspark.sql import functions as F

from arbora import sinks
from arbora.operators import tree
from arbora.plans.pages import Indexer


def nodes(spark):
    rows = [(1, 0, "1", "A"), (1, 1, "1.1", 'B "q"'), (2, 0, "1", "C")]
    made = spark.createDataFrame(rows, "doc_id int, list_index long, structure string, title string")
    return tree.with_node_ids(tree.with_paths(tree.with_parents(made)))


def test_results(spark, tmp_path):
    names = spark.createDataFrame([(1, "one.pdf")], "doc_id int, doc_name string")
    said = spark.createDataFrame([(1, "about A")], "doc_id int, description string")
    made = sinks.results(nodes(spark), names, ["title", "node_id"], said)
    got = {r["doc_id"]: json.loads(r["value"]) for r in made.collect()}
    assert got[1] == {"doc_name": "one.pdf", "doc_description": "about A", "structure": [{"title": "A", "node_id": "0000", "nodes": [{"title": 'B "q"', "node_id": "0001"}]}]}
    assert got[2] == {"structure": [{"title": "C", "node_id": "0000"}]}
    sinks.write_json(made, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == 2


def test_tables(spark, tmp_path):
    made, path = nodes(spark), str(tmp_path / "nodes")
    sinks.write_nodes(made, path, buckets=2)
    assert spark.read.parquet(path).drop("bucket").count() == 3
    steps = made.select("doc_id", F.col("list_index").alias("seq"))
    for _ in range(2):
        sinks.append_events(steps, str(tmp_path / "steps"))
    assert spark.read.parquet(str(tmp_path / "steps")).count() == 6


def test_indexer(spark):
    pages = spark.createDataFrame([(1, 1, "One\nx"), (1, 2, "Two\ny")], "doc_id int, physical_index int, text string")
    got = Indexer({"if_add_node_summary": "no"}).process(pages).orderBy("node_ord").collect()
    assert [(r["title"], r["start_index"], r["end_index"]) for r in got] == [("One", 1, 1), ("Two", 2, 2)]


def test_large_folders_are_written_by_several_tasks(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    had = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        nodes = spark.range(60_000).select((F.col("id") % 40).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(16)
        sinks.write_nodes(nodes, str(tmp_path / "nodes"), 4)
    finally:
        spark.conf.set(key, had)
    folders = sorted(p for p in (tmp_path / "nodes").iterdir() if p.is_dir())
    assert len(folders) == 4 and sum(len(list(p.glob("*.parquet"))) for p in folders) > 8
    assert spark.read.parquet(str(tmp_path / "nodes")).select("doc_id", "text").distinct().count() == 60_000
