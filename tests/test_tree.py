from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from arbora.operators import tree

ITEMS = "doc_id int, list_index long, structure string, title string, physical_index int, appear_start string"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEMS)


def nested(spark, codes):
    made = items(spark, *[(1, k, c, f"t{k}", k + 1, "no") for k, c in enumerate(codes)])
    return tree.with_node_ids(tree.with_paths(tree.with_parents(made)))


def by_stack(codes):
    """Parents by looking backwards, and pre-order by recursion."""
    parents = []
    for k, c in enumerate(codes):
        code = c.rpartition(".")[0] if c and "." in c else None
        parents.append(next((j for j in range(k - 1, -1, -1) if code is not None and codes[j] == code), None))
    order = []

    def visit(parent):
        for k, p in enumerate(parents):
            if p == parent:
                order.append(k)
                visit(k)

    visit(None)
    return parents, order


def test_parents_and_ids(spark):
    random.seed(4)
    for _ in range(6):
        codes = [".".join(str(random.randint(1, 2)) for _ in range(random.randint(1, 3))) for _ in range(12)]
        parents, order = by_stack(codes)
        got = {r["list_index"]: r for r in nested(spark, codes).collect()}
        assert [got[k]["parent"] for k in range(12)] == parents
        assert sorted(got, key=lambda k: got[k]["node_ord"]) == order


def test_ids(spark):
    assert [r["node_id"] for r in nested(spark, ["1", "1.1", "1.2"]).orderBy("node_ord").collect()] == ["0000", "0001", "0002"]
    assert [r["depth"] for r in nested(spark, ["1", "1.1", "2"]).orderBy("node_ord").collect()] == [0, 1, 0]
    assert [r["parent"] for r in nested(spark, ["1.1", None]).orderBy("list_index").collect()] == [None, None]


def test_leaves(spark):
    nodes = nested(spark, ["1", "1.1", "1.2"])
    assert {r["title"] for r in tree.leaves(nodes).collect()} == {"t1", "t2"}
    ids = spark.createDataFrame([(1, "0000"), (1, "0001"), (1, "9999")], "doc_id int, node_id string")
    assert {r["node_id"]: r["is_leaf"] for r in tree.is_leaf(nodes, ids).collect()} == {"0000": False, "0001": True, "9999": False}


def test_preface(spark):
    one = items(spark, (1, 0, "1", "A", 1, None))
    five = items(spark, (1, 0, "1", "A", 5, None), (2, 0, "1", "A", None, None))
    assert tree.with_preface(one).count() == 1
    first = tree.with_preface(five).where("doc_id = 1").orderBy("list_index").first()
    assert (first["title"], first["physical_index"], first["structure"]) == ("Preface", 1, "0")
    assert tree.with_preface(five).where("doc_id = 2").count() == 1
    assert tree.with_preface(items(spark)).count() == 0


def test_spans(spark):
    made = items(spark, (1, 0, "1", "A", 1, "yes"), (1, 1, "2", "B", 3, "yes"), (1, 2, "3", "C", 3, "no"))
    ends = spark.createDataFrame([(1, 9)], "doc_id int, end_index int")
    got = [(r["start_index"], r["end_index"]) for r in tree.with_spans(made, ends).orderBy("list_index").collect()]
    assert got == [(1, 2), (3, 3), (3, 9)]


def test_truncated(spark):
    made = items(spark, (1, 0, "1", "A", 5, None), (1, 1, "2", "B", 6, None), (1, 2, "3", "C", None, None))
    counts = spark.createDataFrame([(1, 5)], "doc_id int, n_pages long")
    assert [r["physical_index"] for r in tree.truncated(made, counts).orderBy("list_index").collect()] == [5, None, None]
    assert tree.with_index(made).count() == 2


def test_projections(spark):
    nodes = nested(spark, ["1", "1.1"]).withColumn("text", F.lit("x")).withColumn("page_number", F.lit(1))
    assert "text" not in tree.without(nodes).columns
    assert "page_number" not in tree.without(nodes, "page_number").columns
    assert tree.in_order(nodes, ["title", "none", "doc_id"]).columns == ["title", "doc_id"]
    assert tree.in_order(nodes, []).columns == nodes.columns
    assert [r["line"] for r in tree.toc_lines(nodes).orderBy("node_ord").collect()] == ["t0", " t1"]
    assert [(r["title"], r["more"]) for r in tree.limited(nodes, 0).collect()] == [("t0", True)]


def test_json(spark):
    nodes = nested(spark, ["1", "1.1", "1.1.1", "2"])
    got = json.loads(tree.as_json(nodes, ["title", "node_id"]).first()["json"])
    assert got == [{"title": "t0", "node_id": "0000", "nodes": [{"title": "t1", "node_id": "0001", "nodes": [{"title": "t2", "node_id": "0002"}]}]}, {"title": "t3", "node_id": "0003"}]
