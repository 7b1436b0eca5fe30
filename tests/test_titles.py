"""Titles on pages, gaps and ranges, against looking at every page."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from arbora.operators import titles, toc
from arbora.reasoner import ModelReasoner, RuleReasoner


def squeezed(text):
    return re.sub(r"\s+", "", text).lower()


def made(seed, docs=6):
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("abAB é\n\t😀") for _ in range(n))
    items, pages = [], []
    for d in range(docs):
        own = [draw(rng.choice([0, 1, 2, 3, 4, 5, 8, 15, 16, 17, 40, 70])) for _ in range(rng.randint(0, 30))]
        items += [(d, k, t if rng.random() > 0.05 else None) for k, t in enumerate(own)]
        for p in range(1, rng.randint(1, 40)):
            text = "".join(rng.choice([draw(rng.randint(0, 30)), *own[:1], rng.choice([*own, ""]).upper()]) for _ in range(3))
            pages.append((d, p if p < 30 else 3000 + p, text if rng.random() > 0.05 else None))
    return items, pages


def frames(spark, items, pages):
    return spark.createDataFrame(items, "doc_id int, list_index long, title string"), spark.createDataFrame(pages, "doc_id int, physical_index int, text string")


@pytest.mark.parametrize("seed", range(3))
def test_finds(spark, seed):
    items, pages = made(seed)
    want = {(d, squeezed(t), p) for d, _, t in items if t is not None for e, p, text in pages if e == d and text is not None and squeezed(t) in squeezed(text)}
    got = [tuple(r) for r in titles.finds(*frames(spark, items, pages)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_first_within_and_pages(spark):
    items, pages = made(7)
    rng = random.Random(8)
    ranged = [(d, k, t, rng.randint(0, 20), rng.randint(5, 40)) for d, k, t in items]
    made_items, made_pages = frames(spark, items, pages)
    rules = RuleReasoner()
    got = {(r["doc_id"], r["list_index"]): r["fixed_index"] for r in rules.locate(spark.createDataFrame(ranged, "doc_id int, list_index long, title string, a int, b int"), rules.searchable(made_items, made_pages), "a", "b").collect()}
    on = lambda d, t, a, b: min((p for e, p, text in pages if e == d and a <= p <= b and t is not None and text is not None and squeezed(t) in squeezed(text)), default=None)
    assert got == {(d, k): on(d, t, a, b) for d, k, t, a, b in ranged}
    placed = {(r["doc_id"], r["list_index"]): r["physical_index"] for r in rules.place(made_items, made_pages).collect()}
    assert placed == {(d, k): on(d, t, 0, 10_000) for d, k, t in items}


def test_gaps_by_hand(spark):
    rng = random.Random(9)
    items, pages = made(10, 12)
    known = [(d, k, t, rng.randint(1, 40) if rng.random() < 0.3 else None) for d, k, t in items]
    got = {(r["doc_id"], r["list_index"]): r["fixed_index"] for r in RuleReasoner().filled(spark.createDataFrame(known, "doc_id int, list_index long, title string, physical_index int"), frames(spark, items, pages)[1]).collect()}
    want = {}
    for d in {d for d, *_ in known}:
        own = sorted(x[1:] for x in known if x[0] == d)
        before = 0
        for n, (k, t, at) in enumerate(own):
            after = next((a for *_, a in own[n + 1 :] if a is not None), None)
            if at is not None:
                before = at
            elif after is not None and t is not None:
                found = min((p for e, p, text in pages if e == d and before <= p <= after and text is not None and squeezed(t) in squeezed(text)), default=None)
                if found is not None:
                    want[d, k] = before = found
    assert got == want and want


def looked_up(prompts):
    """A model that finds titles as the rules do."""
    out = []
    for prompt in prompts:
        title, _, content = prompt.partition("Title: ")[2].partition("\n\n")
        pages = re.findall(r"<physical_index_(\d+)>\n(.*?)\n</physical_index_\d+>", content, re.DOTALL)
        found = next((k for k, text in pages if re.sub(r"\s+", "", title).lower() in re.sub(r"\s+", "", text).lower()), None)
        out.append(json.dumps({"physical_index": f"<physical_index_{found}>"}) if found else "nowhere")
    return out


def test_gaps_and_ranges_by_a_model(spark):
    rng = random.Random(11)
    pages = [(d, p, f"words\nChapter {rng.randint(0, 9)} and Chapter {rng.randint(0, 9)}\nmore") for d in range(8) for p in range(1, 25)]
    items = [(d, k, f"chapter {rng.randint(0, 9)}", rng.randint(1, 24) if rng.random() < 0.3 else None) for d in range(8) for k in range(12)]
    made_items = spark.createDataFrame(items, "doc_id int, list_index long, title string, physical_index int")
    made_pages = spark.createDataFrame(pages, "doc_id int, physical_index int, text string")
    rules, model = RuleReasoner(), ModelReasoner(lambda prompts: looked_up(prompts), retries=1)
    got = [{(r["doc_id"], r["list_index"], r["fixed_index"]) for r in x.filled(made_items, made_pages).collect()} for x in (rules, model)]
    assert got[0] == got[1] and len(got[0]) > 10
    ranged = made_items.withColumns({"a": F.col("list_index").cast("int"), "b": (F.col("list_index") + 8).cast("int")})
    got = [{(r["doc_id"], r["list_index"], r["fixed_index"]) for r in x.locate(ranged, x.searchable(made_items, made_pages), "a", "b").collect()} for x in (rules, model)]
    assert got[0] == got[1] and len(got[0]) == len(items)


def test_nothing_to_find(spark):
    items, pages = frames(spark, [], [])
    assert titles.finds(items, pages).count() == 0
    assert RuleReasoner().place(frames(spark, [(1, 0, "a")], [])[0], pages).first()["physical_index"] is None


def book(spark, n):
    """A document of n pages, each with words and its own title, and n items."""
    pages = spark.range(1, n + 1).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("physical_index"), F.concat(F.repeat(F.lit("some words of a page, "), 40), F.lit(" Section Number "), "id", F.lit(". more words")).alias("text"))
    items = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("list_index"), F.concat(F.lit("section number "), F.col("id") + 1, F.lit(".")).alias("title"))
    return items.cache(), pages.cache()


def took(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_a_document_of_20000_pages_and_titles(spark):
    rules = RuleReasoner()
    items, pages = book(spark, 20_000)
    took(rules.place(*book(spark, 100)))
    assert took(rules.place(items, pages)) < 40
    assert rules.place(items, pages).where("physical_index <> list_index + 1 or physical_index is null").count() == 0


def test_a_gap_of_5000_items(spark):
    items, pages = book(spark, 5000)
    known = items.withColumn("physical_index", F.when(F.col("list_index").isin(0, 4999), F.col("list_index") + 1).cast("int"))
    began = time.perf_counter()
    got = RuleReasoner().filled(known, pages)
    assert got.count() == 4998 and got.where("fixed_index <> list_index + 1").count() == 0
    assert time.perf_counter() - began < 40


def test_repairs_of_5000_items(spark):
    items, pages = book(spark, 5000)
    wrong = items.withColumn("physical_index", F.lit(3).cast("int"))
    rules = RuleReasoner()
    ranged = toc.repair_ranges(wrong, wrong.select("doc_id", "list_index"), spark.createDataFrame([(1, 5000)], "doc_id int, n_pages int"))
    began = time.perf_counter()
    got = rules.locate(ranged, rules.searchable(items, pages), "prev_correct", "next_correct")
    assert got.where("fixed_index = list_index + 1").count() == 5000
    assert time.perf_counter() - began < 40
