from __future__ import annotations

import math
import random

import pytest

from arbora.operators import pages as pg
from arbora.operators import toc
from arbora.plans import pages as plan


def pages(spark, tokens, doc=1):
    return spark.createDataFrame([(doc, k + 1, f"p{k + 1}", n) for k, n in enumerate(tokens)], "doc_id int, physical_index int, text string, n_tokens int")


def by_hand(tokens, most, overlap):
    total = sum(tokens)
    if total <= most:
        return [(1, len(tokens))]
    target = math.ceil((total / math.ceil(total / most) + most) / 2)
    groups, held = [], []
    for k, n in enumerate(tokens):
        if sum(tokens[j] for j in held) + n > target:
            groups.append(held)
            held = list(range(max(k - overlap, 0), k))
        held = [*held, k]
    groups.append(held)
    return [(g[0] + 1, g[-1] + 1) if g else (1, 0) for g in groups]


def test_groups(spark):
    random.seed(6)
    cases = [[30_000, 100, 100], [5], [0, 0], [10] * 9] + [[random.randint(1, 60) for _ in range(random.randint(1, 15))] for _ in range(12)]
    for overlap in (0, 1, 2):
        made = None
        for k, tokens in enumerate(cases):
            one = pages(spark, tokens, k)
            made = one if made is None else made.unionByName(one)
        got: dict = {}
        for r in pg.groups(made, 50, overlap).orderBy("doc_id", "group_no").collect():
            got.setdefault(r["doc_id"], []).append((r["first_pi"], r["last_pi"]))
        assert got == {k: by_hand(t, 50, overlap) for k, t in enumerate(cases)}


def test_texts(spark):
    nodes = spark.createDataFrame([(1, 0, 1, 2), (1, 1, 3, 2), (1, 2, None, 2), (1, 3, 2, 0), (1, 4, 2, 99)], "doc_id int, list_index int, start_index int, end_index int")
    got = {r["list_index"]: r["text"] for r in pg.with_text(nodes, pages(spark, [1, 1, 1])).collect()}
    assert got == {0: "p1p2", 1: "", 2: None, 3: None, 4: "p2p3"}
    tagged = {r["list_index"]: r["text"] for r in pg.with_text(nodes, pages(spark, [1]), with_tags=True).collect()}
    assert tagged[0] == "<physical_index_1>\np1\n</physical_index_1>\n"
    assert pg.between(pages(spark, [1, 1, 1]), 2, 9).first()["text"] == "p2p3"


def test_large(spark):
    nodes = spark.createDataFrame([(1, 0, 1, 3), (1, 1, 1, 2), (1, 2, 2, 5)], "doc_id int, list_index int, start_index int, end_index int")
    got = pg.large(nodes, pages(spark, [10, 10, 10, 1, 1]), 1, 25).collect()
    assert [(r["list_index"], r["span_tokens"]) for r in got] == [(0, 30)]


def run_by_hand(answers, limit):
    run, begun = [], False
    for k, a in enumerate(answers):
        if k >= limit and not begun:
            break
        if a == "yes":
            run.append(k + 1)
            begun = True
        elif a == "no" and begun:
            break
    return run


def test_runs(spark):
    random.seed(7)
    cases = [[random.choice(["yes", "no", "maybe"]) for _ in range(10)] for _ in range(30)]
    rows = [(d, k + 1, a) for d, c in enumerate(cases) for k, a in enumerate(c)]
    got: dict = {d: [] for d in range(30)}
    for r in toc.page_runs(spark.createDataFrame(rows, "doc_id int, physical_index int, is_toc string"), 4).orderBy("physical_index").collect():
        got[r["doc_id"]].append(r["physical_index"])
    assert got == {d: run_by_hand(c, 4) for d, c in enumerate(cases)}


def test_all_runs(spark):
    random.seed(9)
    cases = [[random.choice(["yes", "no", "maybe"]) for _ in range(10)] for _ in range(30)]
    rows = [(d, k + 1, a) for d, c in enumerate(cases) for k, a in enumerate(c)]
    made = toc.all_runs(spark.createDataFrame(rows, "doc_id int, physical_index int, is_toc string"), 6).orderBy("physical_index").collect()
    for d, c in enumerate(cases):
        want, at = [], 0
        while at < 6:
            run = run_by_hand(["maybe"] * at + c[at:], 6)
            if not run:
                break
            want.append(run)
            at = next((k for k in range(run[-1], 10) if c[k] == "no"), 10)
        own = [r for r in made if r["doc_id"] == d]
        assert [[r["physical_index"] for r in own if r["run"] == k] for k in sorted({r["run"] for r in own})] == want
    tocs = spark.createDataFrame([(1, 0, "no"), (1, 2, "yes"), (1, 3, "yes"), (2, 1, "no"), (2, 4, "no")], "doc_id int, run int, numbered string")
    assert {tuple(r) for r in toc.chosen_runs(tocs).collect()} == {(1, 2, "yes"), (2, 1, "no")}


def test_offset_ties(spark):
    pairs = spark.createDataFrame([(1, 0, 5, 8), (1, 1, 6, 8), (1, 2, 7, 9), (1, 3, 8, 11), (1, 4, None, 1), (2, 0, None, 3)], "doc_id int, ord int, page int, physical_index int")
    assert [tuple(r) for r in toc.page_offsets(pairs).collect()] == [(1, 3)]


def test_gate(spark):
    rows = [(1, k, k + 1, "yes") for k in range(4)] + [(2, 0, 1, "yes"), (2, 1, 2, "yes"), (2, 2, 3, "no"), (2, 3, None, "no")] + [(3, 0, 1, "yes")]
    verified = spark.createDataFrame(rows, "doc_id int, list_index int, physical_index int, answer string")
    counts = spark.createDataFrame([(1, 4), (2, 4), (3, 9)], "doc_id int, n_pages long")
    got = {r["doc_id"]: (round(r["accuracy"], 3), r["n_wrong"], r["decision"]) for r in toc.gate(toc.accuracy(verified, counts)).collect()}
    assert got == {1: (1.0, 0, "accept"), 2: (0.667, 1, "repair"), 3: (0.0, 0, "fall_back")}


def test_plan_by_contents(spark):
    """A table of contents with logical pages two less than the physical ones."""
    contents = "Contents\n1 Alpha ..... 1\n1.1 Beta ..... 3\n2 Gamma ..... 5"
    texts = [contents, "nothing", "Alpha\nbody", "more", "Beta\nbody", "more", "Gamma\nbody", "end"]
    made = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(texts)], "doc_id int, physical_index int, text string")
    got = plan.build(made, {"if_add_node_text": "yes"}).orderBy("node_ord").collect()
    assert [(r["title"], r["depth"], r["start_index"], r["end_index"]) for r in got] == [("Preface", 0, 1, 2), ("Alpha", 0, 3, 4), ("Beta", 1, 5, 6), ("Gamma", 0, 7, 8)]
    assert got[1]["text"] == "Alpha\nbodymore" and got[3]["summary"] == "Gamma\nbodyend"


def test_plan_splits(spark):
    texts = [f"Part {k}\n{'word ' * 30}" for k in range(1, 9)]
    made = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(texts)], "doc_id int, physical_index int, text string")
    got = plan.build(made, {"max_page_num_each_node": 2, "max_token_num_each_node": 10}).collect()
    assert len(got) == 8 and {r["is_leaf"] for r in got} == {True}


def test_plan_by_model(spark):
    """A model that answers from the prompts; its table of contents comes in two replies, and its pages in several groups."""
    import json
    import re

    from arbora import reasoner as rs

    def answer(prompt):
        said = prompt.split("\n\n")
        if "belong to a table of contents" in said[0]:
            return json.dumps({"answer": "yes" if "CONTENTS" in prompt else "no"})
        if "give page numbers" in said[0]:
            return '{"answer": "yes"}'
        if prompt.startswith("Turn this"):
            had = json.loads(prompt.rsplit("\n", 1)[1])
            rest = [{"structure": "1", "title": "Alpha", "page": 1}, {"structure": "2", "title": "Beta", "page": 3}][len(had) :]
            return "```json\n" + json.dumps(rest[:1]) + "\n```"
        if prompt.startswith("Add "):
            listed, text = json.loads(said[1]), prompt.split("Pages:\n", 1)[1]
            for x in listed:
                for n, page in re.findall(r"<physical_index_(\d+)>\n(.*?)\n</phys", text, re.DOTALL):
                    if page.startswith(x["title"]) and x["physical_index"] is None:
                        x["physical_index"] = f"<physical_index_{n}>"
            return json.dumps(listed)
        if prompt.startswith("List the sections"):
            return json.dumps([{"structure": str(n), "title": p.split()[0], "physical_index": f"<physical_index_{n}>"} for n, p in re.findall(r"<physical_index_(\d+)>\n(.*?)\n</phys", prompt, re.DOTALL)])
        if "appear or start" in said[0] or "begin with this title" in said[0]:
            title, text = re.search(r"title:\n(.*?)\n\npage_text:\n(.*)", prompt, re.DOTALL).groups()
            return json.dumps({"answer": "yes" if title in text else "no"})
        return "said"

    texts = ["CONTENTS", "Alpha x", "more", "Beta y", "end"]
    rows = [(1, k + 1, t) for k, t in enumerate(texts)] + [(2, 1, "One a"), (2, 2, "Two b")]
    made = spark.createDataFrame(rows, "doc_id int, physical_index int, text string")
    model = rs.ModelReasoner(lambda prompts: [answer(p) for p in prompts], retries=1)
    got = [(r["doc_id"], r["title"], r["start_index"], r["end_index"], r["summary"]) for r in plan.build(made, {}, model).orderBy("doc_id", "node_ord").collect()]
    assert got == [(1, "Preface", 1, 1, "said"), (1, "Alpha", 2, 3, "said"), (1, "Beta", 4, 5, "said"), (2, "One", 1, 1, "said"), (2, "Two", 2, 2, "said")]


def test_replies():
    from arbora import reasoner as rs

    assert rs.parse_reply('```json\n[{"a": None,}]\n```') == [{"a": None}]
    assert rs.parse_reply("nothing") is None and rs.parse_reply("```json [1]") is None
    assert [rs._number(x) for x in ("<physical_index_3>", "physical_index_4", 5, "6", None)] == [3, 4, 5, None, None]


def test_toc_items_go_on(spark):
    import json

    from arbora import reasoner as rs

    def answer(prompt):
        if "\n\nstubborn\n" in prompt:
            return json.dumps([{"structure": "1", "title": "Again", "page": 1}])
        had = json.loads(prompt.rsplit("\n", 1)[1])
        return json.dumps([{"structure": str(k), "title": f"T{k}", "page": k} for k in range(12)][len(had) : len(had) + 1])

    tocs = spark.createDataFrame([(1, "x" * 100), (2, "\n\nstubborn\n" + "x" * 100)], "doc_id int, toc_text string")
    got = {r["doc_id"]: [x["title"] for x in r["items"]] for r in rs.ModelReasoner(lambda prompts: [answer(p) for p in prompts], retries=1).toc_items(tocs).collect()}
    assert got == {1: [f"T{k}" for k in range(12)], 2: ["Again"]}


def test_split_goes_on(spark):
    from pyspark.sql import functions as F

    from arbora import reasoner as rs
    from arbora.config import load

    class Peeling(rs.RuleReasoner):
        def outline(self, pages):
            ends = pages.groupBy("doc_id").agg(F.min("physical_index").alias("first"), F.max("physical_index").alias("last"))
            return super().outline(pages.join(ends, "doc_id").where("physical_index <= first + 1 or physical_index = last").drop("first", "last"))

    made = spark.createDataFrame([(1, k, f"Part{k:02}\nbody", 5) for k in range(1, 25)], "doc_id int, physical_index int, text string, n_tokens int")
    nodes = spark.createDataFrame([(1, [0], "Whole", 1, 24)], "doc_id int, path array<long>, title string, start_index int, end_index int")
    got = plan.split_large(nodes, made, load({"max_page_num_each_node": 1, "max_token_num_each_node": 1}, {}), Peeling()).collect()
    assert max(len(r["path"]) for r in got) > 9 and not [r for r in got if r["end_index"] - r["start_index"] > 1]


@pytest.mark.parametrize("way", ["numbers", "parts"])
def test_rules_read_texts_for_titles_once(spark, sf_dir, monkeypatch, way):
    """Titles are looked for once; what is found answers all later questions, so that no page's text meets an item again."""
    from arbora import fixtures
    from arbora.operators import titles
    from arbora.plans import pages as plan

    calls, finds = [], titles.finds
    monkeypatch.setattr(titles, "finds", lambda *a, **k: calls.append(1) or finds(*a, **k))
    monkeypatch.setattr(plan.toc, "with_page_text", lambda *a: pytest.fail("texts are joined to items"))
    made = fixtures.contents_pages(spark, sf_dir, way).where("doc_id < 24")
    assert plan.build(made, {"toc_check_page_num": 5, "max_page_num_each_node": 3, "max_token_num_each_node": 100}).count() > 0
    assert len(calls) == 1


def test_first_characters_of_spans(spark):
    rows = [(1, 1, "ab"), (1, 2, None), (1, 3, ""), (1, 4, "cdefgh"), (1, 5, "ij"), (2, 1, "xyzuvw")]
    made = spark.createDataFrame(rows, "doc_id int, physical_index int, text string")
    nodes = spark.createDataFrame([(1, 0, 1, 5), (1, 1, 2, 3), (1, 2, 4, 4), (1, 3, 5, 4), (1, 4, None, 4), (2, 0, 1, 9)], "doc_id int, list_index int, start_index int, end_index int")
    whole = {(r["doc_id"], r["list_index"]): r["text"] for r in pg.with_text(nodes, made).collect()}
    for most in (1, 4, 5, 100):
        got = {(r["doc_id"], r["list_index"]): r["text"] for r in pg.with_text(nodes, made, most=most).collect()}
        assert got == {k: t if t is None else t[:most] for k, t in whole.items()}


def test_judged_by_what_is_found(spark):
    """The index says of each item what its page's text says."""
    from arbora import reasoner as rs
    from arbora.operators import titles

    pages_ = spark.createDataFrame([(1, 1, "The  End\nof it"), (1, 2, "not THE\nend"), (1, 3, None), (None, 1, "the end")], "doc_id int, physical_index int, text string")
    rows = [(1, 0, "the end", 1), (1, 1, "The End", 2), (1, 2, "the end", 3), (1, 3, "the end", 9), (1, 4, None, 1), (1, 5, "", 2), (1, 6, "of", 1), (1, 7, "the end", None)]
    items = spark.createDataFrame(rows, "doc_id int, list_index long, title string, physical_index int")
    rules = rs.RuleReasoner()
    by_text = rules.title_starts(rules.title_appears(toc.with_page_text(items, pages_)))
    kept = ["list_index", "answer", "appear_start"]
    assert sorted(titles.judged(items, rules.searchable(items, pages_)).select(kept).collect()) == sorted(by_text.select(kept).collect())
