"""Urls, mixing, chats, joins and components, against brute force."""

from __future__ import annotations

import math
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.llm import blocks, chat, common, graph, mixing, ngram_join, pivots, queries, urls
from tests.compare import same, tables


class Sets:
    """Union-find whose roots are the smallest."""

    def __init__(self, items):
        self.up = {x: x for x in items}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


# Components


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty"])
def test_components(spark, shape):
    random.seed(1)
    edges = {"path": [(k, k + 1) for k in range(60)], "star": [(99, k) for k in range(60)], "random": [(random.randint(0, 150), random.randint(0, 150)) for _ in range(120)], "empty": []}[shape]
    made = spark.createDataFrame([*edges, *edges[:5], (None, 1), (7, None), (8, 8)], "a long, b long")
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    sets = Sets(nodes)
    for a, b in edges:
        if a != b:
            sets.join(a, b)
    assert {tuple(r) for r in graph.components(made).collect()} == {(x, sets.find(x)) for x in nodes}


def test_components_of_strings(spark):
    made = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "a string, b string")
    assert {tuple(r) for r in graph.components(made).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}


def test_blocks_hold_each_two_once(spark):
    rows = [(1, k) for k in range(50)] + [(2, 1), (3, 1), (3, 2)]
    made = blocks.blocked(spark.createDataFrame(rows, "bucket long, id long"), ["bucket"], "id", part=8).collect()
    held: dict = {}
    for r in made:
        held.setdefault((r["bucket"], r["lo"], r["hi"]), []).append((r["id"], r["part"]))
    seen: dict = {}
    for (bucket, lo, hi), own in held.items():
        for i, (a, p) in enumerate(own):
            for b, q in own[i + 1 :]:
                if lo == hi or p != q:
                    seen[bucket, min(a, b), max(a, b)] = seen.get((bucket, min(a, b), max(a, b)), 0) + 1
    assert len(seen) == 50 * 49 // 2 + 1 and set(seen.values()) == {1}


def test_parts_by_bytes_and_few_rows(spark):
    made = spark.range(3000).selectExpr("1L AS bucket", "id", "1000L AS size")
    few = blocks.blocked(made, ["bucket"], "id", part=4096)
    assert few.count() == 3000
    sized = blocks.blocked(made, ["bucket"], "id", F.col("size"), part=4096, part_bytes=1_000_000)
    assert sized.count() == 3 * 3000
    assert blocks.blocked(made.limit(0), ["bucket"], "id").count() == 0


@pytest.mark.parametrize("members", [16_000, 32_000, 64_000])
def test_rows_of_large_buckets(spark, members):
    """Each member goes to as many blocks as the bucket has parts, not to one for each few members."""
    made = spark.range(members).selectExpr("1L AS bucket", "id")
    assert blocks.blocked(made, ["bucket"], "id").count() == members * -(-members // blocks.PART)


# Urls


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
    best = None
    for verdict, rule in urls.RULES:
        of, start = rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]
        if (host == of or host.endswith("." + of)) and path.startswith(start) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, None))


URLS = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x#y", "http://example.org", "http://example.org?q=/es/", "x://org/", "http://notexample.org/es/", "http://com/de/", "http://a.com/fr/b", "http://a.net/de/", "no url", "", None, "http://", "http:///es/", "http://a.org#/x", "http://u:p@a.com:80/de/", "http://a.com/de/\nx", "http://É.com/de/", "a://b://org/", "http://m.example.org/en/1"]


def test_url_rules(spark):
    rows = [(k, u, "<p>", "x") for k, u in enumerate(URLS)]
    made = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    for rules in (urls.RULES, spark.createDataFrame(urls.RULES, "verdict string, rule string")):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(made, rules).collect()}
        for k, u in enumerate(URLS):
            host, path, rule, verdict = url_by_hand(u)
            assert got[k] == (host, path, rule, verdict or "allow"), u


def test_aliases(spark):
    canonical = '<head><LINK href="{}" rel="canonical"></head>'
    refresh = "<meta content='0; URL={}' http-equiv='refresh'>"
    rows = [
        (1, "http://a.net/1", canonical.format("http://b.com/de/x")),  # to a url that is blocked
        (2, "http://a.net/2#top", refresh.format("/1")),  # and one more step
        (3, "http://c.net/1", canonical.format("http://b.com/de/y")),
        (4, "http://d.com/fr/1", refresh.format("http://c.net/1")),  # a url that is allowed joins them
        (5, "http://e.net/dir/p", canonical.format("q")),
        (6, "http://e.net/dir/q", "<a href='http://b.com/de/x'>canonical</a>"),
        (7, "https://a.net/1?", None),
        (8, None, None),
        (9, "http://b.com/de/x", "<link rel=canonical href=mailto:x@y.z>"),
        (1, "http://a.net/1", canonical.format("http://b.com/de/x")),
    ]
    got = sorted((r["page_id"], r["verdict"], r["by_alias"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "block", True), (1, "block", True), (2, "block", True), (3, "allow", False), (4, "allow", False), (5, "allow", False), (6, "allow", False), (7, "allow", False), (8, "allow", False), (9, "block", False)]
    pages = spark.createDataFrame([(1, "http://f.net/", None)], "page_id long, url string, html string")
    seen = spark.createDataFrame([("http://f.net/", "http://example.org/es/")], "url string, target string")
    assert [r["verdict"] for r in urls.judge(pages, redirects=seen).collect()] == ["block"]
    assert urls.judge(pages.limit(0)).count() == 0


def test_link_targets_are_resolved(spark):
    rows = [
        ("http://a.net/p?x", "http://b.com/de/x?a=1&amp;b=2", "http://b.com/de/x?a=1&b=2"), ("http://a.net/d/e/p", "../q", "http://a.net/d/q"), ("http://a.net/d/p", "./q?r=../s", "http://a.net/d/q?r=../s"),
        ("http://a.net/d/p?old", "?q=1#f", "http://a.net/d/p?q=1#f"), ("http://a.net", "?q", "http://a.net/?q"), ("http://a.net/d/p?k#old", "#top", "http://a.net/d/p?k#top"), ("http://a.net/d/p", "../../../q/..", "http://a.net/"),
        ("http://a.net/d/p", "/x/./y/../z/.", "http://a.net/x/z/"), ("http://a.net/d/p", "..", "http://a.net/"), ("http://a.net/d/p", "a..b/.c", "http://a.net/d/a..b/.c"), ("http://a.net", "q", "http://a.net/q"), ("http://a.net/d/p", "//b.com/../x", "http://b.com/x"),
    ]
    made = spark.createDataFrame([(u, f'<link rel="canonical" href="{t}">') for u, t, _ in rows], "url string, html string")
    assert sorted(tuple(r) for r in urls.page_links(made).collect()) == sorted((u, w) for u, _, w in rows)
    pages = [(1, "http://a.net/d/p", '<link rel=canonical href="../q?a=1&amp;b=2">'), (2, "http://a.net/q?a=1&b=2", '<link rel=canonical href="http://b.com/de/x">')]
    assert {r["verdict"] for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {"block"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), tables(sf_dir), queries.oracle_sql()[name])


# Mixing


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, capped, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        weight = sum(weights[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weights[s] / weight for s in names}
        over = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mixing(spark):
    random.seed(2)
    names = ["b", "a", None, "é", "big", "Z", ""]
    rows = []
    for k in range(900):
        source = "big" if k % 3 else random.choice(names)
        rows.append((k, " ".join(["w"] * int(random.lognormvariate(3, 1))) + " \n", source, "mine"))
    rows += [(2000, None, "empty", None), (2001, "", "empty", None), (None, "a b", "a", None)]
    got = mixing.sampled(mixed(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target, taken = targets_by_hand(sizes), dict.fromkeys(sizes, 0)
    assert math.isclose(sum(target.values()), sum(sizes.values()))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 3, (s, taken[s], target[s])
    again = mixing.sampled(mixed(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def spread(copies, n):
    """Whole numbers, one for each of n documents."""
    return [math.floor(copies * (i + 1) / n + 0.5) - math.floor(copies * i / n + 0.5) for i in range(n)]


def copies_by_hand(spark, rows):
    """Copies of each row: differences of the floors of prefix sums, from the longest document on, with one offset."""
    made = mixed(spark, rows).select("doc_id", "text", "source", F.xxhash64("doc_id", F.lit(mixing.SEED)).alias("tie"), mixing.offset(mixing.SEED).alias("offset"))
    sources: dict = {}
    for r in made.collect():
        sources.setdefault(r["source"], []).append((-len((r["text"] or "").split()), r["tie"], r["doc_id"], r["offset"]))
    target = targets_by_hand({s: -sum(x[0] for x in own) for s, own in sources.items()})
    found: dict = {}
    for s, own in sources.items():
        own = [(-n, doc, offset) for n, _, doc, offset in sorted(own)]
        size = sum(n for n, *_ in own)
        ratio = target[s] / size if size else 0.0
        by: dict = {}
        for k, (n, *_) in enumerate(own):
            if n > target[s] * mixing.ERROR:
                by.setdefault(max(-20, math.floor(math.log2(target[s] / n))), []).append(k)
        expected, taken, words, n_long = [0.0] * len(own), 0, 0, sum(map(len, by.values()))
        for _, ks in sorted(by.items()):
            words += sum(own[k][0] for k in ks)
            due = {min(3 * len(ks), max(0, math.floor(ratio * len(ks) + 0.5) + e)) for e in range(-8, 9)}
            sums = {c: sum(own[k][0] * m for k, m in zip(ks, spread(c, len(ks)), strict=True)) for c in due}
            best = min(due, key=lambda c: (abs(taken + sums[c] - ratio * words), c))
            taken += sums[best]
            for k, m in zip(ks, spread(best, len(ks)), strict=True):
                expected[k] = m
        left = sum(n for n, *_ in own[n_long:])
        share = min(3.0, max(0.0, (target[s] - taken) / left)) if left else 0.0
        whole = sum(expected)
        for k, (_, doc, offset) in enumerate(own):
            upto, before = (whole + share * (k + 1 - n_long), whole + share * (k - n_long)) if k >= n_long else (sum(expected[: k + 1]), sum(expected[:k]))
            found[doc] = math.floor(upto + offset) - math.floor(before + offset)
    return found


def test_mixing_by_hand(spark):
    random.seed(20)
    rows = [(k, " ".join(["w"] * int(random.lognormvariate(3, 1))), random.choice(["a", "b", "c", "big", "big", None]), "mine") for k in range(3000)]
    rows += [(5000, "w " * 4000, "b", None), (5001, "w " * 90_000, "long", None), (5002, "w", "long", None), (5003, None, "none", None)]
    rows += [(6000 + k, "w " * 300, "alike", None) for k in range(7)]
    got = {r["doc_id"]: r["copies"] for r in mixing.sampled(mixed(spark, rows)).collect()}
    want = copies_by_hand(spark, rows)
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in want) == 0


def test_mixing_comes_near(spark):
    """Within 1 % of each target where a source has some documents, however uneven, and never more than three times."""
    sf = "/root/testdata/sf0.01"
    if not Path(sf).is_dir():
        pytest.skip("no test data")
    got = mixing.sampled(common.table(spark, sf, "documents")).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("copies").alias("most")).collect()
    assert max(r["most"] for r in got) <= 3
    assert max(abs(r["taken"] - r["target"]) / r["target"] for r in got) < 0.01


def test_mixing_many_sources(spark):
    """Sources are ranked over partitions; null is the last."""
    rows = [(k, "w " * (1 + k % 5), None if k % 50 == 0 else f"host{k % 700:03}.example", "mine") for k in range(2100)]
    got = mixing.sampled(mixed(spark, rows)).collect()
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    target = targets_by_hand(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)


def test_mixing_repeated_rows_in_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "REPEATS", 8)
    made = mixed(spark, [(1, "w " * 10, "a", "mine")] * 90 + [(2, "w " * 10, "b", "mine")])
    want = sum(r["copies"] for r in mixing.sampled(made).collect())
    assert mixing.mix(made).count() == want > 8


def test_mixing_takes_effect(spark):
    rows = [(k, "w " * 10, f"s{k % 3}", "mine") for k in range(60)] + [(5, "w " * 10, "s2", "mine")] * 2
    made = mixed(spark, rows)
    want: dict = {}
    for r in mixing.sampled(made).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    out = mixing.mix(made)
    assert out.columns == made.columns
    got: dict = {}
    for r in out.collect():
        assert r["size"] == "mine"
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert mixing.mix(made.limit(0)).count() == 0 and mixing.sampled(made.limit(0)).count() == 0
    assert mixing.mix(mixed(spark, [(None, None, None, None)])).count() in (0, 1)


# Chats


def test_preferences(spark):
    turns = "conv_id long, turn long, role string, text string, chosen string"
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (0, 3, "assistant", "good"),
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "bad"), (1, 4, "user", "é😀"),
        (2, 0, "user", "x"), (3, 0, "user", "x"),
        (4, 0, "user", "alone"), (None, 0, "user", "nobody"), (None, 1, None, None),
        (6, 1, None, None), (6, 0, "system", "s"), (7, 0, "system", "s"), (7, 1, "assistant", "b"),
    ]
    made = spark.createDataFrame([(*r, "mine") for r in rows], turns)
    got = {r["pair_id"]: r for r in chat.preferences(chat.neighbour_pairs(made)).collect()}
    assert got.keys() == {0, 1, 3}
    one = got[0]
    assert one["n_prompt"] == 3 and one["prompt"] == "<|user|>\nq<|end|>\n<|assistant|>\na<|end|>\n<|user|>\nr<|end|>\n"
    assert one["chosen"] == "<|assistant|>\ngood<|end|>\n"
    assert [one["chosen"][s["start"] : s["end"]] for s in one["chosen_mask"]] == ["good<|end|>\n"]
    assert [one["rejected"][s["start"] : s["end"]] for s in one["rejected_mask"]] == ["bad<|end|>\n"]
    assert (got[1]["n_prompt"], got[1]["chosen"], got[1]["rejected"]) == (1, "", "")
    assert (got[3]["n_prompt"], got[3]["chosen"], got[3]["chosen_mask"]) == (1, "<||>\n<|end|>\n", [])
    assert chat.preferences(chat.neighbour_pairs(made.limit(0))).count() == 0


def test_long_urls_pages_and_turns(spark):
    long = "http://a.example.org/es/" + "x" * 200_000
    rows = [(1, long, "<p>" * 200_000), (1, long, "<p>" * 200_000), (None, None, None)]
    got = sorted((r["page_id"] or 0, len(r["path"]), r["verdict"]) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(0, 0, "allow"), (1, 200_004, "block"), (1, 200_004, "block")]
    turns = [(0, 0, "user", "q" * 500_000), (0, 1, "assistant", "a" * 500_000), (1, 0, "user", "q" * 500_000), (1, 1, "assistant", "b")]
    one = chat.preferences(chat.neighbour_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert (one["n_prompt"], len(one["prompt"]), one["rejected"]) == (1, 500_017, "<|assistant|>\nb<|end|>\n")
    assert [(s["start"], s["end"]) for s in one["chosen_mask"]] == [(14, 500_022)]


def test_conversations_of_many_turns(spark):
    lengths = [0, 1, chat.BLOCK - 1, chat.BLOCK, chat.BLOCK + 1, chat.BLOCK**2, chat.BLOCK**2 + 1, 20_000]
    arrays = spark.createDataFrame([([k % 7 for k in range(n)],) for n in lengths], "a array<long>")
    for r in arrays.select("a", chat.before(F.col("a")).alias("b")).collect():
        assert r["b"] == [0, *np.cumsum(r["a"]).tolist()][: len(r["a"])]
    turns = [("assistant" if k % 2 else "user", f"t{k}") for k in range(100_000)]
    made = spark.createDataFrame([(1, turns, [("user", "other"), *turns[1:]])], "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    began = time.perf_counter()
    one = chat.preferences(made).first()
    assert time.perf_counter() - began < 60
    assert len(one["chosen_mask"]) == 50_000
    assert all(one["chosen"][s["start"] : s["end"]] == f"t{2 * k + 1}<|end|>\n" for k, s in enumerate(one["chosen_mask"]))


def test_repeated_pairs_and_no_pairs(spark):
    kind = "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"
    row = (1, [("user", None), ("assistant", "x")], [("user", None)], "mine")
    got = chat.preferences(spark.createDataFrame([row, row, (None, [], [], None)], kind)).collect()
    assert sorted(repr(r["n_prompt"]) for r in got) == ["0", "1", "1"]
    assert chat.preferences(spark.createDataFrame([], kind)).count() == 0


# N-gram join


def near_by_hand(rows, least=0.8):
    sets = {}
    for name, text in rows:
        words = (text or "").encode().split()
        if name is not None and words:
            sets[name] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    links, groups, names = dict.fromkeys(sets, 0), Sets(sets), sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= least * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                groups.join(a, b)
    return {(n, links.get(n, 0), groups.find(n) if n in links else n) for n, _ in rows if n is not None}


def joined(spark, rows):
    return ngram_join.link(spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, class_id string"))


def test_ngram_join(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000, None), (5001, ""), (5002, "a b"), (5003, "a  b\n"), (5004, "b a"), (5005, "w " * 40_000), (5006, "w " * 41_000)]
    got = {tuple(r)[:3] for r in joined(spark, rows).collect()}
    assert got == near_by_hand(rows)


def test_ngram_join_of_a_large_group(spark):
    """More near copies than a block holds, and exact copies among them."""
    random.seed(3)
    base = [f"w{random.randint(0, 400)}" for _ in range(120)]
    rows = []
    for k in range(300):
        w = list(base)
        for _ in range(random.randint(0, 3)):
            w[random.randrange(120)] = f"x{random.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(base)) for k in range(20)]
    got, want = {tuple(r)[:3] for r in joined(spark, rows).collect()}, near_by_hand(rows)
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert there >= found >= 0.999 * there
    assert {(a, c) for a, _, c in got} == {(a, c) for a, _, c in want}


def test_ngram_join_in_tiles(spark, monkeypatch):
    """A bucket of several parts and tiles, long sets among them, is compared as by brute force."""
    monkeypatch.setattr(blocks, "TILE", 48)
    monkeypatch.setattr(blocks, "PART", 150)
    monkeypatch.setattr(ngram_join, "_ROOM", 5000)
    random.seed(22)
    rows = []
    for base in ([f"w{random.randint(0, 400)}" for _ in range(n)] for n in (60, 300)):
        for _ in range(350):
            w = list(base)
            for _ in range(random.randint(0, len(w) // 40)):
                w[random.randrange(len(w))] = f"x{random.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    got, want = {tuple(r)[:3] for r in joined(spark, rows).collect()}, near_by_hand(rows)
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert there >= found >= 0.999 * there and len(got) == len(want)
    assert {(a, c) for a, _, c in got} == {(a, c) for a, _, c in want}


def test_ngram_join_recall_near_the_threshold(spark):
    """Pairs at a similarity of 0.80 to 0.85, each by itself."""
    random.seed(23)
    rows = []
    for k in range(400):
        base = [f"w{random.randint(0, 10**6)}" for _ in range(104)]
        other = list(base)
        other[-random.choice([9, 10, 11]) :] = [f"y{random.randint(0, 10**6)}" for _ in range(8)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got, want = {tuple(r)[:3] for r in joined(spark, rows).collect()}, near_by_hand(rows)
    there = sum(x[1] for x in want)
    assert there > 500 and sum(x[1] for x in got) >= 0.99 * there


def test_bands():
    for least, recall in ((0.8, 0.9995), (0.8, 0.9), (0.5, 0.99)):
        bands, rows = ngram_join.band_shape(least, recall, 160)
        assert bands * rows <= 160 and 1 - (1 - least**rows) ** bands >= recall
    with pytest.raises(ValueError):
        ngram_join.band_shape(0.1, 0.9999, 5)


def test_deduplicate(spark):
    words = [f"w{k}" for k in range(60)]
    near = " ".join([*words[:-1], "other"])
    rows = [(3, " ".join(words)), (1, near), (2, "something else entirely"), (2, "something else entirely"), (None, near), (4, None), (5, "")]
    made = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, dedup_id string")
    out = ngram_join.deduplicate(made)
    assert out.columns == made.columns
    assert sorted(map(repr, (r["doc_id"] for r in out.collect()))) == ["1", "2", "4", "5", "None"]
    assert ngram_join.deduplicate(made.limit(0)).count() == 0


def test_ngram_join_clashing_columns_and_nothing(spark):
    rows = [(1, "a b c d e f", 5, "x"), (2, "a b c d e f", 6, "y"), (None, None, None, None)]
    made = spark.createDataFrame(rows, "doc_id long, text string, bucket long, part string").withColumns({"set": F.lit(1), "links": F.lit("mine")})
    assert sorted(map(repr, (tuple(r) for r in ngram_join.link(made).collect()))) == ["(1, 1, 1, True)", "(2, 1, 1, False)", "(None, 0, None, True)"]
    assert ngram_join.link(made.limit(0)).count() == 0
    assert ngram_join.deduplicate(made).columns == made.columns


# Embeddings


def vectors_by_hand(rows):
    names = sorted({r[0] for r in rows if r[0] is not None})
    links, groups, kinds = dict.fromkeys(names, 0), Sets(names), {}
    for name, v, label in {r[0]: r for r in rows if r[0] is not None}.values():
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            kinds.setdefault((label, len(v)), []).append((name, np.array(v, float) / np.linalg.norm(np.array(v, float))))
    for own in kinds.values():
        for i, (a, x) in enumerate(own):
            for b, y in own[i + 1 :]:
                if x @ y >= 0.93:
                    links[a] += 1
                    links[b] += 1
                    groups.join(a, b)
    return {(n, links[n], groups.find(n), groups.find(n) == n) for n in names}


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(60):
        middle = rng.normal(size=16)
        rows += [(len(rows) + k, (middle + rng.normal(size=16) * 0.12).tolist(), int(rng.integers(0, 3))) for k in range(int(rng.integers(1, 8)))]
    middle = rng.normal(size=16)
    rows += [(2000 + k, (middle + rng.normal(size=16) * 0.02).tolist(), 1) for k in range(400)]
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [float("inf")] + [1.0] * 15, 1), (5004, rows[0][1], None), (5005, [1.0], 1), (5006, [2.0], 1), (5007, [], 1), (5008, [None] * 16, 1)]
    made = spark.createDataFrame([(*r, "mine") for r in rows + odd + rows[:2]], "vec_id long, embedding array<double>, label int, kept string")
    got = {tuple(r) for r in pivots.deduplicate(made).collect()}
    want = vectors_by_hand(rows + odd)
    found, there = sum(x[1] for x in got), sum(x[1] for x in want)
    assert len(got) == len(want) and there >= found >= 0.97 * there
    exact = {x for x in want if x[0] >= 5000}
    assert exact <= got


def test_embeddings_that_repeat(spark):
    """One row for each row: those that share a vec_id are one vector."""
    rows = [(1, [1.0, 0.0], 1, "x")] * 3 + [(2, [1.0, 0.1], 1, "x"), (2, [0.0, 1.0], 2, "y"), (3, [0.0, 1.0], 2, None)]
    got = sorted(tuple(r) for r in pivots.deduplicate(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links string")).collect())
    assert got == [(1, 1, 1, True)] * 3 + [(2, 1, 1, False)] * 2 + [(3, 0, 3, True)]


def test_embeddings_in_tiles(spark, monkeypatch):
    """A list of more than a tile and a part is compared as by brute force."""
    monkeypatch.setattr(blocks, "TILE", 64)
    monkeypatch.setattr(blocks, "PART", 300)
    rng = np.random.default_rng(21)
    rows = []
    for middle in rng.normal(size=(3, 16)):
        rows += [(len(rows) + k, (middle + rng.normal(size=16) * 0.2).tolist(), 1) for k in range(500)]
    got = {tuple(r) for r in pivots.deduplicate(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = vectors_by_hand(rows)
    assert sum(x[1] for x in want) >= sum(x[1] for x in got) >= 0.97 * sum(x[1] for x in want)


def test_large_lists_are_divided(spark, monkeypatch):
    """By second pivots where vectors lie apart, which loses nothing; lists of near copies aren't."""
    rng = np.random.default_rng(22)
    middles = rng.normal(size=(500, 16))
    rows = [(k, (middles[k % 500] + 0.1 * rng.normal(size=16)).tolist(), 1) for k in range(2000)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    plain = sorted(tuple(r) for r in pivots.deduplicate(made).collect())
    monkeypatch.setattr(pivots, "DIVIDED", 40)
    assert sorted(tuple(r) for r in pivots.deduplicate(made).collect()) == plain
    assert sum(r[1] for r in plain) > 1000
    usable = pivots.clean(made)
    lists = pivots.inverted(pivots.described(usable, pivots.fit(usable, 2000))).cache()
    divided = lists.where("second >= 0")
    assert divided.count() > 1000
    largest = lambda df, *key: df.groupBy(*key).agg(F.countDistinct("vec_id").alias("n")).agg(F.max("n")).first()[0]
    assert largest(divided, "pivot", "second") < largest(divided, "pivot") / 2
    near = spark.createDataFrame([(k, (middles[0] + 1e-3 * rng.normal(size=16)).tolist(), 1) for k in range(200)] + [(900 + k, middles[k].tolist(), 1) for k in range(100)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in pivots.deduplicate(near).collect()}
    assert all(got[k] >= 199 for k in range(200))


def test_embeddings_nameless_and_empty(spark):
    made = spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(repr, (tuple(r) for r in pivots.deduplicate(made).collect()))) == ["(1, 0, 1, True)", "(None, 0, None, True)", "(None, 0, None, True)"]
    assert pivots.deduplicate(made.limit(0)).count() == 0


def test_embedding_recall(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {tuple(r) for r in queries.op10_pivot_permutations(spark, sf_dir).collect()}
    assert got == vectors_by_hand(rows)


@pytest.mark.parametrize("per_pivot, pivot_count", [(8, 1024), (1, 4096)])
def test_embedding_recall_with_many_pivots(spark, monkeypatch, per_pivot, pivot_count):
    monkeypatch.setattr(pivots, "PER_PIVOT", per_pivot)
    rng = np.random.default_rng(6)
    basis = np.linalg.qr(rng.normal(size=(64, 12)))[0].T
    x = pivots.units(rng.normal(size=(6000, 12)) @ basis)
    y = pivots.units(rng.normal(size=(2000, 12)) @ basis)
    y = pivots.units(y - (x[:2000] * y).sum(axis=1, keepdims=True) * x[:2000])
    all_ = np.concatenate([x, 0.935 * x[:2000] + np.sqrt(1 - 0.935**2) * y])
    assert pivots.pivot_count(len(all_)) == pivot_count
    made = spark.createDataFrame([(k, v, 1) for k, v in enumerate(all_.tolist())], "vec_id long, embedding array<double>, label int")
    found = sum(r["n_links"] for r in pivots.deduplicate(made).collect())
    there = int((all_ @ all_.T >= pivots.LEAST).sum()) - len(all_)
    assert there >= found >= 0.99 * there, found / there


def test_local_components():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        m = int(rng.integers(0, 80))
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        sets = Sets(range(n))
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            sets.join(a, b)
        assert blocks.local_components(n, i, j).tolist() == [sets.find(k) for k in range(n)]


def test_all_are_registered():
    names = queries.queries()
    assert sorted(int(n.split("_")[0][2:]) for n in names) == list(range(1, 14))
    assert queries.oracle_sql().keys() <= names.keys()


def test_queries_read_whole_tables(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op1_randomness", "op2_diagonal_voting", "op5_systematic_mix", "op7_bit_planes", "op8_rule_ledger", "op9_minhash_join"):
        assert queries.queries()[name](spark, sf_dir).select("doc_id").distinct().count() == n, name
    assert queries.op3_packing(spark, sf_dir).select("doc_id").distinct().count() == n
    assert queries.op4_redirect_equivalence(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
