from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from arbora import functions as fn


def apply(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in rows.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_json(spark):
    raws = ['{"key": "value"}', '```json\n{"key": "value"}\n```', '{"key": None}', "not json", '{"key": "a",}', '```json\n{"key": "x"}', '{"a": [1,\n]}', "", None, 'x ```json {"key": "in"} ``` y ```json {"key": "z"} ```']
    got = apply(spark, lambda v: fn.extract_json(v, "key string"), *raws)
    assert [g and g["key"] for g in got] == ["value", "value", None, None, "a", None, None, None, None, None]
    assert got[2] is not None and got[3] is None


def reference_fence(raw: str) -> str:
    """What is cut by hand: after the first json fence, before the last fence."""
    if "```json" in raw:
        raw = raw.split("```json", 1)[1]
    return (raw.rsplit("```", 1)[0] if "```" in raw else raw).strip()


def test_fences(spark):
    raws = ['{"a": 1}', '```json\n{"a": 1}\n```', "```json x ``` y ``` z", "no end ```json {", "a ``` b", "  \n"]
    assert apply(spark, fn.strip_fence, *raws) == [reference_fence(r) for r in raws]


def test_names(spark):
    assert apply(spark, fn.sanitize_name, "clean", "a/b", "a\\b", "a/b\\c") == ["clean", "a-b", "a-b", "a-b-c"]
    assert apply(spark, lambda v: fn.sanitize_name(v, "_"), "a/b") == ["a_b"]
    assert apply(spark, fn.suffix, "x/a.PDF", "a", ".hidden", "b.tar.gz", "c.") == [".pdf", "", "", ".gz", ""]
    assert apply(spark, fn.stem, "x/a.PDF", "a", ".hidden", "b.tar.gz") == ["a", "a", ".hidden", "b.tar"]
    assert apply(spark, fn.title_or_untitled, "", None, "T") == ["Untitled", "Untitled", "T"]


def test_indexes(spark):
    assert apply(spark, fn.index_number, "<physical_index_5>", "<physical_index_10>", "physical_index_15", "15", "x", None) == [5, 10, 15, None, None, None]
    assert apply(spark, fn.page_number, "5", " 10 ", "not a number", "-3", None, "99999999999") == [5, 10, None, -3, None, None]
    assert apply(spark, fn.first_tag, "a <physical_index_3> b <physical_index_9>", "none") == [3, -1]
    assert apply(spark, fn.last_tag, "a <physical_index_3> b <physical_index_9>", "none") == [9, -1]


def test_codes_and_dots(spark):
    assert apply(spark, fn.parent_code, "1", "1.2", "1.2.3", None, ".5") == [None, "1", "1.2", None, ""]
    assert apply(spark, fn.dots_to_colon, "A.....7", "A. . . . . 7", "A....7", "A . 7") == ["A: 7", "A: 7", "A....7", "A . 7"]


def test_text(spark):
    assert apply(spark, fn.token_count, "", "abcd", "abcdefg", "ééé😀", None) == [0, 1, 1, 1, 0]
    assert apply(spark, fn.strip, "  a b \n", "\r\n") == ["a b", ""]
    assert apply(spark, lambda v: fn.preview(v, 2, 5), "a\nb\nc", "abcdefgh", None) == ["a\nb", "abcde\n... (truncated)", ""]
    assert apply(spark, lambda v: fn.shortened(v, 3), "abc", "abcd") == ["abc", "abc..."]


def test_replies(spark):
    assert apply(spark, lambda v: fn.yes_or_no(v, "answer"), '{"answer": "yes"}', "{}", "x") == ["yes", "no", "no"]
    assert apply(spark, fn.finish_reason, "MAX_TOKENS", "x.LENGTH", "STOP") == ["max_output_reached"] * 2 + ["finished"]
    assert apply(spark, fn.chat_role, "user", "system", None) == ["user", "model", "model"]
    turns = spark.createDataFrame([([("user", "a"), ("system", "b")],)], "turns array<struct<role:string,content:string>>")
    got = turns.select(fn.chat_history(F.col("turns"), F.lit("go")).alias("h")).first()["h"]
    assert [tuple(x) for x in got] == [("user", "a"), ("model", "b"), ("user", "go")]


def test_tags(spark):
    df = spark.createDataFrame([(3, "x")], "i int, t string")
    assert df.select(fn.page_tag(F.col("i"), F.col("t"))).first()[0] == "<physical_index_3>\nx\n</physical_index_3>\n"


@pytest.mark.parametrize("line,level,title", [("# A", 1, "A"), ("###### B #", 6, "B #"), ("####### C", None, ""), ("#D", None, ""), ("# E F", 1, "E F")])
def test_headers(spark, line, level, title):
    df = spark.createDataFrame([(line,)], "t string").select(fn.header_level(F.col("t")), fn.header_title(F.col("t"))).first()
    assert tuple(df) == (level, title)
    assert bool(re.match(r"^(#{1,6})\s+(.+)$", line)) == (level is not None)
