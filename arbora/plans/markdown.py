"""Markdown documents to section trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Options, load
from ..config import reasoner as chosen_reasoner
from ..config import token_counter
from ..operators import markdown as md
from ..reasoner import RuleReasoner

NODE_COLUMNS = ["doc_id", "node_ord", "parent_ord", "depth", "node_id", "title", "line_num", "text", "n_tokens", "summary", "prefix_summary", "is_leaf"]


def build(docs: DataFrame, options: Options | dict | None = None, reasoner: RuleReasoner | None = None) -> DataFrame:
    """``docs`` (doc_id, text) as nodes.

    Without summaries node ids are always there, as numbers of list order from 1 unless ids are asked for, which count from
    0.  Summaries of short sections are their texts, and only long ones reach the reasoner; leaves have ``summary``, others
    ``prefix_summary``.
    """
    options = load(options)
    reasoner = reasoner or chosen_reasoner(options)
    sections = md.sections(md.lines(docs), token_counter(options))
    if options.if_thinning == "yes":
        sections = md.thinned(sections, options.min_token_threshold)
    nodes = md.with_leaves(md.with_depth(md.with_node_ids(md.with_parents(sections), 0 if options.if_add_node_id == "yes" else 1)))
    nodes = summarised(nodes, options.summary_token_threshold, reasoner) if options.if_add_node_summary == "yes" else nodes.withColumns({"summary": F.lit(None).cast("string"), "prefix_summary": F.lit(None).cast("string")})
    return nodes.select("doc_id", F.col("ord").alias("node_ord"), *NODE_COLUMNS[2:7], *(["text"] if options.if_add_node_text == "yes" else []), *NODE_COLUMNS[8:])


def summarised(nodes: DataFrame, threshold: int, reasoner: RuleReasoner) -> DataFrame:
    """``summary`` of leaves and ``prefix_summary`` of others."""
    both = reasoner.summary(nodes, "text", "said", F.col("n_tokens") < threshold)
    return both.withColumns({"summary": F.when(F.col("is_leaf"), F.col("said")), "prefix_summary": F.when(~F.col("is_leaf"), F.col("said"))}).drop("said")


def described(nodes: DataFrame, reasoner: RuleReasoner | None = None) -> DataFrame:
    """doc_id, description."""
    titles = F.transform(F.array_sort(F.collect_list(F.struct("node_ord", "title"))), lambda t: t["title"])
    return (reasoner or RuleReasoner()).description(nodes.groupBy("doc_id").agg(titles.alias("titles"))).select("doc_id", "description")
