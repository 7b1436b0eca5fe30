"""Queries over the driver's tables for each operator, with SQL for DuckDB beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from . import page_sql, sinks, staging
from .config import Options
from .functions import (
    base_name,
    chat_role,
    document_name,
    dots_to_colon,
    extract_json,
    fenced_json,
    finish_reason,
    first_tag,
    index_number,
    is_json,
    json_candidates,
    last_tag,
    page_number,
    page_tag,
    parent_code,
    preview,
    sanitize_name,
    shortened,
    stem,
    strip_fence,
    suffix,
    title_or_untitled,
    token_count,
    yes_or_no,
)
from .operators import batch, markdown, pages, repo, toc, tree
from .plans import markdown as markdown_plan
from .plans import pages as pages_plan
from .plans import repo as repo_plan
from .reasoner import RuleReasoner
from .sources import files, pdf
from .sources.convert import html_to_markdown

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Parameters small enough for the tables to have both cases of everything.
GROUP_TOKENS, MOST_PAGES, MOST_TOKENS, LEAST_TOKENS, SUMMARY_TOKENS, TOC_LIMIT = 200, 3, 100, 200, 50, 5


def query(tables: list[str] | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, and its SQL over the named derived tables."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = fx.with_tables(tables or [], sql) if tables else sql.strip()
        return f

    return register


# Markdown

_HEADERS = r"""
WITH f AS (
  SELECT *, starts_with(trim(line), '```') AS fence, sum(CASE WHEN starts_with(trim(line), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_num) AS fences FROM md_lines
), h AS (
  SELECT doc_id, line_num, line, CASE WHEN NOT fence AND fences % 2 = 0 AND regexp_matches(trim(line), '^#{1,6}\s+[^\n]+$') THEN CAST(length(regexp_extract(trim(line), '^(#{1,6})\s', 1)) AS INT) END AS level,
    trim(regexp_extract(trim(line), '^#{1,6}\s+([^\n]+)$', 1)) AS t FROM f
)"""
_SECTIONS = (
    _HEADERS
    + r""", n AS (
  SELECT *, sum(CASE WHEN level IS NOT NULL AND starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_num) - 1 AS ord FROM h
), s AS (
  SELECT doc_id, CAST(ord AS BIGINT) AS ord, arg_min(level, line_num) AS level, arg_min(t, line_num) AS title, min(line_num) AS line_num,
    regexp_replace(string_agg(line, chr(10) ORDER BY line_num), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS text
  FROM n WHERE ord >= 0 GROUP BY doc_id, ord
)"""
)
_SUBTREES = (
    _SECTIONS
    + r""", e AS (
  SELECT s.*, coalesce((SELECT min(z.ord) FROM s z WHERE z.doc_id = s.doc_id AND z.ord > s.ord AND z.level <= s.level), (SELECT max(z.ord) + 1 FROM s z WHERE z.doc_id = s.doc_id)) AS subtree_end FROM s
), c AS (
  SELECT e.doc_id, e.ord, any_value(e.level) AS level, any_value(e.title) AS title, any_value(e.line_num) AS line_num, any_value(e.text) AS text, any_value(e.subtree_end) AS subtree_end,
    CAST(length(string_agg(d.text, chr(10) ORDER BY d.ord)) // 4 AS BIGINT) AS subtree_tokens
  FROM e JOIN e d ON d.doc_id = e.doc_id AND d.ord >= e.ord AND d.ord < e.subtree_end GROUP BY e.doc_id, e.ord
)"""
)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(fx.md_lines(spark, sf_dir))


@query(["md_lines"], _HEADERS + " SELECT doc_id, line_num, level, t AS title FROM h WHERE level IS NOT NULL")
def md_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.headers(fx.md_lines(spark, sf_dir)).where("level is not null").select("doc_id", "line_num", "level", "title")


@query(["md_lines"], _SECTIONS + " SELECT doc_id, ord, level, title, line_num, text, CAST(length(text) // 4 AS BIGINT) AS n_tokens FROM s")
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sections(spark, sf_dir)


_PARENTS = "(SELECT max(p.ord) FROM s p WHERE p.doc_id = s.doc_id AND p.ord < s.ord AND p.level < s.level)"


@query(["md_lines"], _SECTIONS + f" SELECT doc_id, CAST(lpad(CAST(ord + 1 AS VARCHAR), CAST(greatest(4, length(CAST(ord + 1 AS VARCHAR))) AS INT), '0') AS VARCHAR) AS node_id, title, level, line_num, {_PARENTS} AS parent_ord FROM s")
def md_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = markdown.with_node_ids(markdown.with_parents(_sections(spark, sf_dir)))
    return nodes.select("doc_id", "node_id", "title", "level", "line_num", "parent_ord")


@query(["md_lines"], _SUBTREES + " SELECT doc_id, ord, CAST(subtree_end AS BIGINT) AS subtree_end, subtree_tokens FROM c")
def md_subtree_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.with_subtree_tokens(_sections(spark, sf_dir)).select("doc_id", "ord", F.col("subtree_end").cast("long").alias("subtree_end"), "subtree_tokens")


_THIN = (
    _SUBTREES
    + f"""
, k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c a WHERE a.doc_id = c.doc_id AND a.ord < c.ord AND a.subtree_end > c.ord AND a.subtree_tokens < {LEAST_TOKENS}))
, m AS (
  SELECT k.doc_id, k.ord, any_value(k.level) AS level, any_value(k.title) AS title, any_value(k.line_num) AS line_num, any_value(k.subtree_tokens) AS own, count(*) AS n, string_agg(d.text, chr(10) || chr(10) ORDER BY d.ord) AS text
  FROM k JOIN c d ON d.doc_id = k.doc_id AND d.ord >= k.ord AND d.ord < CASE WHEN k.subtree_tokens < {LEAST_TOKENS} THEN k.subtree_end ELSE k.ord + 1 END GROUP BY k.doc_id, k.ord
)
, z AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, level, title, line_num, text, CAST(length(text) // 4 AS BIGINT) AS n_tokens, CASE WHEN n > 1 THEN CAST(length(text) // 4 AS BIGINT) ELSE own END AS subtree_tokens FROM m
)"""
)


@query(["md_lines"], _THIN + " SELECT * FROM z")
def md_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.thinned(_sections(spark, sf_dir), LEAST_TOKENS)


@query(
    ["md_lines"],
    _SECTIONS
    + f""", l AS (SELECT *, NOT coalesce(lead(level) OVER (PARTITION BY doc_id ORDER BY ord) > level, false) AS is_leaf FROM s)
SELECT doc_id, ord, is_leaf, CASE WHEN is_leaf THEN CASE WHEN length(text) // 4 < {SUMMARY_TOKENS} THEN text ELSE substr(text, 1, 200) END END AS summary,
  CASE WHEN NOT is_leaf THEN CASE WHEN length(text) // 4 < {SUMMARY_TOKENS} THEN text ELSE substr(text, 1, 200) END END AS prefix_summary FROM l""",
)
def md_leaf_summary_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = markdown_plan.summarised(markdown.with_leaves(_sections(spark, sf_dir)), SUMMARY_TOKENS, RuleReasoner())
    return done.select("doc_id", "ord", "is_leaf", "summary", "prefix_summary")


@query(
    ["md_lines"],
    _SECTIONS
    + f""", p AS (SELECT *, {_PARENTS} AS parent_ord FROM s)
, RECURSIVE_DEPTH AS (SELECT a.doc_id, a.ord, (SELECT count(*) FROM p x WHERE x.doc_id = a.doc_id AND x.ord < a.ord AND NOT EXISTS (SELECT 1 FROM p y WHERE y.doc_id = a.doc_id AND y.ord > x.ord AND y.ord <= a.ord AND y.level <= x.level)) AS depth FROM p a)
SELECT p.doc_id, p.ord, repeat(' ', CAST(depth AS INT)) || title AS line FROM p JOIN RECURSIVE_DEPTH d ON p.doc_id = d.doc_id AND p.ord = d.ord""".replace("RECURSIVE_DEPTH", "depths"),
)
def md_outline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.outline(_sections(spark, sf_dir))


@query(
    ["md_lines"],
    _THIN
    + f""", l AS (
  SELECT z.*, (SELECT max(p.ord) FROM z p WHERE p.doc_id = z.doc_id AND p.ord < z.ord AND p.level < z.level) AS parent_ord,
    (SELECT count(*) FROM z x WHERE x.doc_id = z.doc_id AND x.ord < z.ord AND x.level < (SELECT min(y.level) FROM z y WHERE y.doc_id = z.doc_id AND y.ord > x.ord AND y.ord <= z.ord)) AS depth,
    NOT coalesce(lead(level) OVER (PARTITION BY doc_id ORDER BY ord) > level, false) AS is_leaf, CASE WHEN n_tokens < {SUMMARY_TOKENS} THEN text ELSE substr(text, 1, 200) END AS said FROM z
)
SELECT doc_id, ord AS node_ord, parent_ord, CAST(depth AS INT) AS depth, lpad(CAST(ord AS VARCHAR), CAST(greatest(4, length(CAST(ord AS VARCHAR))) AS INT), '0') AS node_id, title, line_num, text, n_tokens,
  CASE WHEN is_leaf THEN said END AS summary, CASE WHEN NOT is_leaf THEN said END AS prefix_summary, is_leaf FROM l""",
)
def md_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole Markdown plan, with thinning and summaries."""
    docs = fx.md_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return markdown_plan.build(docs, Options(if_thinning="yes", min_token_threshold=LEAST_TOKENS, summary_token_threshold=SUMMARY_TOKENS, if_add_node_text="yes"))


@query(["md_lines"], _SECTIONS + " SELECT doc_id, array_to_string(list(title ORDER BY ord)[1:3], '; ') AS description FROM s GROUP BY doc_id")
def md_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_plan.described(_sections(spark, sf_dir).withColumn("node_ord", F.col("ord")))


# Pages


@query(["doc_pages"], "SELECT doc_id, physical_index, n_tokens FROM doc_pages")
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_tokens(fx.doc_pages(spark, sf_dir).drop("n_tokens")).select("doc_id", "physical_index", "n_tokens")


def _pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a PDF file, its lines being pages; every third has no title."""

    def made(batches):
        import pandas as pd

        for batch in batches:
            for k in range(0, len(batch), 32):  # files are larger than their texts
                some = batch.iloc[k : k + 32]
                made_files = [pdf.written(text.split("\n"), f"Title {d}" if d % 3 else None) for d, text in zip(some["doc_id"], some["text"], strict=True)]
                yield pd.DataFrame({"path": [f"in/{d}.pdf" for d in some["doc_id"]], "content": made_files})

    files.small_batches(spark)
    return fx.table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(made, "path string, content binary")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(["doc_pages"], f"SELECT doc_id || '.pdf' AS doc_id, CAST(physical_index AS INT) AS physical_index, {_STRIP.format('text')} AS text, CAST(length({_STRIP.format('text')}) // 4 AS BIGINT) AS n_tokens, CAST(NULL AS VARCHAR) AS error FROM doc_pages")
def pdf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read from the bytes of PDF files."""
    return files.pages_of(_pdf_files(spark, sf_dir), lambda content: pdf.read(content)[0])


@query(None, "SELECT doc_id || '.pdf' AS doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Untitled' ELSE 'Title ' || doc_id END AS title FROM documents")
def pdf_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.titles_of(_pdf_files(spark, sf_dir))


_TAG = "'<physical_index_' || physical_index || '>' || chr(10) || text || chr(10) || '</physical_index_' || physical_index || '>' || chr(10)"


@query(["doc_pages"], f"SELECT doc_id, physical_index, {_TAG} AS tagged FROM doc_pages")
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.tagged(fx.doc_pages(spark, sf_dir)).select("doc_id", "physical_index", "tagged")


@query(["doc_pages"], "SELECT doc_id, count(*) AS n_pages, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM doc_pages GROUP BY doc_id")
def doc_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.totals(fx.doc_pages(spark, sf_dir))


@query(["doc_pages"], f"SELECT doc_id, string_agg({_TAG}, '' ORDER BY physical_index) AS text FROM doc_pages WHERE physical_index BETWEEN 2 AND 4 GROUP BY doc_id")
def page_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.between(fx.doc_pages(spark, sf_dir), 2, 4, with_tags=True)


_GROUPS = f"""
WITH RECURSIVE t AS (
  SELECT doc_id, max(physical_index) AS n, sum(n_tokens) AS total, list(n_tokens ORDER BY physical_index) AS tok FROM doc_pages GROUP BY doc_id
), p AS (
  SELECT *, ceil((total / ceil(total / {GROUP_TOKENS}.0) + {GROUP_TOKENS}) / 2.0) AS target FROM t WHERE total > {GROUP_TOKENS}
), r AS (
  SELECT doc_id, n, tok, target, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS group_no, CAST(0 AS BIGINT) AS first, CAST(0 AS HUGEINT) AS held, CAST(NULL AS BIGINT) AS done_first, CAST(NULL AS BIGINT) AS done_last FROM p
  UNION ALL
  SELECT doc_id, n, tok, target, i + 1, CASE WHEN held + tok[i + 1] > target THEN group_no + 1 ELSE group_no END,
    CASE WHEN held + tok[i + 1] > target THEN greatest(i - 1, 0) ELSE first END,
    CASE WHEN held + tok[i + 1] > target THEN CASE WHEN i > 0 THEN tok[i] ELSE 0 END ELSE held END + tok[i + 1],
    CASE WHEN held + tok[i + 1] > target THEN first END, CASE WHEN held + tok[i + 1] > target THEN i - 1 END
  FROM r WHERE i < n
), g AS (
  SELECT doc_id, group_no - 1 AS group_no, done_first + 1 AS first_pi, done_last + 1 AS last_pi FROM r WHERE done_first IS NOT NULL
  UNION ALL SELECT doc_id, group_no, first + 1, n FROM r WHERE i = n
  UNION ALL SELECT doc_id, 0, 1, n FROM t WHERE total <= {GROUP_TOKENS}
)"""


@query(["doc_pages"], _GROUPS + " SELECT * FROM g")
def page_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.groups(fx.doc_pages(spark, sf_dir), GROUP_TOKENS)


@query(["doc_pages"], _GROUPS + f" SELECT g.doc_id, group_no, first_pi, last_pi, coalesce(string_agg({_TAG}, '' ORDER BY physical_index), '') AS text FROM g LEFT JOIN doc_pages d ON d.doc_id = g.doc_id AND d.physical_index BETWEEN first_pi AND last_pi GROUP BY ALL")
def page_group_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fx.doc_pages(spark, sf_dir)
    return pages.grouped_text(pages.groups(made, GROUP_TOKENS), made)


# Trees of sections

_SPANS = """
WITH s AS (
  SELECT i.*, CASE WHEN list_index % 2 = 0 THEN 'yes' ELSE 'no' END AS appear_start FROM toc_items i WHERE physical_index IS NOT NULL
), x AS (
  SELECT s.doc_id, list_index, structure, title, physical_index AS start_index,
    CASE WHEN lead(list_index) OVER w IS NULL THEN c.n WHEN lead(appear_start) OVER w = 'yes' THEN lead(physical_index) OVER w - 1 ELSE lead(physical_index) OVER w END AS end_index
  FROM s JOIN (SELECT doc_id, count(*) AS n FROM doc_pages GROUP BY doc_id) c ON c.doc_id = s.doc_id WINDOW w AS (PARTITION BY s.doc_id ORDER BY list_index)
), q AS (
  SELECT x.*, (SELECT max(p.list_index) FROM x p WHERE p.doc_id = x.doc_id AND p.list_index < x.list_index AND contains(x.structure, '.') AND p.structure = regexp_replace(x.structure, '\\.[^.]*$', '')) AS parent FROM x
)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tree.with_index(fx.toc_items(spark, sf_dir)).withColumn("appear_start", F.when(F.col("list_index") % 2 == 0, "yes").otherwise("no"))
    ends = pages.totals(fx.doc_pages(spark, sf_dir)).select("doc_id", F.col("n_pages").alias("end_index"))
    return tree.with_spans(items, ends).select("doc_id", "list_index", "structure", "title", "start_index", "end_index")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.with_node_ids(tree.with_paths(tree.with_parents(_spans(spark, sf_dir))))


@query(["doc_pages", "toc_items"], _SPANS + " SELECT doc_id, list_index, parent FROM q")
def toc_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.with_parents(_spans(spark, sf_dir)).select("doc_id", "list_index", "parent")


@query(["doc_pages", "toc_items"], _SPANS + " SELECT doc_id, list_index, start_index, end_index FROM x")
def toc_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(spark, sf_dir).select("doc_id", "list_index", "start_index", "end_index")


@query(
    ["toc_items"],
    """
WITH i AS (SELECT doc_id, list_index, structure, title, physical_index FROM toc_items WHERE list_index > doc_id % 2)
, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY list_index) AS k FROM i)
SELECT * FROM i UNION ALL SELECT doc_id, list_index - 1, '0', 'Preface', 1 FROM f WHERE k = 1 AND physical_index > 1""",
)
def toc_preface(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.toc_items(spark, sf_dir).where("list_index > doc_id % 2")
    return tree.with_preface(items.select("doc_id", "list_index", "structure", "title", "physical_index"))


@query(["toc_items"], "SELECT doc_id, list_index, CASE WHEN physical_index > 10 + doc_id % 5 THEN NULL ELSE physical_index END AS physical_index FROM toc_items")
def toc_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.toc_items(spark, sf_dir)
    counts = items.select("doc_id").distinct().withColumn("n_pages", 10 + F.col("doc_id") % 5)
    return tree.truncated(items, counts).select("doc_id", "list_index", "physical_index")


_IDS = (
    _SPANS
    + """, o AS (
  SELECT q.*, list_filter([g.list_index, p.list_index, q.list_index], lambda x: x IS NOT NULL) AS path
  FROM q LEFT JOIN q p ON p.doc_id = q.doc_id AND p.list_index = q.parent LEFT JOIN q g ON g.doc_id = p.doc_id AND g.list_index = p.parent
), n AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS node_ord, CAST(len(path) - 1 AS INT) AS depth FROM o
)"""
)


@query(["doc_pages", "toc_items"], _IDS + " SELECT doc_id, list_index, depth, node_ord, lpad(CAST(node_ord AS VARCHAR), CAST(greatest(4, length(CAST(node_ord AS VARCHAR))) AS INT), '0') AS node_id FROM n")
def toc_node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("doc_id", "list_index", "depth", "node_ord", "node_id")


@query(["doc_pages", "toc_items"], _SPANS + " SELECT doc_id, list_index, title FROM q WHERE NOT EXISTS (SELECT 1 FROM q c WHERE c.doc_id = q.doc_id AND c.parent = q.list_index)")
def toc_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.leaves(tree.with_parents(_spans(spark, sf_dir))).select("doc_id", "list_index", "title")


@query(
    ["doc_pages", "toc_items"],
    _IDS
    + """ SELECT d.doc_id, '0001' AS node_id, coalesce(bool_or(n.node_ord IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n c WHERE c.doc_id = n.doc_id AND c.parent = n.list_index)), false) AS is_leaf
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n ON n.doc_id = d.doc_id AND n.node_ord = 1 GROUP BY d.doc_id""",
)
def toc_is_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = fx.table(spark, sf_dir, "documents").select("doc_id", F.lit("0001").alias("node_id")).distinct()
    return tree.is_leaf(_nodes(spark, sf_dir), ids)


@query(["doc_pages", "toc_items"], _IDS + " SELECT doc_id, node_ord, repeat(' ', depth) || title AS line FROM n")
def toc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.toc_lines(_nodes(spark, sf_dir))


@query(["doc_pages", "toc_items"], _IDS + " SELECT doc_id, list_index, title, depth, EXISTS (SELECT 1 FROM n c WHERE c.doc_id = n.doc_id AND c.parent = n.list_index) AND depth = 1 AS more FROM n WHERE depth <= 1")
def tree_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.limited(_nodes(spark, sf_dir), 1).select("doc_id", "list_index", "title", "depth", "more")


@query(["doc_pages", "toc_items"], _IDS + " SELECT doc_id, list_index, parent, node_ord, title, lpad(CAST(node_ord AS VARCHAR), CAST(greatest(4, length(CAST(node_ord AS VARCHAR))) AS INT), '0') AS node_id FROM n")
def description_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.description_view(_nodes(spark, sf_dir))


@query(["doc_pages", "toc_items"], _SPANS + " SELECT title, structure, doc_id FROM x")
def ordered_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.in_order(tree.without(_spans(spark, sf_dir), "start_index", "text"), ["title", "absent", "structure", "doc_id"])


@query(["doc_pages", "toc_items"], _SPANS + " SELECT doc_id, list_index, CASE WHEN length(title) > 12 THEN substr(title, 1, 12) || '...' ELSE title END AS title FROM x")
def shortened_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.shortened_strings(_spans(spark, sf_dir).select("doc_id", "list_index", "title"), 12)


_JSON = (
    _IDS
    + """, j AS (SELECT doc_id, list_index, parent, depth, rtrim(CAST(json_object('title', title, 'node_id', lpad(CAST(node_ord AS VARCHAR), CAST(greatest(4, length(CAST(node_ord AS VARCHAR))) AS INT), '0'), 'start_index', start_index, 'end_index', end_index) AS VARCHAR), '}') AS own FROM n)
, c2 AS (SELECT doc_id, parent, string_agg(own || '}', ',' ORDER BY list_index) AS below FROM j WHERE depth = 2 GROUP BY doc_id, parent)
, j1 AS (SELECT j.*, own || CASE WHEN below IS NULL THEN '}' ELSE ',"nodes":[' || below || ']}' END AS whole FROM j LEFT JOIN c2 ON c2.doc_id = j.doc_id AND c2.parent = j.list_index WHERE depth = 1)
, c1 AS (SELECT doc_id, parent, string_agg(whole, ',' ORDER BY list_index) AS below FROM j1 GROUP BY doc_id, parent)
, trees AS (SELECT j.doc_id, '[' || string_agg(own || CASE WHEN below IS NULL THEN '}' ELSE ',"nodes":[' || below || ']}' END, ',' ORDER BY list_index) || ']' AS json FROM j LEFT JOIN c1 ON c1.doc_id = j.doc_id AND c1.parent = j.list_index WHERE depth = 0 GROUP BY j.doc_id)"""
)


@query(["doc_pages", "toc_items"], _JSON + " SELECT doc_id, json FROM trees")
def tree_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.as_json(_nodes(spark, sf_dir), ["title", "node_id", "start_index", "end_index"])


@query(["doc_pages", "toc_items"], _JSON + """ SELECT '{"doc_name":"doc' || doc_id || '","structure":' || json || '}' AS value FROM trees""")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested trees written as lines of JSON, and read back."""
    nodes = _nodes(spark, sf_dir)
    names = nodes.select("doc_id").distinct().withColumn("doc_name", F.concat(F.lit("doc"), "doc_id"))
    path = staging.new_path(spark, "json-lines")
    sinks.write_json(sinks.results(nodes, names, ["title", "node_id", "start_index", "end_index"]), path)
    return spark.read.text(path)


@query(["doc_pages", "toc_items"], _IDS + " SELECT doc_id, list_index, path, title, node_ord FROM n")
def node_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes written in folders by document, and read back."""
    path = staging.new_path(spark, "node-table")
    sinks.write_nodes(_nodes(spark, sf_dir), path)
    return spark.read.parquet(path).select("doc_id", "list_index", "path", "title", "node_ord")


def _text_sql(text: str) -> str:
    return _SPANS + f""" SELECT x.doc_id, x.list_index, coalesce(string_agg({text}, '' ORDER BY p.physical_index), '') AS text
FROM x LEFT JOIN doc_pages p ON p.doc_id = x.doc_id AND p.physical_index BETWEEN x.start_index AND x.end_index GROUP BY x.doc_id, x.list_index"""


@query(["doc_pages", "toc_items"], _text_sql("p.text"))
def node_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_text(_spans(spark, sf_dir), fx.doc_pages(spark, sf_dir)).select("doc_id", "list_index", "text")


@query(["doc_pages", "toc_items"], _text_sql(_TAG.replace("physical_index |", "p.physical_index |").replace("<physical_index", "<physical_index").replace(" text ", " p.text ")))
def node_text_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.with_text(_spans(spark, sf_dir), fx.doc_pages(spark, sf_dir), with_tags=True).select("doc_id", "list_index", "text")


@query(
    ["doc_pages", "toc_items"],
    _SPANS
    + f""" SELECT x.doc_id, x.list_index, CAST(sum(p.n_tokens) AS BIGINT) AS span_tokens FROM x JOIN doc_pages p ON p.doc_id = x.doc_id AND p.physical_index BETWEEN x.start_index AND x.end_index
WHERE x.end_index - x.start_index > {MOST_PAGES} GROUP BY x.doc_id, x.list_index HAVING sum(p.n_tokens) >= {MOST_TOKENS}""",
)
def node_tokens_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.large(_spans(spark, sf_dir), fx.doc_pages(spark, sf_dir), MOST_PAGES, MOST_TOKENS).select("doc_id", "list_index", "span_tokens")


# Tables of contents

_ANSWERS = "SELECT *, CASE (doc_id + physical_index * 5) % 7 WHEN 0 THEN 'no' WHEN 3 THEN 'unsure' ELSE CASE WHEN physical_index > doc_id % 4 THEN 'yes' ELSE 'no' END END AS is_toc FROM doc_pages"


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.expr("CASE (doc_id + physical_index * 5) % 7 WHEN 0 THEN 'no' WHEN 3 THEN 'unsure' ELSE CASE WHEN physical_index > doc_id % 4 THEN 'yes' ELSE 'no' END END")
    return fx.doc_pages(spark, sf_dir).withColumn("is_toc", answer)


_RUN = f"""WITH a AS ({_ANSWERS}), f AS (SELECT doc_id, min(physical_index) AS first FROM a WHERE is_toc = 'yes' AND physical_index <= {TOC_LIMIT} GROUP BY doc_id)
, s AS (SELECT f.doc_id, first, (SELECT min(physical_index) FROM a WHERE a.doc_id = f.doc_id AND is_toc = 'no' AND physical_index > first) AS stop FROM f)
, r AS (SELECT a.* FROM a JOIN s ON a.doc_id = s.doc_id WHERE is_toc = 'yes' AND physical_index >= first AND (stop IS NULL OR physical_index < stop))"""


@query(["doc_pages"], _RUN + " SELECT doc_id, physical_index FROM r")
def toc_page_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.page_runs(_answered(spark, sf_dir), TOC_LIMIT).select("doc_id", "physical_index")


@query(["doc_pages"], _RUN + r" SELECT doc_id, max(physical_index) AS last_page, regexp_replace(regexp_replace(string_agg(text, '' ORDER BY physical_index), '\.{5,}', ': ', 'g'), '(?:\. ){5,}\.?', ': ', 'g') AS toc_text FROM r GROUP BY doc_id")
def toc_run_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = toc.page_runs(_answered(spark, sf_dir), TOC_LIMIT)
    return toc.last_pages(runs).join(toc.toc_text(runs), "doc_id")


@query(["doc_pages"], "SELECT doc_id, physical_index, CASE WHEN len(regexp_extract_all(text, '(?m)[0-9][ \\t]*$')) >= 3 THEN 'yes' ELSE 'no' END AS is_toc FROM doc_pages")
def toc_page_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RuleReasoner().toc_pages(fx.doc_pages(spark, sf_dir)).select("doc_id", "physical_index", "is_toc")


_PAIRS = """WITH x AS (SELECT doc_id, title, physical_index, list_index FROM toc_items WHERE physical_index >= 1 + doc_id % 3)
, pairs AS (SELECT x.doc_id, x.title, p.page, x.physical_index, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.list_index, p.list_index) AS ord FROM x JOIN toc_items p ON p.doc_id = x.doc_id AND p.title IS NOT DISTINCT FROM x.title)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.toc_items(spark, sf_dir)
    starts = fx.table(spark, sf_dir, "documents").select("doc_id", (1 + F.col("doc_id") % 3).alias("start_page"))
    return toc.page_pairs(items, items, starts)


@query(["doc_pages", "toc_items"], _PAIRS + " SELECT doc_id, title, page, physical_index FROM pairs")
def toc_page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).drop("ord")


_OFFSETS = _PAIRS + """
, d AS (SELECT doc_id, physical_index - page AS "offset", count(*) AS n, min(ord) AS first FROM pairs GROUP BY ALL)
, o AS (SELECT doc_id, "offset" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM d) WHERE k = 1)"""


@query(["doc_pages", "toc_items"], _OFFSETS + ' SELECT doc_id, "offset" FROM o')
def toc_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.page_offsets(_pairs(spark, sf_dir))


@query(["doc_pages", "toc_items"], _OFFSETS + ' SELECT i.doc_id, list_index, CASE WHEN "offset" IS NULL THEN page END AS page, CASE WHEN "offset" IS NULL THEN physical_index ELSE page + "offset" END AS physical_index FROM toc_items i LEFT JOIN o ON o.doc_id = i.doc_id')
def toc_apply_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.with_offset(fx.toc_items(spark, sf_dir), toc.page_offsets(_pairs(spark, sf_dir))).select("doc_id", "list_index", "page", "physical_index")


@query(
    ["doc_pages", "toc_items"],
    """SELECT doc_id, list_index, coalesce((SELECT arg_max(physical_index, list_index) FROM toc_items b WHERE b.doc_id = i.doc_id AND b.list_index < i.list_index AND b.physical_index IS NOT NULL), 0) AS prev_index,
  coalesce((SELECT arg_min(physical_index, list_index) FROM toc_items b WHERE b.doc_id = i.doc_id AND b.list_index > i.list_index AND b.physical_index IS NOT NULL), -1) AS next_index FROM toc_items i WHERE physical_index IS NULL""",
)
def toc_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.neighbours(fx.toc_items(spark, sf_dir)).select("doc_id", "list_index", "prev_index", "next_index")


_REPAIRS = """WITH w AS (SELECT *, (doc_id + list_index) % 3 = 0 AS wrong FROM toc_items)
, g AS (SELECT i.doc_id, i.list_index, i.title, coalesce((SELECT arg_max(physical_index, list_index) FROM w b WHERE b.doc_id = i.doc_id AND b.list_index < i.list_index AND NOT b.wrong AND b.physical_index IS NOT NULL), 0) AS prev_correct,
  coalesce((SELECT arg_min(physical_index, list_index) FROM w b WHERE b.doc_id = i.doc_id AND b.list_index > i.list_index AND NOT b.wrong AND b.physical_index IS NOT NULL), (SELECT count(*) FROM doc_pages p WHERE p.doc_id = i.doc_id)) AS next_correct FROM w i WHERE wrong)"""


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.toc_items(spark, sf_dir)
    return toc.repair_ranges(items, items.where("(doc_id + list_index) % 3 = 0"), pages.totals(fx.doc_pages(spark, sf_dir)))


@query(["doc_pages", "toc_items"], _REPAIRS + " SELECT doc_id, list_index, prev_correct, next_correct FROM g")
def toc_repair_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranged(spark, sf_dir).select("doc_id", "list_index", "prev_correct", "next_correct")


_SQUEEZE = "lower(regexp_replace({}, '[ \\t\\n\\r\\f\\v]+', '', 'g'))"


@query(
    ["doc_pages", "toc_items"],
    _REPAIRS
    + f""", v AS (SELECT g.doc_id, g.list_index, min(p.physical_index) AS fixed FROM g JOIN doc_pages p ON p.doc_id = g.doc_id AND p.physical_index BETWEEN prev_correct AND next_correct AND contains({_SQUEEZE.format("p.text")}, {_SQUEEZE.format("g.title")}) GROUP BY ALL)
SELECT i.doc_id, i.list_index, coalesce(v.fixed, i.physical_index) AS physical_index FROM toc_items i LEFT JOIN v ON v.doc_id = i.doc_id AND v.list_index = i.list_index""",
)
def toc_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, made = fx.toc_items(spark, sf_dir), fx.doc_pages(spark, sf_dir)
    ranged = _ranged(spark, sf_dir)
    rules = RuleReasoner()
    located = rules.locate(ranged, rules.searchable(ranged, made), "prev_correct", "next_correct")
    return toc.merged_fixes(items, located.withColumn("is_valid", F.col("fixed_index").isNotNull())).select("doc_id", "list_index", "physical_index")


_VERIFIED = f"""WITH v AS (SELECT i.doc_id, i.list_index, i.physical_index, CASE WHEN contains({_SQUEEZE.format("p.text")}, {_SQUEEZE.format("i.title")}) THEN 'yes' ELSE 'no' END AS answer, CASE WHEN starts_with({_SQUEEZE.format("p.text")}, {_SQUEEZE.format("i.title")}) THEN 'yes' ELSE 'no' END AS appear_start
  FROM (SELECT *, CASE WHEN list_index % 6 = 5 THEN physical_index + 1 ELSE physical_index END AS physical_index FROM toc_items) i LEFT JOIN doc_pages p ON p.doc_id = i.doc_id AND p.physical_index = i.physical_index)
, c AS (SELECT doc_id, arg_max(physical_index, list_index) FILTER (physical_index IS NOT NULL) AS last, count(physical_index) AS n, count(*) FILTER (physical_index IS NOT NULL AND answer = 'yes') AS good FROM v GROUP BY doc_id)
, a AS (SELECT c.doc_id, CASE WHEN last IS NULL OR last < n_pages / 2 OR n = 0 THEN 0.0 ELSE CAST(good AS DOUBLE) / n END AS accuracy, CASE WHEN last IS NULL OR last < n_pages / 2 THEN 0 ELSE n - good END AS n_wrong FROM c JOIN (SELECT doc_id, count(*) AS n_pages FROM doc_pages GROUP BY doc_id) t ON t.doc_id = c.doc_id)""".replace("SELECT *, CASE WHEN list_index % 6", "SELECT * EXCLUDE (physical_index), CASE WHEN list_index % 6")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.toc_items(spark, sf_dir).withColumn("physical_index", F.when(F.col("list_index") % 6 == 5, F.col("physical_index") + 1).otherwise(F.col("physical_index")))
    return toc.with_page_text(items, fx.doc_pages(spark, sf_dir))


@query(["doc_pages", "toc_items"], _VERIFIED + " SELECT doc_id, list_index, answer FROM v")
def toc_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RuleReasoner().title_appears(_checked(spark, sf_dir)).select("doc_id", "list_index", "answer")


@query(["doc_pages", "toc_items"], _VERIFIED + " SELECT doc_id, accuracy, CAST(n_wrong AS BIGINT) AS n_wrong, CASE WHEN accuracy = 1 AND n_wrong = 0 THEN 'accept' WHEN accuracy > 0.6 AND n_wrong > 0 THEN 'repair' ELSE 'fall_back' END AS decision FROM a")
def toc_accuracy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    verified = RuleReasoner().title_appears(_checked(spark, sf_dir))
    return toc.gate(toc.accuracy(verified, pages.totals(fx.doc_pages(spark, sf_dir))))


@query(["doc_pages", "toc_items"], _VERIFIED + " SELECT doc_id, list_index, appear_start FROM v")
def toc_start_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RuleReasoner().title_starts(_checked(spark, sf_dir)).select("doc_id", "list_index", "appear_start")


@query(["toc_items"], "SELECT doc_id, list_index FROM (SELECT doc_id, list_index, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || ':' || list_index || ':0'), list_index) AS k FROM toc_items) WHERE k <= 5")
def docs_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five items of each document by a seeded digest."""
    return toc.sampled(fx.toc_items(spark, sf_dir), 5).select("doc_id", "list_index")


#: No page of these documents is a table of contents, so sections are the pages that begin with a short line, which is all
#: such a page has; and what lies in a section has no further ones, so nothing is split off.
_INDEX = r"""
WITH p AS (
  SELECT doc_id, physical_index, text, regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS head, max(physical_index) OVER (PARTITION BY doc_id) AS n_pages FROM doc_pages
), f AS (
  SELECT doc_id, physical_index, head AS title, n_pages, row_number() OVER (PARTITION BY doc_id ORDER BY physical_index) - 1 AS k FROM p WHERE head <> '' AND length(head) <= 80
), g AS (
  SELECT f.*, (SELECT max(physical_index) FROM f z WHERE z.doc_id = f.doc_id) >= n_pages / 2 AS late FROM f
), i AS (
  SELECT doc_id, physical_index, title, n_pages, CAST(k AS BIGINT) AS list_index FROM g WHERE late
  UNION ALL SELECT doc_id, 1, 'Preface', n_pages, -1 FROM g WHERE late AND k = 0 AND physical_index > 1
)
SELECT doc_id, [list_index] AS path, title, CAST(physical_index AS INT) AS start_index, 0 AS depth, true AS is_leaf,
  CAST(row_number() OVER w - 1 AS BIGINT) AS node_ord, lpad(CAST(row_number() OVER w - 1 AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER w - 1 AS VARCHAR))) AS INT), '0') AS node_id,
  CAST(CASE WHEN lead(list_index) OVER w IS NULL THEN n_pages ELSE lead(physical_index) OVER w - 1 END AS BIGINT) AS end_index,
  substr((SELECT coalesce(string_agg(p.text, '' ORDER BY p.physical_index), '') FROM p WHERE p.doc_id = i.doc_id AND p.physical_index BETWEEN i.physical_index AND i.last_page), 1, 200) AS summary
FROM (SELECT *, CASE WHEN lead(list_index) OVER v IS NULL THEN n_pages ELSE lead(physical_index) OVER v - 1 END AS last_page FROM i WINDOW v AS (PARTITION BY doc_id ORDER BY list_index)) i WINDOW w AS (PARTITION BY doc_id ORDER BY list_index)"""


@query(["doc_pages"], _INDEX)
def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole page plan, with the rules as the reasoner."""
    made = fx.doc_pages(spark, sf_dir).select("doc_id", F.col("physical_index").cast("int").alias("physical_index"), "text")
    options = Options(toc_check_page_num=TOC_LIMIT, max_page_num_each_node=MOST_PAGES, max_token_num_each_node=MOST_TOKENS)
    return pages_plan.build(made, options)


def _page_plan(way: str) -> Query:
    options = Options(toc_check_page_num=TOC_LIMIT, max_page_num_each_node=MOST_PAGES, max_token_num_each_node=MOST_TOKENS)
    plan = page_sql.page_plan(TOC_LIMIT, MOST_PAGES, MOST_TOKENS).replace("contents_pages", f"contents_{way}")

    @query([f"contents_{way}"], plan)
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pages_plan.build(fx.contents_pages(spark, sf_dir, way), options)

    return f


# Documents with contents, whose sections come by one way each: numbers, titles, heads of pages, and parts of large sections.
for _way in fx.WAYS:
    QUERIES[f"page_index_by_{_way}"] = QUERIES.pop((_f := _page_plan(_way)).__name__)
    ORACLES[f"page_index_by_{_way}"] = ORACLES.pop(_f.__name__)


# Scalars


@query(
    ["llm_raw"],
    r"""SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 2 THEN '{"k": null}' WHEN 3 THEN '{"k": ' || event_id || ',}' WHEN 4 THEN 'not json' ELSE (SELECT props FROM events e WHERE e.event_id = llm_raw.event_id) END AS body,
  event_id % 5 <> 4 AS parsed, CASE WHEN event_id % 5 IN (0, 1) THEN CAST(json_extract((SELECT props FROM events e WHERE e.event_id = llm_raw.event_id), '$.k') AS BIGINT) WHEN event_id % 5 = 3 THEN event_id END AS k FROM llm_raw""",
)
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = json_candidates(F.col("raw"))
    made = fx.llm_raw(spark, sf_dir)
    return made.select("event_id", fenced_json(F.col("raw")).alias("body"), (is_json(first) | is_json(second)).alias("parsed"), extract_json(F.col("raw"), "k long")["k"].alias("k"))


@query(["llm_raw"], "SELECT event_id, CASE WHEN event_id % 5 = 1 THEN (SELECT props FROM events e WHERE e.event_id = llm_raw.event_id) ELSE raw END AS body FROM llm_raw")
def json_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.llm_raw(spark, sf_dir).select("event_id", strip_fence(F.col("raw")).alias("body"))


@query(None, "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(event_id AS INT) END AS n FROM events")
def index_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE CAST(event_id % 3 AS INT) WHEN 0 THEN concat('<physical_index_', event_id, '>') WHEN 1 THEN concat('physical_index_', event_id) ELSE concat('page ', event_id) END")
    return fx.table(spark, sf_dir, "events").select("event_id", index_number(raw).alias("n"))


@query(None, "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(event_id AS INT) END AS n, CASE event_id % 3 WHEN 0 THEN event_id || '' WHEN 1 THEN ' ' || event_id || ' ' ELSE 'p. ' || event_id END AS page_raw FROM events")
def page_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE CAST(event_id % 3 AS INT) WHEN 0 THEN concat('', event_id) WHEN 1 THEN concat(' ', event_id, ' ') ELSE concat('p. ', event_id) END")
    return fx.table(spark, sf_dir, "events").select("event_id", page_number(raw).alias("n"), raw.alias("page_raw"))


_DOTS = "CASE CAST(list_index % 4 AS INT) WHEN 0 THEN '.....' WHEN 1 THEN '. . . . . ' WHEN 2 THEN '. . . . . .' ELSE '....' END"


@query(["toc_items"], rf"SELECT doc_id, list_index, regexp_replace(regexp_replace(title || {_DOTS} || page, '\.{{5,}}', ': ', 'g'), '(\. ){{5,}}\.?', ': ', 'g') AS line FROM toc_items")
def leader_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.toc_items(spark, sf_dir).select("doc_id", "list_index", dots_to_colon(F.concat("title", F.expr(_DOTS), "page")).alias("line"))


@query(["repo_files"], "SELECT page_id, replace(path, '/', '-') AS name FROM repo_files")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.repo_files(spark, sf_dir).select("page_id", sanitize_name(F.col("path")).alias("name"))


@query(["doc_pages"], "SELECT doc_id, CAST(coalesce(min(physical_index) FILTER (physical_index > 2), -1) AS INT) AS first_tag, CAST(coalesce(max(physical_index) FILTER (physical_index > 2), -1) AS INT) AS last_tag FROM doc_pages GROUP BY doc_id")
def first_last_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.common import joined_in_order

    tagged = F.when(F.col("physical_index") > 2, page_tag(F.col("physical_index"), F.col("text"))).otherwise(F.col("text"))
    whole = fx.doc_pages(spark, sf_dir).groupBy("doc_id").agg(joined_in_order(F.col("physical_index"), tagged).alias("text"))
    return whole.select("doc_id", first_tag(F.col("text")).alias("first_tag"), last_tag(F.col("text")).alias("last_tag"))


@query(["toc_items"], r"SELECT doc_id, list_index, CASE WHEN contains(structure, '.') THEN regexp_extract(structure, '^(.*)\.[^.]*$', 1) END AS parent_code FROM toc_items")
def parent_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.toc_items(spark, sf_dir).select("doc_id", "list_index", parent_code(F.col("structure")).alias("parent_code"))


@query(None, "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'model' END AS role, text AS content FROM conversations")
def chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", chat_role(F.col("role")).alias("role"), F.col("text").alias("content"))


@query(None, "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'finished' ELSE 'max_output_reached' END AS reason FROM events")
def finish_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'FinishReason.MAX_TOKENS' WHEN 1 THEN 'LENGTH' ELSE 'STOP' END")
    return fx.table(spark, sf_dir, "events").select("event_id", finish_reason(raw).alias("reason"))


@query(None, "SELECT doc_id, CASE WHEN length(h) > 150 THEN substr(h, 1, 150) || chr(10) || '... (truncated)' ELSE h END AS preview, CAST(length(text) // 4 AS BIGINT) AS n_tokens, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS short FROM (SELECT *, array_to_string(string_split(text, chr(10))[1:3], chr(10)) AS h FROM documents)")
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return fx.table(spark, sf_dir, "documents").select("doc_id", preview(text, 3, 150).alias("preview"), token_count(text).alias("n_tokens"), shortened(text).alias("short"))


@query(
    ["repo_files"],
    r"SELECT page_id, n AS name, CASE WHEN length(n) > 1 AND instr(substr(n, 2), '.') > 0 AND NOT ends_with(n, '.') THEN regexp_replace(n, '\.[^.]+$', '') ELSE n END AS stem, CASE WHEN length(n) > 1 AND instr(substr(n, 2), '.') > 0 AND NOT ends_with(n, '.') THEN lower(regexp_extract(n, '(\.[^.]+)$', 1)) ELSE '' END AS suffix, CASE WHEN n = '' THEN 'Untitled' ELSE n END AS title, CASE WHEN page_id > 10 THEN n ELSE replace(path, '/', '-') END AS document FROM (SELECT page_id, path, regexp_extract(path, '[^/]*$') AS n FROM repo_files)",
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    given = F.when(F.col("page_id") > 10, path)  # the others are streams without a path
    return fx.repo_files(spark, sf_dir).select("page_id", base_name(path).alias("name"), stem(path).alias("stem"), suffix(path).alias("suffix"), title_or_untitled(base_name(path)).alias("title"), document_name(given, path).alias("document"))


_SAID = "CASE event_id % 5 WHEN 0 THEN '{\"answer\": \"yes\"}' WHEN 1 THEN '```json' || chr(10) || '{\"why\": \"' || event_id || '\", \"answer\": \"no\"}' || chr(10) || '```' WHEN 2 THEN '{\"answer\": None}' WHEN 3 THEN '{\"other\": \"yes\"}' ELSE 'no JSON' END"


@query(None, f"SELECT event_id, {_SAID} AS raw, CASE WHEN event_id % 5 = 0 THEN 'yes' ELSE 'no' END AS answer FROM events")
def yes_no_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr(_SAID.replace("event_id % 5", "CAST(event_id % 5 AS INT)").replace("chr(10)", "'\\n'"))
    return fx.table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), yes_or_no(raw, "answer").alias("answer"))


# Files


@query(
    ["md_lines"],
    _SECTIONS.replace("FROM md_lines", "FROM (SELECT d.lang AS doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY m.doc_id, m.line_num) AS line_num, m.line FROM md_lines m JOIN documents d ON d.doc_id = m.doc_id)")
    + " SELECT doc_id AS lang, count(*) AS sections, CAST(sum(length(text)) AS BIGINT) AS characters, min(line_num) AS first_line, arg_max(title, ord) AS last_title FROM s GROUP BY doc_id",
)
def markdown_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown documents, one of each language in files of its parts, written, scanned and cut into sections."""
    path = staging.new_path(spark, "markdown-files")
    lines = fx.md_lines(spark, sf_dir).join(fx.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    lines.repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id", "line_num").select("lang", "line").write.partitionBy("lang").option("compression", "none").text(path)
    found = markdown.sections_of_long(files.markdown_lines(spark, f"{path}/*/*.txt", F.regexp_extract("path", "/lang=([^/]*)/", 1)))
    return found.groupBy(F.col("doc_id").alias("lang")).agg(F.count("*").alias("sections"), F.sum(F.length("text")).cast("long").alias("characters"), F.min("line_num").alias("first_line"), F.max_by("title", "ord").alias("last_title"))


@query(
    None,
    """WITH f AS (SELECT DISTINCT lang, source FROM documents)
SELECT '' AS path, CAST(0 AS BIGINT) AS file_count, (SELECT count(DISTINCT lang) FROM f) AS subdir_count, 0 AS depth
UNION ALL SELECT 'lang=' || lang, 0, count(*), 1 FROM f GROUP BY lang
UNION ALL SELECT 'lang=' || lang || '/source=' || source, 1, 0, 2 FROM f""",
)
def repo_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of folders of text files, written and scanned as a repository."""
    path = staging.new_path(spark, "files")
    docs = fx.table(spark, sf_dir, "documents").select("lang", "source", F.lit("x").alias("value"))
    docs.distinct().repartition("lang", "source").write.partitionBy("lang", "source").text(path)
    found = repo.directories(repo.included(files.repository(spark, path, "r"), ["*.txt"], ["_*"]))
    return found.select("path", "file_count", "subdir_count", "depth")


# Repositories and folders

REPO_INCLUDE, REPO_EXCLUDE = ["*.html", "*[02468]"], ["*.example.org/de/*", "*spam*"]
_KEPT = r"""WITH kept AS (SELECT page_id, 'web' AS repo_id, path FROM repo_files WHERE (ends_with(path, '.html') OR regexp_matches(path, '[02468]$'))
  AND NOT regexp_matches(path, '\.example\.org/de/') AND NOT contains(path, 'spam'))
, up AS (SELECT repo_id, path, string_split(path, '/') AS parts FROM kept)
, dirs AS (SELECT repo_id, array_to_string(parts[1:k], '/') AS path, CAST(count(*) FILTER (k = len(parts) - 1) AS BIGINT) AS file_count FROM up, LATERAL unnest(range(0, len(parts))) t(k) GROUP BY ALL)
, d AS (SELECT a.repo_id, a.path, CASE WHEN a.path <> '' THEN regexp_replace(a.path, '/?[^/]*$', '') END AS parent_path, CASE WHEN a.path = '' THEN 0 ELSE CAST(len(string_split(a.path, '/')) AS INT) END AS depth,
  nullif(regexp_extract(a.path, '[^/]*$'), '') AS title, file_count, (SELECT count(*) FROM dirs b WHERE b.path <> '' AND regexp_replace(b.path, '/?[^/]*$', '') = a.path) AS subdir_count FROM dirs a)"""


def _repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.repo_files(spark, sf_dir).withColumn("repo_id", F.lit("web"))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.included(_repo(spark, sf_dir), REPO_INCLUDE, REPO_EXCLUDE)


@query(["repo_files"], _KEPT + " SELECT page_id, path FROM kept")
def repo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir).select("page_id", "path")


@query(["repo_files"], _KEPT + " SELECT * FROM d")
def repo_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.directories(_kept(spark, sf_dir))


@query(
    ["repo_files"],
    _KEPT
    + """, o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN path = '' THEN [] ELSE [{'low': lower(p), 'name': p} FOR p IN string_split(path, '/')] END) - 1 AS ord FROM d)
SELECT repo_id, ord, lpad(CAST(ord AS VARCHAR), CAST(greatest(4, length(CAST(ord AS VARCHAR))) AS INT), '0') AS node_id, title, path, 'directory' AS type, '' AS summary, file_count, subdir_count FROM o""",
)
def repo_flat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.flat_index(repo.directories(_kept(spark, sf_dir)))


@query(["repo_files"], _KEPT + " SELECT repo_id, CAST(sum(file_count) AS BIGINT) AS total_files, count(*) AS total_directories FROM d GROUP BY repo_id")
def repo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo_plan.statistics(_repo(spark, sf_dir), REPO_INCLUDE, REPO_EXCLUDE)


@query(["repo_files"], _KEPT + " SELECT path, depth, file_count, subdir_count, depth = 1 AND subdir_count > 0 AS more FROM d WHERE depth <= 1")
def repo_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.shown(repo.directories(_kept(spark, sf_dir)), 1).select("path", "depth", "file_count", "subdir_count", "more")


@query(
    ["repo_files"],
    _KEPT
    + """, l AS (SELECT repo_id, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY lower(regexp_extract(path, '[^/]*$')), regexp_extract(path, '[^/]*$')) - 1 AS ord FROM kept)
SELECT repo_id, dir AS path, 'Files: ' || string_agg(name, ', ' ORDER BY ord) FILTER (ord < 20) || CASE WHEN count(*) > 20 THEN chr(10) || chr(10) || '... and ' || (count(*) - 20) || ' more files' ELSE '' END AS context FROM l GROUP BY repo_id, dir""",
)
def dir_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repo.contexts(_kept(spark, sf_dir))


@query(
    ["repo_files"],
    _KEPT
    + """, t AS (SELECT path, CASE WHEN depth % 2 = 0 THEN '' ELSE 'about ' || path || repeat(chr(10) || 'more', 40) END AS head, 'from ' || path AS init FROM d)
, h AS (SELECT path, CASE WHEN head <> '' THEN '=== README.md ===' || chr(10) || array_to_string(string_split(head, chr(10))[1:30], chr(10)) ELSE '=== __init__.py ===' || chr(10) || init END AS head FROM t)
, l AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY lower(regexp_extract(path, '[^/]*$')), regexp_extract(path, '[^/]*$')) - 1 AS ord FROM kept)
, x AS (SELECT dir AS path, 'Files: ' || string_agg(name, ', ' ORDER BY ord) FILTER (ord < 20) || CASE WHEN count(*) > 20 THEN chr(10) || chr(10) || '... and ' || (count(*) - 20) || ' more files' ELSE '' END AS context FROM l GROUP BY dir)
SELECT 'web' AS repo_id, h.path, h.head || coalesce(chr(10) || chr(10) || x.context, '') AS context FROM h LEFT JOIN x ON x.path = h.path""",
)
def dir_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts that begin with the first describing file of a directory that has some text."""
    kept = _kept(spark, sf_dir)
    dirs = repo.directories(kept).select("repo_id", "path", "depth")
    name = lambda n: F.when(F.col("path") == "", F.lit(n)).otherwise(F.concat("path", F.lit("/" + n)))
    readme = dirs.select("repo_id", name("README.md").alias("path"), F.when(F.col("depth") % 2 == 0, "").otherwise(F.concat(F.lit("about "), "path", F.repeat(F.lit("\nmore"), 40))).alias("text"))
    init = dirs.select("repo_id", name("__init__.py").alias("path"), F.concat(F.lit("from "), "path").alias("text"))
    return repo.contexts(kept, readme.unionByName(init))


def _summaries_sql(deepest: int) -> str:
    """Contexts, and from the deepest directories up their beginnings, each with those of the directories below it."""
    parts = [_KEPT + """, l AS (SELECT repo_id, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY lower(regexp_extract(path, '[^/]*$')), regexp_extract(path, '[^/]*$')) - 1 AS ord FROM kept)
, x AS (SELECT dir AS path, 'Files: ' || string_agg(name, ', ' ORDER BY ord) FILTER (ord < 20) || CASE WHEN count(*) > 20 THEN chr(10) || chr(10) || '... and ' || (count(*) - 20) || ' more files' ELSE '' END AS context FROM l GROUP BY dir)"""]
    for depth in range(deepest, -1, -1):
        below = f"(SELECT string_agg('- ' || title || ': ' || summary, chr(10) ORDER BY k) FROM (SELECT *, row_number() OVER (PARTITION BY parent_path ORDER BY lower(title), title) AS k FROM s{depth + 1} WHERE summary <> '') b WHERE b.parent_path = d.path AND k <= 10)" if depth < deepest else "NULL"
        parts.append(f"""s{depth} AS (SELECT d.*, CASE WHEN context IS NULL THEN '' ELSE substr(context || coalesce(chr(10) || chr(10) || 'Subdirectories:' || chr(10) || {below}, ''), 1, 200) END AS summary FROM d LEFT JOIN x ON x.path = d.path WHERE depth = {depth})""")
    every = " UNION ALL ".join(f"SELECT * FROM s{depth}" for depth in range(deepest + 1))
    return ", ".join(parts) + f""", o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN path = '' THEN [] ELSE [{{'low': lower(p), 'name': p}} FOR p IN string_split(path, '/')] END) - 1 AS ord FROM ({every}))
SELECT repo_id, ord, lpad(CAST(ord AS VARCHAR), CAST(greatest(4, length(CAST(ord AS VARCHAR))) AS INT), '0') AS node_id, title, path, 'directory' AS type, summary, file_count, subdir_count FROM o"""


@query(["repo_files"], _summaries_sql(6))
def repo_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repository plan with directory summaries from the bottom up."""
    return repo_plan.build(_repo(spark, sf_dir), None, REPO_INCLUDE, REPO_EXCLUDE, RuleReasoner())


_NAMED = "SELECT event_id, 'in/f' || event_id || CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '.markdown' WHEN 3 THEN '.Docx' WHEN 4 THEN '.html' ELSE '.zip' END AS path, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'pdf' WHEN 1 THEN 'markdown' WHEN 2 THEN 'markdown' WHEN 3 THEN 'docling' WHEN 4 THEN 'docling' ELSE 'unsupported' END AS fmt FROM events"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.expr("CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '.markdown' WHEN 3 THEN '.Docx' WHEN 4 THEN '.html' ELSE '.zip' END")
    return batch.classified(fx.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("in/f"), "event_id", end).alias("path")))


@query(None, f"SELECT fmt, count(*) AS n FROM ({_NAMED}) GROUP BY fmt")
def batch_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.counts(_named(spark, sf_dir))


@query(None, f"SELECT path, 'f' || event_id || '_' || lower(regexp_extract(path, '([^.]*)$', 1)) || '_structure.json' AS output FROM ({_NAMED})")
def batch_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.output_names(_named(spark, sf_dir)).select("path", "output")


@query(None, f"SELECT count(*) AS total, count(*) FILTER (event_id % 7 > 1) AS success, count(*) FILTER (event_id % 7 = 0) AS failed, count(*) FILTER (event_id % 7 = 1) AS skipped FROM ({_NAMED}) WHERE fmt <> 'unsupported'")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.expr("CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'success' END")
    return batch.statistics(_named(spark, sf_dir).withColumn("status", status))


def _html_sql() -> str:
    text = "html"
    for tag in ("script", "style", "nav", "head"):
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '(?is)<!--.*?-->|<!doctype[^>]*>', '', 'g'), '\s+', ' ', 'g')"
    for level in range(1, 7):
        text = rf"regexp_replace({text}, '(?i)<h{level}\b[^>]*>\s*', chr(10) || chr(10) || '{'#' * level} ', 'g')"
    text = rf"regexp_replace({text}, '(?i)\s*</h[1-6]\s*>|\s*</?(p|div|article|section|ul|ol|table|tr|body|html)\b[^>]*>\s*', chr(10) || chr(10), 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '(?i)\s*<br\s*/?>\s*', chr(10), 'g'), '(?i)\s*<li\b[^>]*>\s*', chr(10) || '- ', 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    text = rf"regexp_replace(regexp_replace({text}, ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"SELECT page_id, regexp_replace({text}, '^\s+|\s+$', '', 'g') AS markdown FROM pages"


@query(None, _html_sql())
def html_to_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").select("page_id", html_to_markdown(F.col("html")).alias("markdown"))


@query(None, "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY event_type")
def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps added to a log in two goes, and read back by kind."""
    path = staging.new_path(spark, "steps")
    steps = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("level"), F.col("props").alias("payload"))
    valued = F.col("payload").isNotNull()
    sinks.append_events(steps.where(valued), path)
    sinks.append_events(steps.where(~valued), path)
    return spark.read.parquet(path).groupBy(F.col("level").alias("event_type")).agg(F.count("*").alias("n"), F.min("seq").alias("first"))


def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of Markdown documents: sections with ids and parents."""
    return md_tree(spark, sf_dir)

