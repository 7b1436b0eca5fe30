"""Tables with the structure of documents, made from plain ones by fixed formulas.

The driver's documents have no headings, tables of contents or files, so queries run over these.  ``SQL`` has the same
tables for DuckDB, as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SQL = {
    "doc_pages": """
  SELECT doc_id, i AS physical_index, l[i] AS text, CAST(length(l[i]) // 4 AS BIGINT) AS n_tokens
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, LATERAL unnest(range(1, len(l) + 1)) t(i)""",
    "md_lines": """
  SELECT doc_id, physical_index AS line_num,
    CASE WHEN physical_index % 11 = 5 THEN '```'
         WHEN (physical_index - 1) % 3 = 0 THEN concat(repeat('#', CAST(1 + (doc_id + (physical_index - 1) // 3) * 7 % 4 AS INT)), ' ', substr(text, 1, 40))
         ELSE text END AS line
  FROM doc_pages""",
    "toc_items": """
  SELECT doc_id, k AS list_index,
    concat(CAST(k // 4 + 1 AS VARCHAR), CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '.1' WHEN 2 THEN '.1.1' ELSE '.2' END) AS structure,
    substr(text, 1, 40) AS title, physical_index - doc_id % 7 AS page,
    CASE WHEN k % 5 = 4 THEN NULL ELSE physical_index END AS physical_index
  FROM (SELECT *, (physical_index - 1) // 3 AS k FROM doc_pages WHERE (physical_index - 1) % 3 = 0)""",
    "repo_files": """
  SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages""",
    "llm_raw": """
  SELECT event_id, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN props WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```')
    WHEN 2 THEN '{"k": None}' WHEN 3 THEN concat('{"k": ', CAST(event_id AS VARCHAR), ',}') ELSE 'not json' END AS raw FROM events""",
}
#: Ways to sections, each with pages that lead to it: contents with page numbers, with wrong ones, with too few, and large sections.
WAYS = ["numbers", "titles", "heads", "parts"]
_LONG = "These words come before a title and go on for a while, as nobody would take so long a line for the title of a section"


def _contents(way: str, spark: bool) -> dict[str, str]:
    """What the pages of a document with contents are made of, for one engine or the other.

    ``w`` is the document's own words.  Sections k = 0, 1, ... have codes 1, 1.1, 2, 2.1, ...; a few numbers are wrong or left
    out where contents have numbers, and all are wrong or most left out for the other ways.
    """
    div = "DIV" if spark else "//"
    many = "CASE WHEN k % 2 = 1 THEN 7 + doc_id % 3 ELSE 1 + (doc_id + k) % 3 END" if way == "parts" else "1 + (doc_id + k) % 3"
    said = {"numbers": "NOT (doc_id % 4 < 2 AND k IN (3, 4))", "titles": "true", "heads": "k < 3", "parts": "true"}[way]
    right = "first + doc_id % 5" + (" + CASE WHEN k = 1 AND doc_id % 2 = 0 THEN 2 ELSE 0 END" if way == "numbers" else "")
    two = {"numbers": "doc_id % 3 = 0 AND doc_id % 4 >= 2", "titles": "doc_id % 3 = 0", "heads": "false", "parts": "doc_id % 3 = 0"}[way]
    code = f"concat(CAST(k {div} 2 + 1 AS {'STRING' if spark else 'VARCHAR'}), CASE WHEN k % 2 = 1 THEN '.1' ELSE '' END)"
    title = "concat('Part ', doc_id, '-', k, 'x')"
    line = f"concat({code}, ' ', {title}, CASE WHEN {said} THEN concat(' ......... ', {'1 + (k * 5 + doc_id) % 7' if way == 'titles' else right}) ELSE '' END)"
    new, inner = "'\\n'" if spark else "chr(10)", "concat('Inner ', k, '.', j, ' x')"
    named = f"CASE WHEN (doc_id + 2 * k) % 5 = 0 THEN concat('{_LONG}', {new}, upper({title}), {new}, w) ELSE concat({title}, {new}, w) END"
    mention = f", CASE WHEN k = 2 THEN concat({new}, 'see Part ', doc_id, '-4x') ELSE '' END" if way == "numbers" else ""
    plain = "rpad(w, 100, ' and more of it')"
    other = f"CASE WHEN j % 2 = 0 THEN concat({inner}, {new}, w) ELSE {plain} END" if way == "parts" else plain
    return {"pages": many, "tocs": f"CASE WHEN {two} THEN 2 ELSE 1 END", "line": line, "new": new, "text": f"CASE WHEN j = 0 THEN concat({named}{mention}) ELSE {other} END"}


def contents_sql(way: str) -> str:
    x = _contents(way, spark=False)
    return f"""
  WITH base AS (
    SELECT doc_id, substr(regexp_replace(coalesce(text, ''), '[ \t\n\r0-9]+', ' ', 'g'), 1, 60) AS w, unnest(range(0, 6 + doc_id % 3)) AS k FROM documents
  ), many AS (
    SELECT *, {x["pages"]} AS c, {x["tocs"]} AS tocs, doc_id % 2 AS front FROM base
  ), sections AS (
    SELECT *, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - c + 1 AS first FROM many
  ), body AS (
    SELECT *, unnest(range(0, c)) AS j FROM sections
  )
  SELECT doc_id, front + tocs + first + j AS physical_index, {x["text"]} AS text FROM body
  UNION ALL SELECT doc_id, front + CASE WHEN k < 3 THEN 1 ELSE tocs END, string_agg({x["line"]}, {x["new"]} ORDER BY k) || CASE WHEN tocs = 2 AND min(k) = 0 THEN {x["new"]} ELSE '' END FROM sections GROUP BY doc_id, front, tocs, CASE WHEN k < 3 THEN 1 ELSE tocs END
  UNION ALL SELECT doc_id, 1, '{_LONG}' FROM sections WHERE k = 0 AND front = 1"""


SQL |= {f"contents_{way}": contents_sql(way) for way in WAYS}
_NEEDS = {"md_lines": ["doc_pages"], "toc_items": ["doc_pages"]}


def with_tables(names: list[str], query: str) -> str:
    """``query`` over the named tables, for DuckDB."""
    needed = list(dict.fromkeys(x for name in names for x in [*_NEEDS.get(name, []), name]))
    ctes = ",\n".join(f"{name} AS ({SQL[name]}\n)" for name in needed)
    query = query.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if query.startswith(start):
            return f"{start}{ctes},\n{query.removeprefix(start)}"
    return f"WITH {ctes}\n{query}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document is a page."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("physical_index"), "text", F.shiftright(F.length("text"), 2).cast("long").alias("n_tokens"))


def md_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line is a heading of level 1 to 4, the fifth of each eleven a fence."""
    line = F.expr("""
        CASE WHEN physical_index % 11 = 5 THEN '```'
             WHEN (physical_index - 1) % 3 = 0 THEN concat(repeat('#', CAST(1 + (doc_id + (physical_index - 1) DIV 3) * 7 % 4 AS INT)), ' ', substr(text, 1, 40))
             ELSE text END""")
    return doc_pages(spark, sf_dir).select("doc_id", F.col("physical_index").alias("line_num"), line.alias("line"))


def toc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-level sections at every third page; one in five has no page index."""
    k = doc_pages(spark, sf_dir).where("(physical_index - 1) % 3 = 0").withColumn("k", F.expr("(physical_index - 1) DIV 3"))
    structure = F.expr("concat(CAST(k DIV 4 + 1 AS STRING), CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '.1' WHEN 2 THEN '.1.1' ELSE '.2' END)")
    return k.select("doc_id", F.col("k").alias("list_index"), structure.alias("structure"), F.substring("text", 1, 40).alias("title"), (F.col("physical_index") - F.col("doc_id") % 7).alias("page"), F.when(F.col("k") % 5 != 4, F.col("physical_index")).alias("physical_index"))


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's host and path as a file."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


def llm_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies: plain, fenced, with None, with a trailing comma, and no JSON."""
    raw = F.expr("""
        CASE CAST(event_id % 5 AS INT) WHEN 0 THEN props WHEN 1 THEN concat('```json\\n', props, '\\n```')
          WHEN 2 THEN '{"k": None}' WHEN 3 THEN concat('{"k": ', CAST(event_id AS STRING), ',}') ELSE 'not json' END""")
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


def contents_pages(spark: SparkSession, sf_dir: str, way: str) -> DataFrame:
    """Documents with a cover or none, contents on a page or two, and sections of a few pages each, for one of WAYS."""
    x = _contents(way, spark=True)
    text, plain = F.coalesce("text", F.lit("")), lambda c: F.regexp_replace(c, r"[ \t\n\r0-9]+", " ")
    begun = plain(F.substring(text, 1, 400))  # if that leaves more than 60 characters, the rest changes none of them
    words = F.substring(F.when(F.length(begun) > 60, begun).otherwise(plain(text)), 1, 60)
    base = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"), F.explode(F.expr("sequence(0, CAST(5 + doc_id % 3 AS INT))")).alias("k"))
    many = base.withColumns({"c": F.expr(f"CAST({x['pages']} AS INT)"), "tocs": F.expr(x["tocs"]), "front": F.expr("CAST(doc_id % 2 AS INT)")})
    first = F.sum("c").over(Window.partitionBy("doc_id").orderBy("k")) - F.col("c") + 1
    sections = many.withColumn("first", first)
    body = sections.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    made = body.select("doc_id", (F.col("front") + F.col("tocs") + F.col("first") + F.col("j")).cast("int").alias("physical_index"), F.expr(x["text"]).alias("text"))
    on = F.when(F.col("k") < 3, 1).otherwise(F.col("tocs"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", F.expr(x["line"]).alias("line")))), lambda r: r["line"])
    end = F.when((F.col("tocs") == 2) & (F.min("k") == 0), F.lit("\n")).otherwise(F.lit(""))
    toc = sections.groupBy("doc_id", "front", "tocs", on.alias("on")).agg(F.concat(F.array_join(lines, "\n"), end).alias("text"))
    cover = sections.where("k = 0 and front = 1").select("doc_id", F.lit(1).alias("physical_index"), F.lit(_LONG).alias("text"))
    return made.unionByName(toc.select("doc_id", (F.col("front") + F.col("on")).cast("int").alias("physical_index"), "text")).unionByName(cover)
