"""URL filters with redirect equivalence, with DataFrame operations only.

A url has the verdict of the longest rule that fits it.  Redirects and canonical links make urls aliases of each other:
connected components over these edges carry block decisions to urls that no rule fits, unless a url of the component is
allowed by a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, staged
from .graph import components

# The rules of the contract, as (verdict, host/path).
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = r"(?is)<(?:link|meta)\b[^>]*>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; without ``://`` empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query: urls that differ in scheme or fragment are the same page.  Null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule (a struct of length, rule and verdict) that fits, else null.  Rules are a list that the caller holds."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        of, slash, path_start = rule.partition("/")
        by_host.setdefault(of, []).append((slash + path_start, rule, verdict))
    entries = []
    for of, own in by_host.items():
        structs = [F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(start).alias("start")) for start, rule, verdict in own]
        entries += [F.lit(of), F.array(*structs)]
    if not entries:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    known = F.create_map(*entries)
    labels = F.split(host, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.flatten(F.transform(ends, lambda e: F.coalesce(F.try_element_at(known, e), F.array().cast("array<struct<length:int,rule:string,verdict:string,start:string>>"))))
    best = F.array_max(F.filter(fitting, lambda r: F.startswith(path, r["start"])))
    return F.when(best.isNotNull(), F.struct(best["length"].alias("length"), best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def with_rule(urls: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``r``, the longest rule that fits.

    A list becomes part of the expression.  A table (verdict, rule), of any size, is joined on the ends of hosts, for each
    different host and path once; the join is a plain one, so that ends which many hosts have are split at run time.
    """
    if not isinstance(rules, DataFrame):
        return urls.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    text = F.col("rule")
    known = rules.where(text.contains("/")).select(F.substring_index(text, "/", 1).alias("end"), F.substring(text, F.locate("/", text), F.length(text)).alias("start"), F.length(text).alias("length"), "rule", "verdict")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = urls.select("host", "path").distinct().select("host", "path", F.explode(ends).alias("end")).join(known, "end").where(F.startswith("path", F.col("start")))
    best = fitting.groupBy("host", "path").agg(F.max(F.struct("length", "rule", "verdict")).alias("r"))
    return urls.join(best, ["host", "path"], "left")


def without_dots(url: Column) -> Column:
    """A whole url, the segments ``.`` and ``..`` of whose path are resolved; ``..`` at the top stays there."""
    segments = F.split(path_of(url), "/")

    def step(done: Column, segment: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.lit(1), F.size(done) - 1))
        return F.when(segment == ".", done).when(segment == "..", up).otherwise(F.concat(done, F.array(segment)))

    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.array(F.lit("")), step)
    resolved = F.concat(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.array_join(F.concat(kept, ended), "/"), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(.*)$", 1))
    return F.when(path_of(url).rlike(r"(?s)(?:^|/)\.\.?(?:/|$)"), resolved).otherwise(url)


def absolute(url: Column, target: Column) -> Column:
    """A link of a page as a whole url, without dot segments; null if it is none of http."""
    base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return without_dots(
        F.when(target.rlike(r"(?i)^https?://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.startswith("?"), F.concat(base, path, target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(url, r"(?s)^([^#]*)", 1), target))
        .when(target != "", F.concat(base, F.regexp_replace(path, "[^/]*$", ""), target))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """url, target of the canonical links and immediate redirects that pages declare."""
    tags = pages.where(F.col("html").rlike(r"(?i)canonical|refresh")).select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"(?is)\srel\s*=\s*[\"']?canonical\b"), F.regexp_extract("tag", r"(?is)\shref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.when(F.col("tag").rlike(r"(?is)\shttp-equiv\s*=\s*[\"']?refresh\b"), F.regexp_extract("tag", r"(?is)\scontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*([^\"'\s>]+)", 1))
    target = F.regexp_replace(F.coalesce(canonical, refresh), r"(?i)&(?:amp|#0*38|#x0*26);", "&")
    return tags.select("url", target.alias("target")).select("url", absolute(F.col("url"), F.col("target")).alias("target")).where("target is not null")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, by_alias.

    ``redirects`` (url, target) adds redirects seen while crawling to the links in ``html``.  A url that no rule fits is
    blocked if its component holds a blocked url and no url that a rule allows; else it is allowed.  A null url, or one
    without ``://``, has an empty host and path, fits no rule and has no aliases; a null ``html`` has no links.  Of rules that
    tie in length, which are the same rule twice, block wins.  Rows that repeat are judged alike, each by itself.  Urls and
    pages may be of any length.  An empty table gives an empty one.  Columns other than page_id, url and html aren't read, so
    names can't clash.
    """
    links = page_links(pages.select("url", "html"))
    if redirects is not None:
        links = links.unionByName(redirects.select("url", "target"))
    edges = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    reached = components(edges, "aliases")
    as_url = F.concat(F.lit("://"), F.col("node"))
    ruled = with_rule(reached.select("component", host_of(as_url).alias("host"), path_of(as_url).alias("path")), rules).select("component", F.col("r.verdict").alias("own"))
    decided = ruled.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    blocked = decided.where("blocked and not coalesce(allowed, false)").select("component")
    aliases = staged(reached.join(blocked, "component", "left_semi").select("node").distinct(), "blocked-aliases")
    url = F.col("url").cast("string")
    own = with_rule(pages.select("page_id", node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    marked = own.join(small_side(aliases.withColumn("alias", F.lit(True))), "node", "left")
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("alias"), F.lit("block")).otherwise(F.lit("allow")))
    return marked.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), (F.col("r").isNull() & F.coalesce("alias", F.lit(False))).alias("by_alias"))
