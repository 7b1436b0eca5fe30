"""Repositories as files (repo_id, path) and the directories above them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import base_name, preview
from . import tree
from .common import joined_in_order

# Which files are indexed, which are not, and which describe their directory, in order.
INCLUDE = ["*.py", "*.js", "*.ts", "*.tsx", "*.jsx", "*.go", "*.rs", "*.java", "*.kt", "*.scala", "*.rb", "*.php", "*.c", "*.cpp", "*.h", "*.hpp", "*.md", "*.rst", "*.txt", "*.yaml", "*.yml", "*.json", "*.toml", "Makefile", "Dockerfile", "*.sh"]
EXCLUDE = [
    ".git/**", ".github/**", ".gitlab/**", "node_modules/**", "vendor/**", "venv/**", ".venv/**", "__pycache__/**", "*.pyc", "*.pyo", ".idea/**", ".vscode/**", ".cursor/**", "dist/**", "build/**", "target/**", "out/**",
    "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json", "yarn.lock", "*.egg-info/**", "*.egg", ".DS_Store", "Thumbs.db", "coverage/**", ".coverage", "htmlcov/**", ".pytest_cache/**", ".mypy_cache/**", ".ruff_cache/**",
]
SUMMARY_FILES = ["README.md", "README.rst", "README.txt", "README", "__init__.py", "index.ts", "index.js", "mod.rs", "lib.rs"]
LISTED_FILES, LISTED_CHILDREN, PREVIEW_LINES, PREVIEW_CHARS = 20, 10, 30, 1500


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over whole names: * and ? match slashes too, [...] is a class."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inside = pattern[k + 1 : end]
            inside = re.sub(r"([\\\[&~|^])", r"\\\1", inside[1:] if inside[0] == "!" else inside)
            out += f"[{'^' if pattern[k + 1] == '!' else ''}{inside}]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.sub(r"([^\w\s])", r"\\\1", c)
        k += 1
    return out


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path or its last part matches any of the globs.  Patterns are options, so one expression holds them all."""
    if not patterns:
        return F.lit(False)
    one = r"(?s)\A(?:" + "|".join(map(glob_regex, patterns)) + r")\z"
    return path.rlike(one) | base_name(path).rlike(one)


def _ancestors(path: Column) -> Column:
    """The directories above a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def included(files: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Files that an include pattern and no exclude pattern matches, in no directory that is hidden or excluded."""
    include, exclude = INCLUDE if include is None else include, EXCLUDE if exclude is None else exclude
    path = F.col("path")
    above = F.when(F.contains(path, F.lit("/")), _ancestors(path)).otherwise(F.array().cast("array<string>"))
    shut = F.exists(above, lambda d: F.startswith(base_name(d), F.lit(".")) | matches(d, exclude))
    return files.where(matches(path, include) & ~matches(path, exclude) & ~shut)


def parent_dir(path: Column) -> Column:
    """The directory of a path, empty for the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def directories(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """repo_id, path, parent_path, depth, title, file_count, subdir_count of the directories that hold included files.

    Directories are the prefixes of the paths of files, so empty ones are never made.  The root's path is empty and its
    title null, for the caller to name; with ``repos`` (repo_id) those without files have a root too.
    """
    direct = files.select("repo_id", parent_dir(F.col("path")).alias("path"))
    above = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.when(F.contains("path", F.lit("/")), _ancestors(F.col("path"))).otherwise(F.array().cast("array<string>")), F.array("path")))
    counts = direct.groupBy("repo_id", "path").agg(F.count("*").alias("n"))
    spread = counts.select("repo_id", F.explode(above).alias("dir"), F.when(F.col("dir") == F.col("path"), F.col("n")).otherwise(0).alias("n"))
    if repos is not None:
        spread = spread.unionByName(repos.select("repo_id", F.lit("").alias("dir"), F.lit(0).cast("long").alias("n")))
    found = spread.groupBy("repo_id", F.col("dir").alias("path")).agg(F.sum("n").alias("file_count"))
    children = found.where("path <> ''").groupBy("repo_id", parent_dir(F.col("path")).alias("path")).agg(F.count("*").alias("subdir_count"))
    parent = F.when(F.col("path") != "", parent_dir(F.col("path")))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    return found.join(children, ["repo_id", "path"], "left").select("repo_id", "path", parent.alias("parent_path"), depth.cast("int").alias("depth"), F.nullif(base_name(F.col("path")), F.lit("")).alias("title"), F.col("file_count").cast("long").alias("file_count"), F.coalesce("subdir_count", F.lit(0)).cast("long").alias("subdir_count"))


def _sort_path(path: Column) -> Column:
    """Orders siblings without regard to case, and any directory before what is in it."""
    return F.when(path == "", F.array().cast("array<struct<low:string,name:string>>")).otherwise(F.transform(F.split(path, "/"), lambda p: F.struct(F.lower(p).alias("low"), p.alias("name"))))


def flat_index(dirs: DataFrame) -> DataFrame:
    """repo_id, ord, node_id, title, path, type, summary, file_count, subdir_count in pre-order."""
    order = F.row_number().over(Window.partitionBy("repo_id").orderBy(_sort_path(F.col("path")))) - 1
    number = order.cast("string")
    summary = F.coalesce("summary", F.lit("")) if "summary" in dirs.columns else F.lit("")
    return dirs.select("repo_id", order.cast("long").alias("ord"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number).alias("node_id"), "title", "path", F.lit("directory").alias("type"), summary.alias("summary"), "file_count", "subdir_count")


def statistics(dirs: DataFrame) -> DataFrame:
    """repo_id, total_files, total_directories."""
    return dirs.groupBy("repo_id").agg(F.sum("file_count").alias("total_files"), F.count("*").alias("total_directories"))


def listing(files: DataFrame) -> DataFrame:
    """repo_id, dir, ord, name: each directory's files without regard to case."""
    named = files.select("repo_id", parent_dir(F.col("path")).alias("dir"), base_name(F.col("path")).alias("name"))
    order = F.row_number().over(Window.partitionBy("repo_id", "dir").orderBy(F.lower("name"), "name")) - 1
    return named.select("repo_id", "dir", order.cast("long").alias("ord"), "name")


def contexts(files: DataFrame, described: DataFrame | None = None) -> DataFrame:
    """repo_id, path, context: what a directory's summary is made from.

    The first describing file with some text (``described``: repo_id, path, text of any files), the names of the first files
    and how many more there are.
    """
    listed = listing(files).groupBy("repo_id", F.col("dir").alias("path")).agg(joined_in_order(F.col("ord"), F.when(F.col("ord") < LISTED_FILES, F.col("name")), ", ").alias("names"), F.count("*").alias("n"))
    more = F.when(F.col("n") > LISTED_FILES, F.concat(F.lit("... and "), F.col("n") - LISTED_FILES, F.lit(" more files")))
    parts = [F.concat(F.lit("Files: "), F.col("names")), more]
    if described is not None:
        rank = F.array_position(F.array(*[F.lit(x) for x in SUMMARY_FILES]), base_name(F.col("path")))
        heads = described.select("repo_id", parent_dir(F.col("path")).alias("path"), rank.alias("rank"), base_name(F.col("path")).alias("name"), preview(F.col("text"), PREVIEW_LINES, PREVIEW_CHARS).alias("head")).where("rank > 0 and head <> ''")
        best = heads.groupBy("repo_id", "path").agg(F.min_by(F.concat(F.lit("=== "), "name", F.lit(" ===\n"), "head"), "rank").alias("head"))
        listed = listed.join(best, ["repo_id", "path"], "full")
        parts = [F.col("head"), *parts]
    return listed.select("repo_id", "path", F.concat_ws("\n\n", *parts).alias("context"))


def with_child_summaries(contexts: DataFrame, children: DataFrame) -> DataFrame:
    """``contexts`` with the first summaries of the directories below; ``children`` has repo_id, path, title and summary."""
    order = Window.partitionBy("repo_id", "parent").orderBy(F.lower("title"), "title")
    some = children.where("summary <> ''").select("repo_id", parent_dir(F.col("path")).alias("parent"), "title", "summary")
    lines = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LISTED_CHILDREN)
    text = lines.groupBy("repo_id", F.col("parent").alias("path")).agg(joined_in_order(F.col("k"), F.concat(F.lit("- "), "title", F.lit(": "), "summary"), "\n").alias("below"))
    joined = contexts.join(text, ["repo_id", "path"], "left")
    return joined.select("repo_id", "path", F.when(F.col("below").isNotNull() & (F.col("context") != ""), F.concat("context", F.lit("\n\nSubdirectories:\n"), "below")).otherwise(F.col("context")).alias("context"))


def shown(dirs: DataFrame, most_depth: int = 4) -> DataFrame:
    """Directories up to a depth in display order, with ``more`` where some below are left out."""
    index = flat_index(dirs).select("repo_id", "path", "ord")
    return dirs.join(index, ["repo_id", "path"]).where(F.col("depth") <= most_depth).withColumn("more", (F.col("depth") == most_depth) & (F.col("subdir_count") > 0))


def drawn(index: DataFrame, most_depth: int = 4) -> DataFrame:
    """doc_id, node_ord, line: the flat index as lines of text, directories with their numbers of files."""
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    label = F.concat(F.coalesce("title", "repo_id"), F.lit("/ ("), F.col("file_count").cast("string"), F.lit(" files)"))
    return tree.drawn(index.select(F.col("repo_id").alias("doc_id"), F.col("ord").alias("node_ord"), depth.alias("depth"), label.alias("title")), most_depth)
