"""Command line: pdf, md, folder and repo."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

VERSION = "0.1.0"
SUFFIXES = {"pdf": [".pdf"], "md": [".md", ".markdown"]}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arbora", description="Index documents and repositories as section trees.")
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command", required=True)
    for name, what in (("pdf", "a PDF file"), ("md", "a Markdown file"), ("folder", "a folder of files"), ("repo", "a source repository")):
        one = sub.add_parser(name, help=f"index {what}")
        one.add_argument("path")
        one.add_argument("-o", "--output", help="where to write; ./results by default")
        one.add_argument("--config", help="a file of options; ARBORA_CONFIG by default")
        one.add_argument("--model", help="rules, package.module:function, or a model of the service at --model-url")
        one.add_argument("--model-url", help="a chat service; its key is in ARBORA_MODEL_KEY on the executors")
        one.add_argument("--concurrency", type=int, help="requests to the service at a time, for each task")
        one.add_argument("--replies", help="a folder that keeps a model's replies for later runs")
        one.add_argument("--token-counter", help="package.module:function from texts to numbers of tokens")
        one.add_argument("--no-summary", action="store_true", help="make no summaries")
        one.add_argument("--show", type=int, nargs="?", const=3, metavar="DEPTH", help="print the tree up to a depth")
        if name != "repo":
            one.add_argument("--text", action="store_true", help="keep the texts of nodes")
            one.add_argument("--no-node-id", action="store_true", help="write no ids of nodes")
            one.add_argument("--no-description", action="store_true", help="describe no documents")
        if name in ("md", "folder"):
            one.add_argument("--thin", type=int, help="merge sections with fewer tokens than this")
            one.add_argument("--summary-tokens", type=int, help="sections with fewer tokens are their own summary")
        if name in ("pdf", "folder"):
            one.add_argument("--toc-pages", type=int)
            one.add_argument("--max-pages", type=int)
            one.add_argument("--max-tokens", type=int)
        if name == "folder":
            one.add_argument("--converter", help="url of a conversion service")
            one.add_argument("--converter-timeout", type=float, help="seconds")
            one.add_argument("--no-convert", action="store_true", help="skip files that need conversion")
            one.add_argument("--progress", action="store_true", help="print what becomes of each file")
            one.add_argument("--events", help="a table that what becomes of each file is added to")
        if name == "repo":
            one.add_argument("--include", action="append")
            one.add_argument("--exclude", action="append")
    return top


def options(args: argparse.Namespace):
    """What the command line says, over the environment and the file."""
    from .config import load

    given = {option: getattr(args, name, None) for name, option in (
        ("model", "model"), ("model_url", "model_url"), ("concurrency", "model_concurrency"), ("replies", "model_replies"), ("token_counter", "token_counter"), ("toc_pages", "toc_check_page_num"), ("max_pages", "max_page_num_each_node"), ("max_tokens", "max_token_num_each_node"),
        ("thin", "min_token_threshold"), ("summary_tokens", "summary_token_threshold"), ("converter", "converter_url"), ("converter_timeout", "converter_timeout"),
    )}
    for name, option, value in (("text", "if_add_node_text", "yes"), ("thin", "if_thinning", "yes"), ("no_summary", "if_add_node_summary", "no"), ("no_node_id", "if_add_node_id", "no"), ("no_description", "if_add_doc_description", "no")):
        if getattr(args, name, None):
            given[option] = value
    return load(given, path=args.config)


def written(value: str, path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(json.loads(value), indent=2, ensure_ascii=False), encoding="utf-8")
    print(f"Written to {path}")


def show(lines) -> None:
    """Prints the lines of a drawn tree, one document after another."""
    for row in lines.orderBy("doc_id", "node_ord").select("line").toLocalIterator():
        print(row["line"])


def run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from . import config
    from .functions import stem
    from .operators import repo as ops
    from .operators import tree
    from .plans import folder, markdown, pages, repo
    from .sinks import repository_results, results
    from .sources import files

    many = args.command in ("folder", "repo")
    path = Path(args.path).resolve()
    if not path.exists() or many != path.is_dir():
        print(f"{args.path}: no such {'folder' if many else 'file'}", file=sys.stderr)
        return 1
    if args.command in ("pdf", "md") and path.suffix.lower() not in SUFFIXES[args.command]:
        print(f"{args.path}: not {' or '.join(SUFFIXES[args.command])}", file=sys.stderr)
        return 1
    try:
        given = options(args)
        reasoner = config.reasoner(given)
    except (ValueError, ImportError, AttributeError) as why:
        print(why, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("arbora").getOrCreate()
    described = given.if_add_node_summary == "yes" and given.if_add_doc_description == "yes"
    kept = [*["node_id"] * (given.if_add_node_id == "yes"), "start_index", "end_index", "line_num", *["text"] * (given.if_add_node_text == "yes"), *["summary", "prefix_summary"] * (given.if_add_node_summary == "yes")]
    fields = lambda nodes: ["title", *[c for c in kept if c in nodes.columns]]
    if args.command == "folder":
        said = (lambda name, status: print(f"{name}: {status}", flush=True)) if args.progress else None
        nodes, runs = folder.build(spark, str(path), given, reasoner, None if args.no_convert else config.converter(given), on_progress=said, events=args.events)
        out = Path(args.output or "results")
        named = runs.select(F.regexp_extract("path", "[^/]*$", 0).alias("doc_id"), "output", "description")
        found = results(nodes, named.withColumn("doc_name", F.col("doc_id")), fields(nodes), named if described else None).join(named.drop("description"), "doc_id")
        for row in found.select("output", "value").toLocalIterator():  # one document at a time
            written(row["value"], out / row["output"])
        if args.show is not None:
            show(tree.drawn(nodes, args.show))
        runs.groupBy("fmt", "status").agg(F.count("*").alias("files")).orderBy("fmt", "status").show()
        return 0
    out = Path(args.output) if args.output else Path("results") / f"{path.name if args.command == 'repo' else path.stem}_{'index' if args.command == 'repo' else 'structure'}.json"
    if args.command == "repo":
        known = files.repository(spark, str(path), path.name)
        texts = files.file_texts(spark, str(path), path.name, ops.SUMMARY_FILES)
        index = repo.build(known, texts, args.include, args.exclude, reasoner if given.if_add_node_summary == "yes" else None)
        written(repository_results(index, repo.statistics(known, args.include, args.exclude)).first()["value"], out)
        if args.show is not None:
            show(ops.drawn(index, args.show))
        return 0
    if args.command == "md":
        nodes = markdown.build(files.markdown_files(spark, str(path)), given, reasoner)
    else:
        nodes = pages.build(files.pdf_pages(spark, str(path)).where("error is null").select("doc_id", "physical_index", "text"), given, reasoner)
    names = nodes.select("doc_id").distinct().withColumn("doc_name", stem(F.col("doc_id")) if args.command == "md" else F.col("doc_id"))
    found = results(nodes, names, fields(nodes), markdown.described(nodes, reasoner) if described else None).first()
    if found is None:
        print(f"{args.path}: no sections found", file=sys.stderr)
        return 1
    written(found["value"], out)
    if args.show is not None:
        show(tree.drawn(nodes, args.show))
    return 0


if __name__ == "__main__":
    sys.exit(run(parser().parse_args()))
