from __future__ import annotations

import json

import fnmatch
import random
import re

from arbora import config
from arbora.operators import batch, repo
from arbora.plans import folder
from arbora.plans import repo as plan
from arbora.reasoner import ModelReasoner, RuleReasoner
from arbora.sources import files as source
from arbora.sources.convert import html_to_markdown

import pytest
from pyspark.sql import functions as F


def listed(spark, *paths):
    return spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")


def test_globs():
    random.seed(8)
    for _ in range(300):
        pattern, name = ("".join(random.choices("ab*?[!]-./", k=random.randint(1, 6))) for _ in range(2))
        name = name.replace("*", "c")
        try:
            want = fnmatch.fnmatchcase(name, pattern)
            got = bool(re.fullmatch(repo.glob_regex(pattern), name, re.DOTALL))
        except re.error:
            continue
        if "[" not in pattern:
            assert got == want, (pattern, name)
    assert re.fullmatch(repo.glob_regex("[!a]x[bc]"), "zxb") and not re.fullmatch(repo.glob_regex("[!a]x[bc]"), "axb")


def test_filter(spark):
    paths = ["a.py", "src/b.py", "src/c.bin", ".git/x.py", "node_modules/m.js", "src/node_modules/n.js", "src/.hid/d.py", "Makefile", "x.min.js", "README", "p/q/r/s.md"]
    got = {r["path"] for r in repo.included(listed(spark, *paths)).collect()}
    assert got == {"a.py", "src/b.py", "src/node_modules/n.js", "Makefile", "p/q/r/s.md"}


def test_index(spark):
    files = listed(spark, "B/x.py", "a/y.py", "a/b/z.py", "top.py", "empty/readme.bin")
    got = [(r["path"], r["node_id"], r["file_count"], r["subdir_count"]) for r in plan.build(files).orderBy("ord").collect()]
    assert got == [("", "0000", 1, 2), ("a", "0001", 1, 1), ("a/b", "0002", 1, 0), ("B", "0003", 1, 0)]
    stats = plan.statistics(files).first()
    assert (stats["total_files"], stats["total_directories"]) == (4, 4)
    assert [tuple(r)[3:] for r in plan.build(listed(spark, "x.bin")).select("repo_id", "ord", "node_id", "path", "file_count").collect()] == [("", 0)]


def test_summaries(spark):
    files = listed(spark, "a/y.py", "a/b/z.py", *[f"t{k:02}.py" for k in range(22)])
    texts = spark.createDataFrame([("r", "a/README.md", "\n".join(map(str, range(40))))], "repo_id string, path string, text string")
    contexts = {r["path"]: r["context"] for r in repo.contexts(files, texts).collect()}
    assert contexts["a"].startswith("=== README.md ===\n0\n1\n") and contexts["a"].endswith("29\n\nFiles: y.py")
    assert contexts[""].endswith("t19.py\n\n... and 2 more files")
    got = {r["path"]: r["summary"] for r in plan.build(files, texts, reasoner=RuleReasoner()).collect()}
    assert got["a/b"] == "Files: z.py" and got["a"].startswith("=== README.md")


def test_model_is_asked_once_for_each_prompt(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def complete(prompts):
        with open(seen, "a") as f:
            f.write("".join(f"{len(p)}\n" for p in prompts))
        return ['{"answer": "yes"}'] * len(prompts)

    rows = spark.createDataFrame([(1, "T", "a"), (2, "T", "a"), (3, "T", None)], "doc_id int, title string, page_text string")
    got = {r["doc_id"]: r["answer"] for r in ModelReasoner(complete, retries=1).title_appears(rows).collect()}
    assert got == {1: "yes", 2: "yes", 3: "no"}
    assert len(open(seen).readlines()) == 1


def test_kinds(spark):
    files = spark.createDataFrame([("a.PDF",), ("b.md",), ("c.markdown",), ("d.Docx",), ("e.zip",), ("f",)], "path string")
    assert [r["fmt"] for r in batch.classified(files).collect()] == ["pdf", "markdown", "markdown", "docling", "unsupported", "unsupported"]
    two = spark.createDataFrame([("x/a.pdf",), ("x/a.md",)], "path string")
    assert [r["output"] for r in batch.output_names(two).collect()] == ["a_pdf_structure.json", "a_md_structure.json"]


def test_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx\n## B\ny\n")
    (tmp_path / "b.html").write_text("<h1>T</h1><p>u</p>")
    (tmp_path / "c.pdf").write_bytes(b"bad")
    (tmp_path / "d.pdf").write_bytes(b"good")
    (tmp_path / "e.zip").write_bytes(b"")

    def extract(content):
        if content == b"bad":
            raise ValueError("broken")
        return ["One\nx", "Two\ny", "Three\nz"]

    class Converter:
        def convert(self, name, content):
            return "# " + name

    nodes, runs = folder.build(spark, str(tmp_path), {"if_add_node_summary": "no"}, converter=Converter(), extract=extract)
    got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["error"]) for r in runs.collect()}
    assert got == {"a.md": ("success", None), "b.html": ("success", None), "c.pdf": ("failed", "ValueError: broken"), "d.pdf": ("success", None)}
    assert {(r["doc_id"], r["title"]) for r in nodes.collect()} == {("a.md", "A"), ("a.md", "B"), ("b.html", "b.html"), ("d.pdf", "One"), ("d.pdf", "Two"), ("d.pdf", "Three")}
    skipped = folder.build(spark, str(tmp_path), {"if_add_node_summary": "no"}, extract=extract)[1]
    assert batch.statistics(skipped).first().asDict() == {"total": 4, "success": 2, "failed": 1, "skipped": 1}


def test_folder_with_files_that_fail(spark, tmp_path):
    """Files that are too large or not UTF-8 are rows, whether they would be indexed or not, and what becomes of files is said."""
    (tmp_path / "f").mkdir()
    for name, content in (("a.md", b"# A\nx"), ("b.MD", b"# B\n" + b"x" * 3000), ("c.markdown", b"# C \xff"), ("d.pdf", b"one\fTwo"), ("e.PDF", b"x" * 5000), ("f.zip", b"x" * 9000), ("g.html", b"<p>"), ("h.md", b"\n")):
        (tmp_path / "f" / name).write_bytes(content)
    key = "spark.sql.sources.binaryFile.maxLength"
    had, said, events = spark.conf.get(key), [], str(tmp_path / "events")
    spark.conf.set(key, "2000")
    try:
        nodes, runs = folder.build(spark, str(tmp_path / "f"), {"if_add_node_summary": "no"}, extract=lambda content: content.decode().split("\f"), on_progress=lambda name, status: said.append((name, status)), events=events)
        got = {r["path"].rsplit("/", 1)[1]: (r["status"], r["error"]) for r in runs.collect()}
        titles = {(r["doc_id"], r["title"]) for r in nodes.collect()}
    finally:
        spark.conf.set(key, had)
    assert got == {
        "a.md": ("success", None), "b.MD": ("failed", "larger than 2000 bytes: 3004"), "c.markdown": ("failed", "not UTF-8"), "d.pdf": ("success", None),
        "e.PDF": ("failed", "larger than 2000 bytes: 5000"), "g.html": ("skipped", None), "h.md": ("success", None),
    }
    assert titles == {("a.md", "A"), ("d.pdf", "one"), ("d.pdf", "Two")}
    want = [("a.md", "reading"), ("a.md", "done"), ("b.MD", "failed"), ("c.markdown", "reading"), ("c.markdown", "failed"), ("d.pdf", "reading"), ("d.pdf", "done"), ("e.PDF", "failed"), ("g.html", "skipped"), ("h.md", "reading"), ("h.md", "done")]
    assert sorted(said) == sorted(want) and said.index(("a.md", "done")) < said.index(("d.pdf", "done"))
    written = spark.read.parquet(events).orderBy("seq").collect()
    assert sorted((r["doc_id"], json.loads(r["payload"])["status"]) for r in written) == sorted(want)
    assert {r["doc_id"] for r in written if r["level"] == "error"} == {"b.MD", "c.markdown", "e.PDF"}
    few = folder.build(spark, str(tmp_path / "f"), {"if_add_node_summary": "no"}, extract=lambda content: ["x"], most_bytes=4)[1]
    assert {r["path"].rsplit("/", 1)[1] for r in few.where("status = 'success'").collect()} == {"h.md"}


def test_sources(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.py").write_text("x")
    (tmp_path / "README.md").write_text("# R\nx\n")
    assert {r["path"] for r in source.repository(spark, str(tmp_path), "r").collect()} == {"s/a.py", "README.md"}
    assert [tuple(r) for r in source.file_texts(spark, str(tmp_path), "r", repo.SUMMARY_FILES).collect()] == [("r", "README.md", "# R\nx\n")]
    assert source.markdown_files(spark, str(tmp_path / "README.md")).select("doc_id", "text").first() == ("README", "# R\nx\n")


def test_names_with_spaces(spark, tmp_path):
    (tmp_path / "a b+c%.md").write_text("# A")
    assert source.markdown_files(spark, str(tmp_path)).first()["doc_id"] == "a b+c%"
    assert source.folder(spark, str(tmp_path)).first()["path"].endswith("/a b+c%.md")


def test_html(spark):
    html = "<html><head><title>t</title></head><script>var a='</p>';</script><nav>n</nav><h1>A &amp; B</h1><p>x<br>y<li>z</li></p></html>"
    got = spark.createDataFrame([(html,)], "h string").select(html_to_markdown(F.col("h"))).first()[0]
    assert got == "# A & B\n\nx\ny\n- z"


def test_options():
    assert config.load(None, {}).toc_check_page_num == 20
    assert config.load({"max_page_num_each_node": 3, "model": None}, {}).max_page_num_each_node == 3
    assert config.load(None, {"ARBORA_MAX_TOKEN_NUM_EACH_NODE": "7"}).max_token_num_each_node == 7
    assert config.load(config.Options(model="m"), {}).model == "m"
    for wrong in ({"if_add_node_id": "maybe"}, {"nothing": 1}, {"toc_check_page_num": "x"}):
        with pytest.raises(ValueError):
            config.load(wrong, {})
    with pytest.raises(TypeError):
        config.load([1], {})


def test_option_files(tmp_path):
    file = tmp_path / "o.yaml"
    file.write_text("# options\nmodel: 'm'  # which\ntoc_check_page_num: 7\nproject_id:\n")
    assert config.load(config.read_file(str(file)), {}) == config.Options(model="m", toc_check_page_num=7)
    assert config.read_file(str(tmp_path / "none")) == {}


def test_command_line(spark, tmp_path, capsys):
    import json

    from arbora.__main__ import parser, run

    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "b.py").write_text("x")
    (tmp_path / "r" / "s").mkdir()
    (tmp_path / "r" / "s" / "a.py").write_text("x")
    (tmp_path / "n.md").write_text("# A\nx\n## B\ny\n# C\nz")
    out = tmp_path / "out.json"
    assert run(parser().parse_args(["md", str(tmp_path / "n.md"), "-o", str(out), "--text"])) == 0
    got = json.loads(out.read_text())
    assert got["doc_name"] == "n" and got["doc_description"] == "A; B; C"
    assert [x["title"] for x in got["structure"]] == ["A", "C"] and got["structure"][0]["nodes"][0]["text"] == "## B\ny"
    assert run(parser().parse_args(["repo", str(tmp_path / "r"), "-o", str(out)])) == 0
    got = json.loads(out.read_text())
    assert got["repo_name"] == "r" and got["statistics"] == {"total_files": 2, "total_directories": 2}
    assert got["structure"][0]["nodes"][0]["summary"] == "Files: a.py" and [x["path"] for x in got["flat_index"]] == ["", "s"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.md").write_text("# X")
    assert run(parser().parse_args(["folder", str(tmp_path / "f"), "-o", str(tmp_path / "o"), "--no-summary"])) == 0
    assert json.loads((tmp_path / "o" / "x_md_structure.json").read_text())["structure"] == [{"title": "X", "node_id": "0000", "line_num": 1}]
    assert run(parser().parse_args(["pdf", str(tmp_path / "none.pdf")])) == 1
    assert "no such file" in capsys.readouterr().err
