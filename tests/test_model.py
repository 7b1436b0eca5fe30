"""Models behind reasoners: services, replies that are cut, options and the command line."""

from __future__ import annotations

import collections
import hashlib
import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from arbora import config, queries, staging
from arbora import reasoner as rs
from arbora.operators import repo, tree
from arbora.sources.chat import ChatService
from arbora.sources.convert import converted_urls


@pytest.fixture()
def service():
    """A chat service that says a prompt's length, and how many requests it had at a time."""
    state = {"now": 0, "most": 0, "seen": []}
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            import time

            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                state["seen"].append((body, self.headers.get("Authorization")))
            time.sleep(0.05)
            with lock:
                state["now"] -= 1
            said = {"choices": [{"message": {"content": str(len(body["messages"][-1]["content"]))}, "finish_reason": "stop"}]}
            raw = json.dumps(said).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    class Threaded(__import__("socketserver").ThreadingMixIn, HTTPServer):
        daemon_threads = True

    server = Threaded(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", state
    server.shutdown()


def test_service(spark, service, monkeypatch):
    url, state = service
    monkeypatch.setenv("ARBORA_MODEL_KEY", "k")
    chat = ChatService(url, "m", concurrency=3)
    assert chat(["a" * n for n in range(1, 13)]) == [(str(n), "stop") for n in range(1, 13)]
    assert 1 < state["most"] <= 3
    body, key = state["seen"][0]
    assert body["model"] == "m" and body["temperature"] == 0 and key == "Bearer k"
    assert chat.chat("b", [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]) == ("1", "stop")
    assert [t["role"] for t in state["seen"][-1][0]["messages"]] == ["user", "assistant", "user"]
    with pytest.raises(ValueError):
        ChatService(url, "m", concurrency=0)
    model = config.reasoner(config.Options(model="m", model_url=url, model_concurrency=2))
    made = spark.createDataFrame([(1, ["A"])], "doc_id int, titles array<string>")
    assert model.description(made).first()["description"].isdigit()


def test_reasoners_by_name():
    assert type(rs.load("rules")) is rs.RuleReasoner
    assert isinstance(rs.load("json:dumps"), rs.ModelReasoner)
    with pytest.raises(ValueError):
        rs.load("some-model")
    with pytest.raises(ModuleNotFoundError):
        rs.load("no_such_module:f")


def test_cut_replies_go_on():
    whole = "0123456789" * 5

    def complete(prompts):
        out = []
        for p in prompts:
            had = p.split("there is of it:\n", 1)[1].split("\n\nGo on", 1)[0] if "was cut" in p else ""
            part = whole[len(had) : len(had) + 12]
            out.append((part, "length" if len(had) + 12 < len(whole) else "stop"))
        return out

    assert rs._patient(complete, 1, 0)(["a", "b"]) == [whole, whole]
    assert rs._patient(lambda prompts: [("x" if "was cut" not in p else "", "FinishReason.MAX_TOKENS") for p in prompts], 1, 0)(["a"]) == ["x"]
    assert rs._patient(lambda prompts: ["plain"] * len(prompts), 1, 0)(["a"]) == ["plain"]


class Converser:
    """Says a conversation's turns, in parts of twelve characters; on executors, so that calls are seen in what is said."""

    def __init__(self, whole):
        self.whole = whole

    def converse(self, conversations):
        out = []
        for turns in conversations:
            had = sum(len(t["content"]) for t in turns if t["role"] == "model" and t["content"] in self.whole)
            out.append((self.whole[had : had + 12], "length" if had + 12 < len(self.whole) else "stop"))
        return out


def test_cut_replies_go_on_in_the_conversation():
    assert rs._patient(Converser("abcdefghijklmnopqrstuvwxyz0123456789"), 1, 0)(["a", "b"]) == ["abcdefghijklmnopqrstuvwxyz0123456789"] * 2
    assert rs._patient(lambda prompts: prompts, 1, 0)(["b"], [[{"role": "user", "content": "a"}]]) == ["user: a\n\nb"]


def test_history(spark):
    class Echo:
        def converse(self, conversations):
            return ["|".join(f"{t['role']}:{t['content']}" for t in turns) for turns in conversations]

    rows = spark.createDataFrame([(1, "p", [("user", "a"), ("assistant", "b")]), (2, "p", []), (3, "p", None), (4, None, [("user", "a")])], "id int, prompt_text string, turns_so_far array<struct<role:string,content:string>>")
    got = {r["id"]: r["said"] for r in rs.ModelReasoner(Echo(), retries=1).chat(rows, F.col("prompt_text"), "said", F.col("turns_so_far")).collect()}
    assert got == {1: "user:a|model:b|user:p", 2: "user:p", 3: "user:p", 4: None}


def test_prompts_are_dealt_to_tasks_and_asked_once(spark, tmp_path):
    def complete(prompts):
        from pyspark import TaskContext

        context = TaskContext.get()
        return [f"{p} in {context.stageId()}.{context.partitionId()}" for p in prompts]

    prompts = spark.range(5000).select("id", F.concat(F.lit("p"), F.col("id") % 4999).alias("prompt_text"))
    model = lambda: rs.ModelReasoner(complete, retries=1, tasks=8, replies=str(tmp_path / "replies"), name="m")
    first = {r["id"]: r["said"] for r in model().chat(prompts, F.col("prompt_text"), "said").collect()}
    assert len(first) == 5000 and all(said.startswith(f"p{k % 4999} in ") for k, said in first.items())
    parts = collections.Counter(said.rsplit(".", 1)[1] for said in first.values())
    assert len(parts) == 8 and min(parts.values()) > 400
    again = {r["id"]: r["said"] for r in model().chat(prompts, F.col("prompt_text"), "said").collect()}
    assert again == first  # none was asked again, or another stage would have said it
    more = rs.ModelReasoner(complete, retries=1, replies=str(tmp_path / "replies"), name="other").chat(prompts.limit(1), F.col("prompt_text"), "said").first()["said"]
    assert more not in first.values()


def count_words(texts):
    if any("fail" in t for t in texts):
        raise ValueError("no")
    return [len(t.split()) for t in texts]


def test_token_counter(spark, tmp_path, monkeypatch):
    from arbora.functions import counted_tokens
    from arbora.operators import markdown, pages

    made = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None), (4, "fail now"), (5, "longer text")], "id int, text string").coalesce(1)
    counter = lambda texts: count_words(texts)
    assert {r["id"]: r["n"] for r in made.select("id", counted_tokens(F.col("text"), counter).alias("n")).collect()} == {1: 3, 2: 0, 3: 0, 4: 2, 5: 2}
    assert pages.with_tokens(made.where("id = 1"), counter).first()["n_tokens"] == 3
    docs = spark.createDataFrame([(1, "# A\none two three")], "doc_id int, text string")
    assert markdown.sections(markdown.lines(docs), counter).first()["n_tokens"] == 5
    assert config.token_counter(config.Options()) is None
    assert config.token_counter(config.Options(token_counter="builtins:len")) is len


@pytest.mark.parametrize(
    ("line", "value"),
    [("model: http://x/#part", "http://x/#part"), ("model: a # said", "a"), ('model: "a # b" # said', "a # b"), ("model: 'it''s'", "it's"), (r'model: "a\"b"', 'a"b'), ("model: a:b", "a:b"), ("model: null", "rules"), ("model: # nothing", "rules"), ("'model': x", "x"), ("# model: y", "rules")],
)
def test_values_of_option_files(tmp_path, line, value):
    file = tmp_path / "o.yaml"
    file.write_text(f"---\n{line}\n")
    assert config.load(None, {}, str(file)).model == value


@pytest.mark.parametrize("text", ["model:\n  name: x\n", "model: [a, b]\n", "model: {a: b}\n", "- model\n", "model\n", 'model: "a\n', "model: 'a' b\n", "model: |\n  a\n"])
def test_option_files_that_say_more(tmp_path, text):
    file = tmp_path / "o.yaml"
    file.write_text(text)
    with pytest.raises(ValueError):
        config.load(None, {}, str(file))


def test_contents_judged_complete(spark):
    asked = []

    def answer(prompt):
        if prompt.startswith("Does this list"):
            return json.dumps({"answer": "yes" if "T2" in prompt.rsplit("listed:", 1)[1] else "no"})
        had = json.loads(prompt.rsplit("\n", 1)[1])
        return json.dumps([{"structure": str(k), "title": f"T{k}", "page": k} for k in range(9)][len(had) : len(had) + 1])

    tocs = spark.createDataFrame([(1, "x" * 100)], "doc_id int, toc_text string")
    got = rs.ModelReasoner(lambda prompts: [answer(p) for p in prompts], retries=1).toc_items(tocs).first()["items"]
    assert [x["title"] for x in got] == ["T0", "T1", "T2"] and not asked


def test_options_from_files(tmp_path):
    file = tmp_path / "o.yaml"
    file.write_text("max_page_num_each_node: 4\nconverter_timeout: 2.5\nmodel: json:dumps\n")
    assert config.load(None, {}, str(file)) == config.Options(max_page_num_each_node=4, converter_timeout=2.5, model="json:dumps")
    over = config.load({"max_page_num_each_node": 6}, {"ARBORA_CONFIG": str(file), "ARBORA_MAX_PAGE_NUM_EACH_NODE": "5", "ARBORA_CONVERTER_TIMEOUT": "1"})
    assert (over.max_page_num_each_node, over.converter_timeout) == (6, 1.0)
    with pytest.raises(ValueError):
        config.load(None, {}, str(tmp_path / "none"))
    file.write_text("nothing: 1\n")
    with pytest.raises(ValueError):
        config.load(None, {}, str(file))


def test_converter_by_options():
    assert config.converter(config.Options()) is None
    assert config.converter(config.Options(converter_url="http://127.0.0.1:9")) is None


def test_urls_converted(spark):
    class Converter:
        def convert_url(self, url):
            if "bad" in url:
                raise OSError("gone")
            return "# " + url if "empty" not in url else None

    got = {r["url"]: (r["text"], r["error"]) for r in converted_urls(spark.createDataFrame([("u",), ("bad",), ("empty",)], "url string"), Converter()).collect()}
    assert got == {"u": ("# u", None), "bad": (None, "OSError: gone"), "empty": (None, "no Markdown came back")}


def test_drawn(spark):
    rows = [(1, 0, 0, "A"), (1, 1, 1, "B"), (1, 2, 2, "C"), (1, 3, 3, "deep"), (1, 4, 1, "D"), (1, 5, 0, "E"), (1, 6, 1, None)]
    made = spark.createDataFrame(rows, "doc_id int, node_ord int, depth int, title string")
    got = [r["line"] for r in tree.drawn(made, 2).orderBy("node_ord").collect()]
    assert got == ["├── A", "│   ├── B", "│   │   └── C ...", "│   └── D", "└── E", "    └── "]
    index = spark.createDataFrame([("r", 0, "", None, 1), ("r", 1, "a", "a", 2), ("r", 2, "a/b", "b", 0), ("r", 3, "c", "c", 1)], "repo_id string, ord int, path string, title string, file_count int")
    assert [r["line"] for r in repo.drawn(index, 1).orderBy("node_ord").collect()] == ["└── r/ (1 files)", "    ├── a/ (2 files) ...", "    └── c/ (1 files)"]


def test_command_line_with_a_model(spark, tmp_path, capsys, monkeypatch):
    from arbora.__main__ import parser, run

    (tmp_path / "stand_in_model.py").write_text("def complete(prompts):\n    return [('said ' + str(len(p)), 'stop') for p in prompts]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "stand_in_model.py"))
    (tmp_path / "n.md").write_text("# A\n" + "word " * 300 + "\n## B\ny\n# C\nz")
    out = tmp_path / "out.json"
    assert run(parser().parse_args(["md", str(tmp_path / "n.md"), "-o", str(out), "--model", "stand_in_model:complete", "--show", "--summary-tokens", "50"])) == 0
    got = json.loads(out.read_text())
    assert got["doc_description"].startswith("said ") and got["structure"][0]["prefix_summary"].startswith("said ")
    assert got["structure"][0]["nodes"][0]["summary"] == "## B\ny"
    assert [x for x in capsys.readouterr().out.split("\n") if "──" in x] == ["├── A", "│   └── B", "└── C"]
    assert run(parser().parse_args(["md", str(tmp_path / "n.md"), "-o", str(out), "--no-node-id", "--no-description", "--text"])) == 0
    got = json.loads(out.read_text())
    assert "doc_description" not in got and "node_id" not in got["structure"][0] and got["structure"][1]["text"] == "# C\nz"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.md").write_text("# X\n# Y")
    (tmp_path / "f" / "z.html").write_text("<p>")
    assert run(parser().parse_args(["folder", str(tmp_path / "f"), "-o", str(tmp_path / "o"), "--no-convert", "--show", "1"])) == 0
    assert json.loads((tmp_path / "o" / "x_md_structure.json").read_text())["doc_description"] == "X; Y"
    assert "└── Y" in capsys.readouterr().out
    assert run(parser().parse_args(["md", str(tmp_path / "n.md"), "--model", "some-model"])) == 1
    assert run(parser().parse_args(["md", str(tmp_path / "out.json")])) == 1
    assert run(parser().parse_args(["md", str(tmp_path / "n.md"), "--config", str(tmp_path / "none")])) == 1
    sys.modules.pop("stand_in_model", None)


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        staging.shared_dir(Session())


def test_sample_by_hand(spark, sf_dir):
    """Five items of each document with the least seeded digests."""
    from arbora import fixtures as fx

    def hashed(d, k):
        return hashlib.md5(f"{d}:{k}:0".encode()).hexdigest()

    own = collections.defaultdict(list)
    for r in fx.toc_items(spark, sf_dir).collect():
        own[r["doc_id"]].append(r["list_index"])
    want = {(d, k) for d, ks in own.items() for k in sorted(ks, key=lambda k: (hashed(d, k), k))[:5]}
    assert {tuple(r) for r in queries.docs_sample(spark, sf_dir).collect()} == want
