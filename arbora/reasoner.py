"""Judgements over texts: by fixed rules in built-in expressions, or by a language model behind a function.

A reasoner's methods take DataFrames and add columns, so that rules stay in the plan, while a model is asked once for each
different prompt.
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .functions import chat_history, extract_json, index_number, page_tag, squeezed, strip, token_count, yes_or_no
from .operators import titles
from .operators.pages import grouped_text, groups
from .operators.toc import range_text
from .staging import folder_there, staged

TOC_ITEMS = "array<struct<structure:string,title:string,page:int>>"
SUMMARY_CHARS, TOC_LINES, TITLE_CHARS, DESCRIBED = 200, 3, 80, 3


def _squeezed_page(rows: DataFrame) -> Column:
    return F.col("page_squeezed") if "page_squeezed" in rows.columns else squeezed(F.col("page_text"))


def _key() -> Column:
    """A string for a document, whatever the type of its id."""
    return F.sha2(F.to_json(F.struct("doc_id")), 256)


class RuleReasoner:
    """Rules that need no model."""

    #: Whether what ``searchable`` finds answers all that is asked of titles, so that no page's text is needed for it again.
    indexed = True
    #: Characters of a text that ``summary`` reads; None for all.
    summary_reads: int | None = SUMMARY_CHARS

    def toc_pages(self, pages: DataFrame) -> DataFrame:
        """``is_toc``: yes for a page with three or more lines that end in digits."""
        ending = F.size(F.regexp_extract_all("text", F.lit(r"(?m)\d[ \t]*$"), F.lit(0)))
        return pages.withColumn("is_toc", F.when(ending >= TOC_LINES, "yes").otherwise("no"))

    def has_numbers(self, tocs: DataFrame) -> DataFrame:
        """``numbered``: whether most lines of ``toc_text`` end in digits."""
        lines, ending = F.size(F.regexp_extract_all("toc_text", F.lit(r"(?m)\S[ \t]*$"), F.lit(0))), F.size(F.regexp_extract_all("toc_text", F.lit(r"(?m)\d[ \t]*$"), F.lit(0)))
        return tocs.withColumn("numbered", F.when(2 * ending > lines, "yes").otherwise("no"))

    def toc_items(self, tocs: DataFrame) -> DataFrame:
        """``items`` of ``toc_text``: a line's dotted code, title and last number; a line needs a code or a number."""
        line = r"^\s*((?:\d+\.)*\d+)?\.?\s*(.*?)[\s.:]*(\d+)?\s*$"
        made = F.transform(F.split("toc_text", "\n"), lambda x: F.struct(F.nullif(F.regexp_extract(x, line, 1), F.lit("")).alias("structure"), F.regexp_extract(x, line, 2).alias("title"), F.regexp_extract(x, line, 3).try_cast("int").alias("page")))
        return tocs.withColumn("items", F.filter(made, lambda i: (i["title"] != "") & (i["structure"].isNotNull() | i["page"].isNotNull())))

    def outline(self, pages: DataFrame) -> DataFrame:
        """doc_id, list_index, structure, title, physical_index: a section for each page that begins with a short line."""
        short = (self.headed(pages) if "text" in pages.columns else pages).where("head is not null").withColumnRenamed("head", "title")
        k = F.row_number().over(Window.partitionBy("doc_id").orderBy("physical_index")) - 1
        return short.select("doc_id", k.cast("long").alias("list_index"), (k + 1).cast("string").alias("structure"), "title", "physical_index", "answer", "appear_start")

    def headed(self, pages: DataFrame) -> DataFrame:
        """``pages`` with all that ``outline`` needs of their texts: ``head``, the short line that a page begins with or null, and
        whether the page has it (``answer``) and begins with it (``appear_start``)."""
        line = strip(F.substring_index("text", "\n", 1))
        named = pages.withColumn("head", F.when((line != "") & (F.length(line) <= TITLE_CHARS), line))
        some = named.withColumns({"page": F.when(F.col("head").isNotNull(), squeezed(F.col("text"))), "own": squeezed(F.col("head"))})
        return some.withColumns({"answer": F.when(F.contains("page", "own"), "yes").otherwise("no"), "appear_start": F.when(F.startswith("page", "own"), "yes").otherwise("no")}).drop("text", "page", "own")

    def place(self, items: DataFrame, pages: DataFrame) -> DataFrame:
        """``items`` (doc_id, list_index, title, ...) with ``physical_index``, the first of ``pages`` that has the title."""
        return titles.first_pages(items, titles.finds(items, pages))

    def searchable(self, items: DataFrame, pages: DataFrame) -> DataFrame:
        """What ``locate`` looks for the titles of ``items`` in."""
        return staged(titles.finds(items, pages, starts=True), "finds")

    def placed(self, items: DataFrame, searched: DataFrame) -> DataFrame:
        """As ``place``, in the part of what is ``searchable`` that is on the pages."""
        return titles.first_pages(items, searched)

    def gaps_filled(self, items: DataFrame, searched: DataFrame) -> DataFrame:
        """As ``filled``, in what is ``searchable``."""
        return titles.filled(items, titles.of_titles(searched, items.where("physical_index is null")))

    def filled(self, items: DataFrame, pages: DataFrame) -> DataFrame:
        """doc_id, list_index, fixed_index of the items that have no index and are found between known ones, each narrowing the
        next one's range."""
        missing = items.where("physical_index is null")
        return titles.filled(items, titles.finds(missing, pages))

    def title_appears(self, rows: DataFrame) -> DataFrame:
        """``answer``: whether ``page_text`` has ``title`` without regard to case and white space."""
        found = F.contains(_squeezed_page(rows), squeezed(F.col("title")))
        return rows.withColumn("answer", F.when(found, "yes").otherwise("no"))

    def title_starts(self, rows: DataFrame) -> DataFrame:
        """``appear_start``: whether ``page_text`` begins with ``title`` in the same sense."""
        found = F.startswith(_squeezed_page(rows), squeezed(F.col("title")))
        return rows.withColumn("appear_start", F.when(found, "yes").otherwise("no"))

    def locate(self, ranged: DataFrame, searched: DataFrame, first: str, last: str) -> DataFrame:
        """``ranged`` (doc_id, list_index, title, ...) with ``fixed_index``, the first page from ``first`` to ``last`` with the title."""
        return titles.first_within(ranged, searched, first, last)

    def summary(self, rows: DataFrame, text: str, out: str, short: Column | None = None) -> DataFrame:
        """``out`` of a text; where ``short`` holds, the text itself."""
        said = F.substring(text, 1, SUMMARY_CHARS)
        return rows.withColumn(out, said if short is None else F.when(short, F.col(text)).otherwise(said))

    def description(self, docs: DataFrame) -> DataFrame:
        """``description`` from ``titles``, the first of them."""
        return docs.withColumn("description", F.array_join(F.slice("titles", 1, DESCRIBED), "; "))


#: Prompts to replies: texts, or pairs of a text and the reason why it ended.
Complete = Callable[[list[str]], list]
GROUP_TOKENS = 20_000
_LOCATE = 'On which of these pages does the section start? Answer with a JSON object {"physical_index": "<physical_index_X>"} only.'


def parse_reply(raw: str):
    """A reply's JSON by the rules of ``functions.extract_json``; None if it has none."""
    body = raw[raw.find("```json") + 7 : raw.rfind("```")] if "```json" in raw else raw
    body = " ".join(body.replace("None", "null").split())
    for text in (body, body.replace(",]", "]").replace(",}", "}")):
        try:
            return json.loads(text)
        except ValueError:
            continue
    return None


def _number(value) -> int | None:
    """A page tag, open or bare, or a number."""
    found = re.fullmatch(r"<?physical_index_\s*(\d+)\s*>?\s*", value) if isinstance(value, str) else None
    return int(found[1]) if found else value if isinstance(value, int) else None


def _entries(reply) -> list[dict]:
    return [x for x in reply if isinstance(x, dict) and x.get("title")] if isinstance(reply, list) else []


def as_reply(said) -> tuple[str, bool]:
    """A reply's text and whether it was cut at the output limit.  ``complete`` gives texts, or pairs of text and finish reason."""
    if isinstance(said, str):
        return said, False
    text, reason = said
    return text or "", any(x in str(reason or "").upper() for x in ("MAX_TOKENS", "LENGTH"))


_GO_ON = "Your reply was cut. Go on with the very next character."


def _told(history: list[dict], prompt: str) -> str:
    """A conversation as one text, for functions that know prompts only."""
    return "\n\n".join([*(f"{t['role']}: {t['content']}" for t in history), prompt]) if history else prompt


def _patient(complete: Complete, retries: int, pause: float) -> Callable[..., list[str]]:
    """``complete`` tried again where it fails, and asked to go on where a reply was cut, until one ends or adds nothing.

    What has a method ``converse``, from lists of turns (role, content) to replies, is asked to go on in the same conversation and is
    given its history; other functions get both as parts of the prompt.
    """
    converse = getattr(complete, "converse", None)

    def tried(prompts: list[str], histories: list[list[dict]]) -> list[tuple[str, bool]]:
        for attempt in range(retries):
            try:
                if converse is not None:
                    said = converse([[*h, {"role": "user", "content": p}] for p, h in zip(prompts, histories, strict=True)])
                else:
                    said = complete([_told(h, p) for p, h in zip(prompts, histories, strict=True)])
                return [as_reply(x) for x in said]
            except Exception:
                if attempt + 1 == retries:
                    raise
                time.sleep(pause)
        return []

    def further(prompt: str, history: list[dict], text: str) -> tuple[str, list[dict]]:
        if converse is not None:
            return _GO_ON, [*history, {"role": "user", "content": prompt}, {"role": "model", "content": text}]
        return f"{prompt}\n\nYour reply was cut. This is what there is of it:\n{text}\n\nGo on with the very next character.", history

    def ask(prompts: list[str], histories: list[list[dict]] | None = None) -> list[str]:
        histories = histories or [[] for _ in prompts]
        got = tried(prompts, histories)
        texts = [text for text, _ in got]
        cut = [k for k, (text, over) in enumerate(got) if over and text]
        while cut:
            more = tried(*map(list, zip(*[further(prompts[k], histories[k], texts[k]) for k in cut], strict=True)))
            for k, (text, _) in zip(cut, more, strict=True):
                texts[k] += text
            cut = [k for k, (text, over) in zip(cut, more, strict=True) if over and text]
        return texts

    return ask


class ModelReasoner(RuleReasoner):
    """Asks a model.  ``complete`` maps prompts to replies and is called on the executors.

    Prompts are made distinct before they are asked and dealt to ``tasks`` tasks, as many as may ask at a time, each of which sends
    ``batch`` of them at once.  Replies are written to the shared folder, so that a task which runs again doesn't ask for what later
    stages have already read.  With ``replies``, a folder, they are kept as a table there under a digest of ``name`` and the prompt,
    and a later run asks only for what the table doesn't have.  Where a later question needs the answers before it, one task
    goes through a document's page groups or items in order, and its replies aren't kept.
    """

    indexed, summary_reads = False, None

    def __init__(self, complete: Complete, retries: int = 10, pause: float = 1.0, batch: int = 32, tasks: int | None = None, replies: str | None = None, name: str = "model"):
        self.ask, self.batch, self.tasks, self.replies, self.name = _patient(complete, retries, pause), batch, tasks, replies, name

    def chat(self, rows: DataFrame, prompt: Column, out: str, history: Column | None = None) -> DataFrame:
        """``rows`` with the model's reply ``out`` to ``prompt``, after the turns (role, content) of ``history`` if there are any."""
        return self._ask(rows, prompt, out, history)

    def _ask(self, rows: DataFrame, prompt: Column, out: str, history: Column | None = None) -> DataFrame:
        turns = F.lit(None).cast("string") if history is None else F.to_json(F.slice(chat_history(history, prompt), F.lit(1), F.size(history)))
        key = F.sha2(F.concat_ws("\n", F.lit(self.name), F.coalesce(turns, F.lit("")), prompt), 256)
        keyed = staged(rows.withColumns({"prompt": prompt, "turns": turns, "key": key}), "prompts")
        wanted = keyed.where("prompt is not null").select("key", "prompt", "turns").dropDuplicates(["key"])
        known = self._known(rows)
        if known is not None:
            wanted = wanted.join(known, "key", "left_anti")
        said = self._said(staged(wanted, "new-prompts"))
        if self.replies:
            said.write.mode("append").parquet(self.replies)
            said = self._known(rows)
        return keyed.join(said, "key", "left").withColumnRenamed("reply", out).drop("key", "prompt", "turns")

    def _known(self, rows: DataFrame) -> DataFrame | None:
        """The kept replies; of two runs that asked the same at a time one's is taken."""
        if not self.replies or not folder_there(rows.sparkSession, self.replies):
            return None
        kept = rows.sparkSession.read.schema("key string, reply string").parquet(self.replies)
        return kept.groupBy("key").agg(F.min("reply").alias("reply"))

    def _said(self, wanted: DataFrame) -> DataFrame:
        """key, reply of ``wanted`` (key, prompt, turns), a written table."""
        ask, size = self.ask, self.batch

        def run(batches: Iterator) -> Iterator:
            import pandas as pd

            for frame in batches:
                replies: list[str] = []
                for k in range(0, len(frame), size):
                    some = frame.iloc[k : k + size]
                    replies += ask(some["prompt"].tolist(), [json.loads(t) if isinstance(t, str) else [] for t in some["turns"]])
                yield pd.DataFrame({"key": frame["key"], "reply": replies})

        tasks = max(1, min(self.tasks or wanted.sparkSession.sparkContext.defaultParallelism, wanted.count()))
        dealt = wanted.repartitionById(tasks, F.pmod(F.xxhash64("key"), F.lit(tasks)).cast("int"))
        return staged(dealt.mapInPandas(run, "key string, reply string"), "replies")

    def _grouped(self, pages: DataFrame) -> DataFrame:
        """key (of the document), doc_id, group_no, text of its page groups."""
        counted = pages if "n_tokens" in pages.columns else pages.withColumn("n_tokens", token_count(F.col("text")))
        return grouped_text(groups(counted, GROUP_TOKENS), counted).withColumn("key", _key())

    def outline(self, pages: DataFrame) -> DataFrame:
        """Sections of each document from its page groups in order, each group being asked with what was found before it."""
        ask = self.ask

        def fold(frame):
            import pandas as pd

            found: list[dict] = []
            for text in frame.sort_values("group_no")["text"]:
                task = 'List the sections that start on these pages as a JSON list of {"structure": dotted number, "title": text, "physical_index": "<physical_index_X>"}, going on after the sections so far.'
                found += _entries(parse_reply(ask([f"{task}\n\nSections so far:\n{json.dumps(found)}\n\nPages:\n{text}"])[0]))
            rows = [(frame["key"].iloc[0], k, str(x["structure"]) if x.get("structure") is not None else None, str(x["title"]), _number(x.get("physical_index"))) for k, x in enumerate(found)]
            return pd.DataFrame(rows, columns=["key", "list_index", "structure", "title", "physical_index"]).astype({"physical_index": "Int32"})

        grouped = staged(self._grouped(pages), "page-groups")
        made = grouped.select("key", "group_no", "text").groupBy("key").applyInPandas(fold, "key string, list_index long, structure string, title string, physical_index int")
        return staged(grouped.select("key", "doc_id").distinct().join(made, "key").drop("key"), "outlines")

    def place(self, items: DataFrame, pages: DataFrame) -> DataFrame:
        """Page indexes of the items, from the page groups in order; what a group doesn't show stays as it was."""
        ask = self.ask

        def fold(own, texts):
            import pandas as pd

            own = own.sort_values("list_index")
            found: dict[str, int] = {}
            for text in texts.sort_values("group_no")["text"]:
                listed = [{"title": t, "physical_index": found.get(t)} for t in own["title"]]
                task = 'Add "physical_index": "<physical_index_X>" to the sections of this JSON list that start on these pages, and return the whole list.'
                for x in _entries(parse_reply(ask([f"{task}\n\n{json.dumps(listed)}\n\nPages:\n{text}"])[0])):
                    if (n := _number(x.get("physical_index"))) is not None:
                        found.setdefault(x["title"], n)
            return pd.DataFrame({"key": own["key"], "list_index": own["list_index"], "physical_index": pd.array([found.get(t) for t in own["title"]], "Int32")})

        texts = self._grouped(pages).select("key", "group_no", "text")
        keyed = items.withColumn("key", _key())
        made = keyed.select("key", "list_index", "title").groupBy("key").cogroup(texts.groupBy("key")).applyInPandas(fold, "key string, list_index long, physical_index int")
        return keyed.join(staged(made, "placed-items"), ["key", "list_index"], "left").drop("key")

    def _yes_no(self, rows: DataFrame, task: str, fields: list[str], out: str) -> DataFrame:
        parts = [x for f in fields for x in (F.lit(f"\n\n{f}:\n"), F.coalesce(f, F.lit("")))]
        asked = self._ask(rows, F.concat(F.lit(f'{task} Answer with a JSON object {{"answer": "yes" or "no"}} only.'), *parts), "raw_reply")
        return asked.withColumn(out, yes_or_no(F.col("raw_reply"), "answer")).drop("raw_reply")

    def toc_pages(self, pages: DataFrame) -> DataFrame:
        return self._yes_no(pages, "Does this page belong to a table of contents?", ["text"], "is_toc")

    def has_numbers(self, tocs: DataFrame) -> DataFrame:
        return self._yes_no(tocs, "Does this table of contents give page numbers?", ["toc_text"], "numbered")

    def toc_items(self, tocs: DataFrame) -> DataFrame:
        task = 'Turn this table of contents into a JSON list of {"structure": dotted number or null, "title": text, "page": number or null}.\n\n'
        done = tocs.withColumn("items", F.array().cast(TOC_ITEMS)).withColumn("complete", F.lit("no"))
        # A long table of contents comes in several replies.  One after which the list is judged complete, or that adds nothing, is
        # the last, and no text has more items than characters.
        while not (left := done.where("complete <> 'yes'")).isEmpty():
            asked = self._ask(left, F.concat(F.lit(task), "toc_text", F.lit("\n\nGo on after these, with nothing if all are there:\n"), F.to_json("items")), "raw_reply")
            more = F.coalesce(extract_json(F.col("raw_reply"), TOC_ITEMS), F.array().cast(TOC_ITEMS))
            grown = asked.withColumn("more", more).withColumn("added", F.size(F.array_except("more", "items")) > 0)
            grown = grown.withColumn("items", F.when(F.col("added"), F.concat("items", "more")).otherwise(F.col("items"))).drop("raw_reply", "more", "complete")
            judged = self.toc_complete(grown.where("added"))
            full = F.size("items") >= F.coalesce(F.length("toc_text"), F.lit(0))
            grown = judged.withColumn("complete", F.when(full, "yes").otherwise(F.col("complete"))).unionByName(grown.where("not added").withColumn("complete", F.lit("yes"))).drop("added")
            done = staged(done.where("complete = 'yes'").unionByName(grown), "toc-replies")
        return done.drop("complete")

    def toc_complete(self, tocs: DataFrame) -> DataFrame:
        """``complete``: whether ``items`` are all sections of ``toc_text``."""
        listed = tocs.withColumn("listed", F.to_json("items"))
        return self._yes_no(listed, "Does this list have all sections of the table of contents?", ["toc_text", "listed"], "complete").drop("listed")

    def title_appears(self, rows: DataFrame) -> DataFrame:
        there = rows.where("page_text is not null")
        return self._yes_no(there, "Does a section with this title appear or start on this page?", ["title", "page_text"], "answer").unionByName(rows.where("page_text is null").withColumn("answer", F.lit("no")))

    def title_starts(self, rows: DataFrame) -> DataFrame:
        there = rows.where("page_text is not null")
        return self._yes_no(there, "Does this page begin with this title?", ["title", "page_text"], "appear_start").unionByName(rows.where("page_text is null").withColumn("appear_start", F.lit("no")))

    def headed(self, pages: DataFrame) -> DataFrame:
        return pages

    def searchable(self, items: DataFrame, pages: DataFrame) -> DataFrame:
        return pages

    def placed(self, items: DataFrame, searched: DataFrame) -> DataFrame:
        return self.place(items, searched)

    def gaps_filled(self, items: DataFrame, searched: DataFrame) -> DataFrame:
        return self.filled(items, searched)

    def locate(self, ranged: DataFrame, searched: DataFrame, first: str, last: str) -> DataFrame:
        rows = ranged.join(range_text(ranged, searched, first, last), ["doc_id", "list_index"], "left")
        asked = self._ask(rows, F.concat(F.lit(f"{_LOCATE}\n\nTitle: "), "title", F.lit("\n\n"), F.coalesce("content", F.lit(""))), "raw_reply")
        return asked.withColumn("fixed_index", index_number(extract_json(F.col("raw_reply"), "physical_index string")["physical_index"])).drop("raw_reply", "content")

    def filled(self, items: DataFrame, pages: DataFrame) -> DataFrame:
        """As with rules, but that each item of a gap is asked for with the text of what is left of its range.

        One task goes through a document's items in order and holds its pages."""
        ask = self.ask

        def walk(own, texts):
            import pandas as pd

            by_page = dict(sorted(zip(texts["physical_index"], texts["text"], strict=True)))
            before, found = 0, []
            for index, title, known, after in own.sort_values("list_index")[["list_index", "title", "known", "after"]].itertuples(index=False):
                if not pd.isna(known):
                    before = int(known)
                elif not pd.isna(after) and title is not None and (content := "".join(t for k, t in by_page.items() if before <= k <= after)):
                    reply = parse_reply(ask([f"{_LOCATE}\n\nTitle: {title}\n\n{content}"])[0])
                    if (n := _number(reply.get("physical_index") if isinstance(reply, dict) else None)) is not None:
                        before = n
                        found.append((own["key"].iloc[0], index, n))
            return pd.DataFrame(found, columns=["key", "list_index", "fixed_index"]).astype({"fixed_index": "Int32"})

        marked = items.withColumn("key", _key())
        gaps = marked.join(marked.where("physical_index is null").select("key").distinct(), "key", "left_semi")
        order = Window.partitionBy("key").orderBy(F.col("list_index").desc()).rowsBetween(Window.unboundedPreceding, -1)
        asked = gaps.select("key", "list_index", "title", F.col("physical_index").cast("double").alias("known"), F.last("physical_index", ignorenulls=True).over(order).cast("double").alias("after"))
        tagged = pages.select(_key().alias("key"), "physical_index", page_tag(F.col("physical_index"), F.col("text"), "\n\n").alias("text")).join(gaps.select("key").distinct(), "key", "left_semi")
        made = asked.groupBy("key").cogroup(tagged.groupBy("key")).applyInPandas(walk, "key string, list_index long, fixed_index int")
        return marked.select("key", "doc_id").distinct().join(staged(made, "filled-items"), "key").drop("key")

    def summary(self, rows: DataFrame, text: str, out: str, short: Column | None = None) -> DataFrame:
        """Only texts that are there and not short reach the model."""
        own = F.col(text).isNull() | F.coalesce(F.lit(False) if short is None else short, F.lit(False))
        marked = staged(rows.withColumn("is_own", own), "to-summarise")
        asked = self._ask(marked.where("not is_own"), F.concat(F.lit("Summarise this part of a document.\n\n"), text), out)
        return asked.unionByName(marked.where("is_own").withColumn(out, F.col(text))).drop("is_own")

    def description(self, docs: DataFrame) -> DataFrame:
        return self._ask(docs, F.concat(F.lit("Describe in one sentence a document with these sections: "), F.array_join("titles", "; ")), "description")


def load(name: str, converse: dict | None = None, tasks: int | None = None, replies: str | None = None) -> RuleReasoner:
    """The reasoner of an option: ``rules``, an import path ``package.module:function`` of a ``Complete``, or the name of a
    model behind the chat service that ``converse`` (url, concurrency, timeout) says."""
    if name == "rules":
        return RuleReasoner()
    if ":" in name and not (converse or {}).get("url"):
        module, _, function = name.partition(":")
        return ModelReasoner(getattr(importlib.import_module(module), function), tasks=tasks, replies=replies, name=name)
    from .sources.chat import ChatService

    if not (converse or {}).get("url"):
        raise ValueError(f"{name!r} is a model of a service; say its url")
    return ModelReasoner(ChatService(model=name, **converse), tasks=tasks, replies=replies, name=name)
