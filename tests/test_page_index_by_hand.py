"""The page plan against one document after another in plain Python, over documents with and without tables of contents."""

from __future__ import annotations

import random
import re
from collections import Counter

from arbora.plans import pages as plan

LIMIT, MOST_PAGES, MOST_TOKENS = 4, 4, 25


def squeezed(text):
    return re.sub(r"\s+", "", text).lower()


def has(page, title):
    return page is not None and squeezed(title) in squeezed(page)


class Document:
    """``pages`` from 1 to n; ``pages[k]`` may be missing where a part of a document is looked at by itself."""

    def __init__(self, pages: dict[int, str]):
        self.pages, self.n = pages, max(pages)

    def first_with(self, title, first, last):
        return next((k for k in sorted(self.pages) if first <= k <= last and has(self.pages[k], title)), None)

    def contents(self):
        """Items with page numbers, or without, and the last page of the table of contents; None without one."""
        yes = {k: len(re.findall(r"(?m)\d[ \t]*$", t)) >= 3 for k, t in self.pages.items()}
        if not any(yes[k] for k in yes if k <= LIMIT):
            return None
        runs, noes = {}, 0
        for k in sorted(self.pages):
            noes += not yes[k]
            if yes[k]:
                runs.setdefault(noes, []).append(k)
        tocs = []
        for _, own in sorted(runs.items()):
            if own[0] <= LIMIT:
                text = re.sub(r"(?:\. ){5,}\.?", ": ", re.sub(r"\.{5,}", ": ", "".join(self.pages[k] for k in own)))
                numbered = 2 * len(re.findall(r"(?m)\d[ \t]*$", text)) > len(re.findall(r"(?m)\S[ \t]*$", text))
                tocs.append((not numbered, text, own[-1]))
        plain, text, last = min(tocs, key=lambda t: t[0])
        if plain:
            return None
        items = []
        for line in text.split("\n"):
            code, title, page = re.fullmatch(r"\s*((?:\d+\.)*\d+)?\.?\s*(.*?)[\s.:]*(\d+)?\s*", line).groups()
            if title and (code or page):
                items.append({"structure": code, "title": title, "page": int(page) if page else None})
        return items, last

    def by_numbers(self, items, last):
        shown = [self.first_with(x["title"], last + 1, last + LIMIT) for x in items]
        differences = [at - y["page"] for x, at in zip(items, shown, strict=True) if at is not None and at >= last for y in items if y["title"] == x["title"] and y["page"] is not None]
        counts = Counter(differences)
        offset = max(counts, key=lambda d: (counts[d], -differences.index(d)), default=None)
        at = [x["page"] + offset if x["page"] is not None and offset is not None else None for x in items]
        found = list(at)
        for k, x in enumerate(items):
            if at[k] is None:
                before = next((a for a in reversed(found[:k]) if a is not None), 0)  # what has just been found, too
                after = next((a for a in at[k + 1 :] if a is not None), -1)
                found[k] = self.first_with(x["title"], before, after)
        return [{**x, "at": a} for x, a in zip(items, found, strict=True)]

    def by_titles(self, items, last):
        return [{**x, "at": self.first_with(x["title"], last + 1, self.n)} for x in items]

    def outline(self):
        heads = [(k, self.pages[k].split("\n", 1)[0].strip()) for k in sorted(self.pages)]
        return [{"structure": str(n + 1), "title": t, "at": k} for n, (k, t) in enumerate((k, t) for k, t in heads if t and len(t) <= 80)]

    def accepted(self, items):
        """The items with numbers if they are right or mostly right and mended, else none."""
        items = [{**x, "k": k, "at": x["at"] if x["at"] <= self.n else None} for k, x in enumerate(items) if x["at"] is not None]
        checked = [x for x in items if x["at"] is not None]
        wrong = [x["k"] for x in checked if not has(self.pages.get(x["at"]), x["title"])]
        if not checked or checked[-1]["at"] < self.n / 2:
            return []
        right = 1 - len(wrong) / len(checked)
        if wrong and right <= 0.6:
            return []
        for _ in range(3):
            fixed = {}
            for j, x in enumerate(items):
                if x["k"] in wrong:
                    before = next((y["at"] for y in reversed(items[:j]) if y["k"] not in wrong and y["at"] is not None), 0)
                    after = next((y["at"] for y in items[j + 1 :] if y["k"] not in wrong and y["at"] is not None), self.n)
                    fixed[x["k"]] = self.first_with(x["title"], before, after)
            for x in items:
                x["at"] = fixed.get(x["k"]) or x["at"]
            wrong = [k for k, at in fixed.items() if at is None]
            if not wrong:
                break
        return items

    def sections(self):
        toc = self.contents()
        return (toc and (self.accepted(self.by_numbers(*toc)) or self.accepted(self.by_titles(*toc)))) or self.accepted(self.outline())

    def spans(self, items, end):
        items = [x for x in items if x["at"] is not None]
        out = []
        for x, y in zip(items, [*items[1:], None], strict=False):
            starts = y and self.pages.get(y["at"]) is not None and squeezed(self.pages[y["at"]]).startswith(squeezed(y["title"]))
            out.append((x, x["at"], end if y is None else y["at"] - 1 if starts else y["at"]))
        return out

    def nodes(self):
        items = self.sections()
        if items and (items[0]["at"] or 0) > 1:
            items = [{"structure": "0", "title": "Preface", "at": 1, "k": items[0]["k"] - 1}, *items]
        known, found = {}, {}
        for x, start, end in self.spans(items, self.n):
            above = known.get(x["structure"].rpartition(".")[0], ()) if x["structure"] and "." in x["structure"] else ()
            path = (*above, x["k"])
            if x["structure"]:
                known[x["structure"]] = path
            found[path] = [x["title"], start, end]
        frontier = dict(found)
        while frontier:
            cut, added, again = [], {}, {}
            for path, (title, start, end) in frontier.items():
                inside = {k: self.pages[k] for k in range(max(start, 1), end + 1) if k in self.pages}
                if end - start <= MOST_PAGES or sum(len(t) // 4 for t in inside.values()) < MOST_TOKENS:
                    continue
                cut.append(path)
                part = Document(inside)
                rest = [x for x in part.accepted(part.outline()) if x["at"] is not None]
                rest = rest[1:] if rest and rest[0]["title"].strip() == title.strip() else rest
                below = {(*path, x["k"]): [x["title"], a, b] for x, a, b in part.spans(rest, end)}
                added |= below
                again |= {p: v for p, v in below.items() if v[1] > start or v[2] < end}
                if below:
                    found[path][2] = below[min(below)][1]
            found = {p: v for p, v in found.items() if not any(p != c and p[: len(c)] == c for c in cut)} | added
            frontier = again
        order = sorted(found)
        text = lambda a, b: "".join(self.pages[k] for k in range(max(a, 1), b + 1) if k in self.pages)[:200] if a and b else None
        return [(list(p), n, found[p][0], found[p][1], found[p][2], not (n + 1 < len(order) and len(order[n + 1]) > len(p)), text(*found[p][1:])) for n, p in enumerate(order)]


def made(seed):
    """Pages of a document: perhaps a table of contents, with or without pages, some of them missing or wrong, and sections."""
    rng = random.Random(seed)
    kind = rng.choice(["numbers", "numbers", "numbers", "wrong", "late", "none", "two"])
    titles = [f"{rng.choice(['Alpha', 'Beta', 'Gamma', 'Delta'])} part {seed}-{k}x" for k in range(rng.randint(3, 8))]
    codes, top, sub = [], 0, 0
    for _ in titles:
        if top and rng.random() < 0.4:
            sub += 1
            codes.append(f"{top}.{sub}")
        else:
            top, sub = top + 1, 0
            codes.append(str(top))
    body, at = [], []
    for t in titles:
        at.append(len(body) + 1)
        body.append(rng.choice([f"{t}\n" + "words of it " * rng.randint(1, 9), f"{'Some longer words before the title of this section, ' * 2}\n{t.upper()}\nmore"]))
        body += [rng.choice(["plain words " * rng.randint(8, 14), "Inner head\n" + "and text " * 10, ""]) for _ in range(rng.choice([0, 0, 1, 2, 7]))]
    front = ["Cover page with a line that is quite long, longer than any title of a section may be, so it is none"] * rng.randint(0, 2)
    if kind == "none":
        return front + body
    shift = rng.randint(-1, 3)
    lines = []
    for c, t, a in zip(codes, titles, at, strict=True):
        page = a + shift if kind != "wrong" else rng.randint(1, 30)
        lines.append(f"{c} {t} ....... {page}" if rng.random() < 0.85 else f"{c}. {t}")
    if kind == "numbers" and rng.random() < 0.7 and len(titles) > 3:  # two without a page, the second of which is named before the first begins
        k = rng.randrange(1, len(titles) - 2)
        lines[k], lines[k + 1] = f"{codes[k]} {titles[k]}", f"{codes[k + 1]} {titles[k + 1]}"
        body[at[k - 1] - 1] += f"\nsee {titles[k + 1]}"
    if kind == "late":
        front += ["Words alone, on pages that stand before the contents and have lines that are too long for titles of sections"] * LIMIT
    if kind == "two":
        front += ["1 a\n2 b\n3 c\nno number here\nnor here\nnor there\nnor anywhere"] + ["Words between them, which go on for a while so that nobody would take this line for a title at all"]
    cut = rng.randint(3, len(lines)) if len(lines) > 5 else len(lines)
    return [*front, "\n".join(lines[:cut]) + "\n", *(["\n".join(lines[cut:])] if cut < len(lines) else []), *body]


def test_page_index_by_hand(spark):
    documents = {seed: made(seed) for seed in range(150)}
    rows = [(d, k, t) for d, pages in documents.items() for k, t in enumerate(pages, 1)]
    options = {"toc_check_page_num": LIMIT, "max_page_num_each_node": MOST_PAGES, "max_token_num_each_node": MOST_TOKENS}
    got: dict = {}
    for r in plan.build(spark.createDataFrame(rows, "doc_id int, physical_index int, text string"), options).orderBy("doc_id", "node_ord").collect():
        got.setdefault(r["doc_id"], []).append((r["path"], r["node_ord"], r["title"], r["start_index"], r["end_index"], r["is_leaf"], r["summary"]))
    kinds = Counter()
    for d, pages in documents.items():
        document = Document(dict(enumerate(pages, 1)))
        want = document.nodes()
        assert got.get(d, []) == want, (d, pages)
        toc = document.contents()
        kinds["numbers" if toc and document.accepted(document.by_numbers(*toc)) else "titles" if toc and document.accepted(document.by_titles(*toc)) else "outline"] += 1
        kinds["deep"] += any(len(n[0]) > 1 for n in want)
    assert min(kinds["numbers"], kinds["titles"], kinds["outline"], kinds["deep"]) > 5, kinds
