"""Secret scans: patterns, and a battery of randomness tests over opaque strings.

An opaque string is a run of 12 or more of ``A-Za-z0-9+/_-`` whose encoding is inferred from the characters it holds.  A run
that fits no encoding, or with a part between ``/`` and ``+`` or between ``-`` and ``_`` that is clearly less like text than the
whole, is tested by these parts, and they by theirs, with p-values multiplied by the number of ways in which it could be cut.
Likelihoods of letters say where to cut, since they add up over parts; what is a discovery the tests alone say.

The battery has three tests over an encoding's alphabet, ordered from the symbols that are rarest in text to the commonest:
chi-squared uniformity over equal cells of the alphabet, more of them the longer the string is; the runs of symbols of the
rarer and of the commoner half; and the correlation of each symbol with the next.  Their p-values, under random symbols, are
combined into one, ``p_random``, by Fisher's method.

A discovery is false where the string is text, so what is controlled is the p-value of that: how often text, symbols drawn by
their shares in text, comes as near to a uniform alphabet as the string does, by chi-squared over three cells of the alphabet from
the rarest symbols to the commonest.  That is counted exactly over all ways to fill the cells up to EXACT symbols, and bounded
beyond (Sanov's bound for a convex set, which has no other factor).  Order tells nothing against text, whose symbols may come in
any, but it can refute randomness: the p-value is divided by ``p_random`` / DOUBT where that is below 1, and is 1 where ``p_random``
is below LEAST_RANDOM, so that a string that is sorted, alternating or uneven is no discovery.  The tests sharpen with length, and
p-values are weighted by length class, so that longer strings, which can be told apart, get more of the error budget of the
Benjamini-Hochberg procedure at rate ``q``.  The counts behind its threshold are of all strings of all documents, gathered as one
histogram of fixed size.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, small_batches, staged, tidied
from .words import strings

# The patterns of the contract.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)  # whole runs, as the contract's pattern matches, of this length or more
KINDS = ["assign", "access", "hex", "random"]

LEAST_OPAQUE = 12
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST_OPAQUE)
_OPAQUE_CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-"
_CUTS = [re.compile(r"[^/+]+"), re.compile(r"[^_-]+")]  # parts that may be base64url, and base64
_HINTS = ["password", "passwd", "secret", "token", "apikey", "api_key"]

#: Alphabets from the narrowest; the first that holds all of a string's characters is its encoding.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base32 lower": "abcdefghijklmnopqrstuvwxyz234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base36 upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_CLASSES = [frozenset("0123456789"), frozenset("abcdefghijklmnopqrstuvwxyz"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), frozenset("+/-_")]

#: Shares of symbols in ordinary identifiers, paths and slugs, by class: mostly small letters.
_TEXT_SHARE = [0.08, 0.80, 0.08, 0.04]
#: Shares of small letters in ordinary text, in order of frequency (fixed values, per mille).
_LETTERS = dict(zip("etaoinsrhldcumfpgwybvkxjqz", [127, 91, 82, 75, 70, 67, 63, 60, 61, 40, 43, 28, 28, 24, 22, 19, 20, 24, 20, 15, 10, 8, 2, 2, 1, 1], strict=True))
_LETTER_TOTAL = sum(_LETTERS.values())

LENGTH_EDGES = [20, 24, 32, 48, 64]  # of the length classes
LENGTH_WEIGHTS = [0.2, 0.4, 0.8, 1.2, 1.3, 1.3]  # mean 1 at most
STEP, BINS = 0.05, 2000  # of the histogram of -log10 p
RATE, LEAST_RANDOM, DOUBT = 0.01, 1e-4, 0.1
#: Cells of the alphabet for chi-squared: the fewest, and symbols of the string for each cell beyond.
CELLS, PER_CELL = 4, 5
#: Where an alphabet, from the rarest symbols in text, is cut for the p-value of text, and the longest string for which that is exact.
TEXT_CELLS, EXACT = (1 / 3, 3 / 4), 128
CLEAR = math.log(1000)  # how much more parts must tell than what they are cut from


def encoding(run: str) -> str | None:
    """The inferred encoding; None for what is too short, for a number, whose digits are even anyway, and for what fits none."""
    held = set(run)
    if len(run) < LEAST_OPAQUE or held <= _CLASSES[0]:
        return None
    return next((name for name, symbols in _SYMBOLS.items() if held <= symbols), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def cells(n: int, size: int) -> list[int]:
    """Where the cells of an alphabet of ``size`` symbols begin, and its end, for a string of ``n``."""
    count = min(size, max(CELLS, n // PER_CELL))
    return [-(-k * size // count) for k in range(count + 1)]


def _chi_squared_z(x: float, df: int) -> float:
    """About standard normal if ``x`` is chi-squared (Wilson and Hilferty's cube root)."""
    return ((x / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))


def tests(symbols: list[int], size: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation if the symbols, 0 to size - 1, were random."""
    n = len(symbols)
    edges = cells(n, size)
    counts = [0] * size
    for s in symbols:
        counts[s] += 1
    chi2 = sum((sum(counts[a:b]) - n * (b - a) / size) ** 2 / (n * (b - a) / size) for a, b in zip(edges, edges[1:], strict=False))
    uniform = 0.5 * math.erfc(_chi_squared_z(chi2, len(edges) - 2) / math.sqrt(2))
    high = [2 * s >= size for s in symbols]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 1 + 2 * a * b / n
        deviation = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        together = _two_sided((runs - mean) / deviation)
    else:
        together = 2.0 ** (1 - n)
    middle = sum(symbols) / n
    square = sum((s - middle) ** 2 for s in symbols)
    serial = _two_sided((sum((x - middle) * (y - middle) for x, y in zip(symbols, symbols[1:], strict=False)) / square + 1 / n) * math.sqrt(n)) if square else 0.0
    return uniform, together, serial


def combined(ps: tuple[float, ...]) -> float:
    """Fisher's method."""
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = 1.0
    for k in range(1, len(ps)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def _text_share(alphabet: str) -> dict[str, float]:
    """Shares of symbols in text that keeps to the alphabet.  Where that has one case, all letters are of that case."""
    held = set(alphabet)
    of_class = _TEXT_SHARE if held & _CLASSES[1] else [_TEXT_SHARE[0], 0.0, _TEXT_SHARE[1], _TEXT_SHARE[3]]
    share = {}
    for part, kind in zip(of_class, _CLASSES, strict=True):
        share |= {c: part * (_LETTERS[c.lower()] / _LETTER_TOTAL if c.isalpha() else 1 / len(kind)) for c in kind & held}
    total = sum(share.values())
    return {c: x / total for c, x in share.items()}


_SYMBOLS = {name: frozenset(a) for name, a in ENCODINGS.items()}
_SHARES = {name: _text_share(a) for name, a in ENCODINGS.items()}
#: The symbols from the rarest in text, and their places in that order.
_RANKED = {name: sorted(a, key=lambda c: (_SHARES[name][c], c)) for name, a in ENCODINGS.items()}
_PLACE = {name: {c: k for k, c in enumerate(a)} for name, a in _RANKED.items()}
_LOG_SHARES = {name: {c: math.log(x) for c, x in shares.items()} for name, shares in _SHARES.items()}
_TEXT_EDGES = {name: [0, *(round(x * len(a)) for x in TEXT_CELLS), len(a)] for name, a in _RANKED.items()}


@functools.cache
def text_cells(name: str) -> tuple[np.ndarray, np.ndarray]:
    """The shares of the three cells in text and among random symbols."""
    ends = list(zip(_TEXT_EDGES[name], _TEXT_EDGES[name][1:], strict=False))
    ranked = _RANKED[name]
    return np.array([sum(_SHARES[name][c] for c in ranked[a:b]) for a, b in ends]), np.array([(b - a) / len(ranked) for a, b in ends])


@functools.lru_cache(maxsize=128)
def _text_tail(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All values of chi-squared of ``n`` symbols, ascending, and the probability that text has one as small."""
    share, even = text_cells(name)
    first, second = (x.ravel() for x in np.indices((n + 1, n + 1)))
    filled = np.stack([first, second, n - first - second], 1)[first + second <= n]
    factorial = np.array([math.lgamma(k + 1) for k in range(n + 1)])
    chance = np.exp(factorial[n] + (filled * np.log(share) - factorial[filled]).sum(1))
    values = ((filled - n * even) ** 2 / (n * even)).sum(1)
    order = np.argsort(values)
    return values[order], np.cumsum(chance[order])


def _text_bound(name: str, n: int, chi2: float) -> float:
    """At least the probability that text has a chi-squared as small: exp(-n * the least divergence of such counts from text's)."""
    share, even = text_cells(name)
    if ((share - even) ** 2 / even).sum() <= chi2 / n:
        return 1.0
    angles = np.linspace(0, 2 * math.pi, 2000)
    across = np.linalg.svd(np.sqrt(even)[None, :])[2][1:]  # what leaves the sum of shares as it is
    edge = even + math.sqrt(chi2 / n) * np.sqrt(even) * (np.cos(angles)[:, None] * across[0] + np.sin(angles)[:, None] * across[1])
    edge = edge[(edge > 0).all(1)]
    return math.exp(-n * max(0.0, (edge * np.log(edge / share)).sum(1).min()))


def p_of_text(symbols: list[int], name: str) -> float:
    """How often text of the encoding has its symbols as evenly in the cells."""
    n, (_, low, high, _) = len(symbols), _TEXT_EDGES[name]
    counts = np.bincount([(s >= low) + (s >= high) for s in symbols], minlength=3)
    even = text_cells(name)[1]
    chi2 = float(((counts - n * even) ** 2 / (n * even)).sum())
    if n > EXACT:
        return _text_bound(name, n, chi2)
    values, chances = _text_tail(name, n)
    return min(1.0, float(chances[np.searchsorted(values, chi2 + 1e-9) - 1]))


def assess(run: str) -> tuple[float, float, float] | None:
    """The battery's combined p-value of an opaque string, the p-value of its being text, and what its symbols tell against text, in
    nats of likelihood, by which runs are cut; None if it has no encoding."""
    name = encoding(run)
    if name is None:
        return None
    symbols = [_PLACE[name][c] for c in run]
    p_random = combined(tests(symbols, len(_PLACE[name])))
    if p_random < LEAST_RANDOM:
        return p_random, 1.0, 0.0
    shares = _LOG_SHARES[name]
    nats = math.log(p_random) - sum(shares[c] for c in run) - len(run) * math.log(len(shares))
    return p_random, min(1.0, p_of_text(symbols, name) / min(1.0, p_random / DOUBT)), max(0.0, nats)


def tested(run: str, start: int = 0) -> list[tuple[int, int, float, float]]:
    """Start, end, p_text and nats of what is tested in a run: the whole, or parts that tell more."""
    got = assess(run)
    whole = [(start, start + len(run), *got[1:])] if got else []
    cuts: list[list[tuple[int, int, float, float]]] = []
    for cut in _CUTS:
        parts = [m for m in cut.finditer(run) if len(m[0]) >= LEAST_OPAQUE]
        if parts and len(parts[0][0]) < len(run):
            cuts.append([x for m in parts for x in tested(m[0], start + m.start())])
    best = max(cuts, key=_told, default=[])
    return best if not whole or max((nats for *_, nats in best), default=0.0) > whole[0][3] + CLEAR else whole


def _told(found: list[tuple[int, int, float, float]]) -> float:
    """How much parts tell, less for each more and a little for what they leave out, so that no key is cut for nothing."""
    return sum(nats - CLEAR + 0.1 * (b - a) for a, b, _, nats in found)


def ways(run: str) -> int:
    """In how many ways a run can be cut: at either kind of separators, both or none."""
    return (2 if "/" in run or "+" in run else 1) * (2 if "-" in run or "_" in run else 1)


def length_class(n: int) -> int:
    return sum(n >= edge for edge in LENGTH_EDGES)


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """Start, place in KINDS, end of every span that the patterns give."""
    found = []
    low = text.lower()  # may turn other letters into these, which costs a search and no more
    if any(x in low for x in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def holds_run(texts: pa.Array, characters: str, least: int) -> np.ndarray:
    """Whether each text may hold a run of ``least`` of these ASCII characters; a run across two texts counts for both."""
    texts = strings(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]]
    inside = np.zeros(256, "i1")
    inside[list(characters.encode())] = 1
    edges = np.flatnonzero(np.diff(inside[raw], prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    first, last = (np.searchsorted(offsets - offsets[0], x, side="right") - 1 for x in (starts[long], ends[long] - 1))
    steps = np.zeros(n + 1, "i8")
    np.add.at(steps, first, 1)
    np.add.at(steps, last + 1, -1)
    return np.cumsum(steps)[:n] > 0


def uncovered(spans: list[tuple[int, int, float]], base: list[tuple[int, int, int]]) -> list[list[tuple[int, int]]]:
    """Of each opaque string, in order and apart, the parts that no base span covers."""
    joint: list[list[int]] = []
    for a, _, b in base:
        if joint and a <= joint[-1][1]:
            joint[-1][1] = max(joint[-1][1], b)
        else:
            joint.append([a, b])
    out, k = [], 0
    for start, end, _ in spans:
        while k < len(joint) and joint[k][1] <= start:
            k += 1
        parts, at, j = [], start, k
        while j < len(joint) and joint[j][0] < end:
            if joint[j][0] > at:
                parts.append((at, joint[j][0]))
            at, j = max(at, joint[j][1]), j + 1
        out.append([*parts, (at, end)] if at < end else parts)
    return out


def scan_text(text: str, hexes: bool = True, opaques: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """The base spans, and of each opaque string that has an encoding: start, end, -log10 of its weighted p_text."""
    opaque = []
    for m in OPAQUE.finditer(text) if opaques else ():
        for start, end, p_text, _ in tested(m[0], m.start()):
            weighted = p_text * ways(m[0]) / LENGTH_WEIGHTS[length_class(end - start)]
            opaque.append((start, end, max(0.0, -math.log10(max(weighted, 1e-300)))))
    return base_spans(text, hexes), opaque


_SPAN = "struct<start:long,kind:int,end:long>"
_OPAQUE = "struct<start:long,end:long,strength:double,parts:array<struct<start:long,end:long>>>"


def _scan(docs: DataFrame) -> DataFrame:
    """Rows as ``row`` with ``base`` and ``opaque``."""
    small_batches(docs.sparkSession)
    rows = packed(docs).select("row", F.col("row.text").cast("string").alias("text"))
    kinds = rows.select("row").schema.simpleString().removeprefix("struct<row:").removesuffix(">")
    base = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    part = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    opaque = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("strength", pa.float64()), ("parts", pa.list_(part))]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hexes, opaques = holds_run(batch.column(1), ENCODINGS["hex"], LEAST_HEX), holds_run(batch.column(1), _OPAQUE_CHARS, LEAST_OPAQUE)
            got = [scan_text(x or "", h, o) for x, h, o in zip(batch.column(1).to_pylist(), hexes.tolist(), opaques.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in b] for b, _ in got], base), pa.array([[{"start": s[0], "end": s[1], "strength": s[2], "parts": [{"start": x, "end": y} for x, y in parts]} for s, parts in zip(o, uncovered(o, b), strict=True)] for b, o in got], opaque)],
                ["row", "base", "opaque"],
            )

    return rows.mapInArrow(tidied(scan), f"row {kinds}, base array<{_SPAN}>, opaque array<{_OPAQUE}>")


def threshold(scanned: DataFrame, q: float = RATE) -> float:
    """The least strength that is reported: Benjamini-Hochberg over all opaque strings, from at most BINS counts."""
    bins = scanned.select(F.explode("opaque").alias("o")).groupBy(F.least(F.floor(F.col("o.strength") / STEP), F.lit(BINS)).cast("int").alias("bin")).count().collect()
    tested, above, least = sum(r["count"] for r in bins), 0, math.inf
    for bin_, n in sorted(((r["bin"], r["count"]) for r in bins), reverse=True):
        above += n
        if 10 ** -(bin_ * STEP) * tested <= q * above:
            least = bin_ * STEP
    return least


def _random(least: float) -> Column:
    """What the patterns leave of the opaque strings that are reported."""
    parts = F.flatten(F.transform(F.filter("opaque", lambda o: o["strength"] >= F.lit(least)), lambda o: o["parts"]))
    return F.transform(parts, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")))


def find(docs: DataFrame, q: float = RATE, texts: bool = True) -> DataFrame:
    """The rows of ``docs`` as struct ``row`` with ``base`` and ``random``: arrays of (start, kind, end), in code points.

    A null text is empty and has no spans; nulls elsewhere don't matter.  Rows that repeat are scanned each by itself, and their
    strings count as often.  Spans of one place and kind can't tie; those of other kinds are all returned.  A very long text is
    scanned whole, and a very long string is one string.  An empty table gives an empty one.  Columns may have any name.
    Texts are scanned whole and once: the rows and what was found in them are written to the shared folder, from where the
    threshold and then the result are made.  Without ``texts`` the rows lose their text first.
    """
    scanned = _scan(docs)
    scanned = staged(scanned if texts else scanned.withColumn("row", F.col("row").dropFields("text")), "secrets")
    return scanned.select("row", "base", _random(threshold(scanned, q)).alias("random"))


def _string(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame, q: float = RATE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    found = find(docs.select("doc_id", "text"), q, texts=False).select("row.doc_id", "base", "random", F.concat("base", "random").alias("all"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("random").cast("long").alias("n_random"), F.sha2(_string("base"), 256).alias("base_sha256"), _string("all").alias("spans"))


def cut(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with ``mark`` in place of its spans; those that overlap or touch are replaced together."""
    out, at, open_ = [], 0, False
    for start, end in sorted(spans):
        if not open_ or start > at:
            out += [text[at:start], mark]
        at, open_ = max(at, end), True
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, q: float = RATE, mark: str = "[secret]") -> DataFrame:
    """The rows of ``docs``, every span of whose texts is replaced by ``mark``; spans that overlap or touch are replaced together.

    A text is cut once, in time in proportion to it and its spans.
    """
    place = F.transform(F.concat("base", "random"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(others)], F.lit(True).alias("there"))
    found = find(docs, q).select(rest.alias("rest"), F.col("row.text").cast("string").alias("text"), place.alias("spans"))
    small_batches(docs.sparkSession)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1), batch.column(2).to_pylist()
            if any(spans):
                texts = pa.array([cut(t, [(x["start"], x["end"]) for x in own], mark) if own else t for t, own in zip(texts.to_pylist(), spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["rest", "text"])

    kind = found.schema["rest"].dataType
    made = found.mapInArrow(tidied(clean), T.StructType([T.StructField("rest", kind), T.StructField("text", T.StringType())]))
    return made.select(*[F.col("text") if c == "text" else F.col(f"rest.c{others.index(c)}").alias(c) for c in docs.columns])
