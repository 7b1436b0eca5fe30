"""Quality rules as a ledger: every rule is judged once into a bit, and policies are masks over the bits.

``ledger`` gives the measurements and ``failed``, whose bit k is set where rule k fails.  A policy of any version is a set
of rule names; applying one, or asking what each of its rules alone removes, only combines masks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidied
from .words import WINDOW, mixed, per_text, strings, window_hashes, window_starts, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts"]
SYMBOLS = "#*$%&|<>"

#: Name and condition under which a document fails.  A rule's place is its bit, so new rules go to the end.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("capitals", "2 * n_upper > n_upper + n_lower and n_upper >= 20"),
    ("shouts", "5 * n_shouts > n_words"),
]
BASE = ["few_words", "repeated_windows"]
POLICIES: dict[str, list[str]] = {"base": BASE, "v1": BASE + ["symbols", "repeated_lines", "short_words", "long_words", "capitals", "shouts"]}


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of each text of a batch."""
    texts = strings(texts)
    n = len(texts)
    found = words(texts)
    lengths = pc.utf8_length(found.values).to_numpy().astype("i8")
    raw = np.frombuffer(texts.buffers()[2] or b"", "u1")
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + n + 1]
    raw, offsets = raw[offsets[0] : offsets[-1]], offsets - offsets[0]

    def having(characters: bytes) -> np.ndarray:
        table = np.zeros(256, "u1")
        table[list(characters)] = 1
        return per_text(table[raw], offsets)

    lines = pc.split_pattern(texts, "\n")
    at = lines.offsets.to_numpy()
    coded = pc.dictionary_encode(lines.values.slice(at[0], at[-1] - at[0]))
    wordy = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)), 0).to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy().astype("i8")
    text = np.repeat(np.arange(n), np.diff(at))
    seen = wordy[codes] if len(codes) else np.empty(0, bool)
    n_lines = np.bincount(text[seen], minlength=n)
    first = np.unique(text[seen] * max(1, len(wordy)) + codes[seen]) // max(1, len(wordy))

    starts, of = window_starts(found, WINDOW)
    hashes = window_hashes(mixed(found.codes.astype("u8") + np.uint64(1)), starts, WINDOW) ^ mixed(of.astype("u8"))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    twice = np.zeros(len(starts), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edges = np.zeros(len(found.codes) + 1, "i8")
    np.add.at(edges, starts[twice], 1)
    np.add.at(edges, starts[twice] + WINDOW, -1)
    return {
        "n_words": found.counts,
        "word_chars": per_text(lengths[found.codes] if len(found.codes) else np.empty(0, "i8"), found.bounds),
        "n_symbols": having(SYMBOLS.encode()),
        "n_dup_lines": n_lines - np.bincount(first, minlength=n),
        "n_repeat_words": per_text(np.cumsum(edges)[:-1] > 0, found.bounds),
        "n_lines": n_lines,
        "n_upper": having(bytes(range(65, 91))),
        "n_lower": having(bytes(range(97, 123))),
        "n_shouts": having(b"!"),
    }


def with_measures(docs: DataFrame) -> DataFrame:
    """The rows as struct ``row`` with the MEASURES of their ``text`` beside it (null: empty)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = measured(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[k], pa.int64()) for k in MEASURES)], ["row", *MEASURES])

    kinds = rows.select("row").schema.simpleString().removeprefix("struct<row:").removesuffix(">")
    return rows.mapInArrow(tidied(measure), f"row {kinds}, " + ", ".join(f"{k} long" for k in MEASURES))


def failed_bits() -> Column:
    """Every rule once, as a bit."""
    return sum((F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, condition) in enumerate(RULES)), F.lit(0).cast("long"))


def mask(policy: str | list[str]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    places = {name: k for k, (name, _) in enumerate(RULES)}
    return sum(1 << places[name] for name in set(names))


def passes(policy: str | list[str]) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ledger(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: row (as it was), MEASURES, failed.

    A null text is empty, so it fails ``few_words``; nulls elsewhere don't matter.  A very long text is measured whole, in
    memory in proportion to it.  Nothing is ordered, so there are no ties.  Columns of any name may stand beside ``text``; rows
    that repeat are judged each by itself; an empty table gives an empty one.
    """
    return with_measures(docs).withColumn("failed", failed_bits())


def ablations(ledger: DataFrame, policy: str | list[str]) -> DataFrame:
    """For each rule of a policy: documents it rejects, and those no other rule of the policy rejects.

    Documents are counted by their failure bits first, so what moves is at most one row for each set of bits and task.
    """
    m = mask(policy)
    sets = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES) if m >> k & 1]
    each = sets.select("bits", "n", F.explode(F.array(*rules)).alias("r"))
    total = F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0))
    alone = F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(total.alias("rejected"), alone.alias("rejected_alone"))


def judge(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """doc_id, the measurements, failed, base_failed and the policy's verdict ``kept``."""
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return ledger(docs.select("doc_id", "text")).select("row.doc_id", *MEASURES, "failed", base.alias("base_failed"), (~base & passes(policy)).alias("kept"))


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their columns."""
    return ledger(docs).where(passes(policy)).select("row.*")
