"""Benchmark decontamination by winnowing.

An item's windows are its stretches of ``WINDOW`` consecutive words; an item of fewer words is one window.  Of every so many
consecutive k-grams, as a window holds, the one of least hash is a fingerprint (of several the first), so that a window chooses
the same one wherever it stands: a shared window is a shared fingerprint at the same place in it.  Items shorter than
``WINDOW`` are winnowed by their own length, and documents once for each such length that there is.

Fingerprints of documents and items are joined by hash, and a hit is extended to both sides as far as words agree and a
window that holds the fingerprint could reach.  Each fingerprint carries the words around it for that, so no text moves.  Most
fingerprints of documents meet no item: a bitmap of the items' hashes, of bounded size whatever the benchmark's, leaves them
out where they are made; what it lets through by chance the join drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, small_batches, small_side, staged, tidied
from .words import Words, mixed, strings, window_hashes, window_starts, words

WINDOW, GRAM = 10, 5
#: Bits of the bitmap for each fingerprint, and the fewest and most bits (16 MB), as powers of two.
BITS_EACH, FEWEST_BITS, MOST_BITS = 64, 16, 27
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MADE = pa.struct([("size", pa.int32()), ("at", pa.int64()), ("hash", pa.int64()), ("before", pa.list_(pa.string())), ("gram", pa.string()), ("after", pa.list_(pa.string()))])
_KIND = "array<struct<size:int,at:long,hash:long,before:array<string>,gram:string,after:array<string>>>"
_BATCH_BYTES = 2_000_000


def normal_words(texts: pa.Array) -> Words:
    """Words of lower-cased texts: runs of ASCII letters, digits and characters beyond ASCII."""
    texts = strings(texts)
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, "i8")
    raw = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]).translate(_TABLE)
    return words(pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw)]))


def shape(size: int, gram: int = GRAM) -> tuple[int, int]:
    """Words of a k-gram, and k-grams of a window, for windows of ``size`` words."""
    k = min(gram, size)
    return k, size - k + 1


def fingerprints(found: Words, of_word: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first word, text and hash of each fingerprint of the windows of ``size`` words."""
    k, grams = shape(size)
    starts, text = window_starts(found, k)
    hashes = mixed(window_hashes(of_word, starts, k) ^ np.uint64(size))
    if len(starts) < grams:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "u8")
    first = np.arange(len(starts) - grams + 1)
    inside = text[: len(first)] == text[grams - 1 :]
    least, best = hashes[: len(first)].copy(), first.copy()
    for j in range(1, grams):
        lower = hashes[j : j + len(first)] < least
        least[lower], best[lower] = hashes[j : j + len(first)][lower], first[lower] + j
    chosen = np.unique(best[inside])
    return starts[chosen], text[chosen], hashes[chosen]


def _word_hashes(found: Words) -> np.ndarray:
    import xxhash

    each = np.array([xxhash.xxh3_64_intdigest(x) for x in found.values.cast(pa.large_binary()).to_pylist()], "u8")
    return each[found.codes] if len(found.codes) else np.empty(0, "u8")


def _listed(found: Words, sizes: list[int], passing: np.ndarray | None, one_size: bool) -> pa.Array:
    """The fingerprints of each text with the words around them.  With ``one_size`` a text has those of its own size only."""
    of_word, made = _word_hashes(found), []
    for size in sizes:
        at, text, hashes = fingerprints(found, of_word, size)
        kept = np.ones(len(at), bool) if passing is None else held(passing, hashes)
        if one_size:
            own = np.minimum(found.counts, WINDOW)
            kept &= own[text] == size
        made.append((np.full(int(kept.sum()), size), at[kept], text[kept], hashes[kept]))
    size, at, text, hashes = (np.concatenate(x) for x in zip(*made, strict=True)) if made else [np.empty(0, "i8")] * 4
    order = np.argsort(text, kind="stable")
    size, at, text, hashes = size[order], at[order], text[order], hashes[order].astype("u8").view("i8")
    rows = []
    for s, p, t, h in zip(size.tolist(), at.tolist(), text.tolist(), hashes.tolist(), strict=True):
        k, grams = shape(s)
        low, high = max(int(found.bounds[t]), p - grams + 1), min(int(found.bounds[t + 1]), p + k + grams - 1)
        around = found.values.take(pa.array(found.codes[low:high])).to_pylist()
        before, gram, after = around[: p - low][::-1], around[p - low : p - low + k], around[p - low + k :]
        rows.append({"size": s, "at": p - int(found.bounds[t]), "hash": h, "before": before, "gram": " ".join(gram), "after": after})
    offsets = np.searchsorted(text, np.arange(len(found.counts) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows, _MADE))


def held(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    bit = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(bit >> np.uint64(6)).astype("i8")] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def bitmap(prints: DataFrame, n: int) -> np.ndarray:
    """The bits of the hashes of ``prints``, which has ``n`` rows.  Its size ends at 2 ** MOST_BITS bits."""
    bits = min(MOST_BITS, max(FEWEST_BITS, (BITS_EACH * max(1, n) - 1).bit_length()))
    bit = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    set_ = prints.groupBy(F.shiftright(bit, 6).alias("place")).agg(F.bit_or(F.expr("shiftleft(1L, cast(hash & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), "u8")
    out[set_.column("place").to_numpy()] = set_.column("bits").to_numpy().view("u8")
    return out


def _fingerprinted(rows: DataFrame, key: str, sizes: list[int], passing: np.ndarray | None, one_size: bool) -> DataFrame:
    """key, text_hash, n_words and ``prints`` of each row."""
    small_batches(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast((sizes, passing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, passing = sent.value
        for batch in gathered(batches, _BATCH_BYTES):
            found = normal_words(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.counts, pa.int64()), _listed(found, sizes, passing, one_size)], [key, "text_hash", "n_words", "prints"])

    kind = rows.schema[key].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(key, F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(tidied(run), f"`{key}` {kind}, text_hash long, n_words long, prints {_KIND}")


def _agreeing(a: str, b: str) -> Column:
    """With how many alike words two lists begin."""
    alike = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(alike, F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(alike)).cast("long")


def _prints(made: DataFrame, name: str, *keys: str) -> DataFrame:
    """One row for each fingerprint, its columns beginning with ``name``."""
    each = made.select(*keys, F.explode("prints").alias("p"))
    return each.select(*keys, F.col("p.hash").alias("hash"), F.col("p.size").alias(f"{name}_size"), F.col("p.at").alias(f"{name}_at"), *[F.col(f"p.{c}").alias(f"{name}_{c}") for c in ("before", "gram", "after")])


def scanned(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, text_hash, n_words), and the spans in them: doc_id, text_hash, item_id, start, end in words.

    A span is a stretch of a document that agrees with one of an item, and holds a window of it.  Spans of several fingerprints
    of one stretch overlap.  A null text has no words; very long texts are read whole.  Rows that repeat are so many documents or
    items.  Items without item_id have spans like others.  Nothing is ordered, so there are no ties.  Empty tables give empty
    ones.  Columns other than doc_id or item_id and text aren't read, so names can't clash.
    """
    items = items.select("item_id", "text")
    known = staged(_fingerprinted(items, "item_id", list(range(1, WINDOW + 1)), None, one_size=True), "benchmark-prints")
    prints = staged(_prints(known, "i", "item_id").distinct(), "benchmark-hashes")
    sizes = [r["i_size"] for r in prints.select("i_size").distinct().collect()]  # WINDOW of them at most
    passing = bitmap(prints, prints.count())
    made = staged(_fingerprinted(docs.select("doc_id", "text"), "doc_id", sorted(sizes), passing, one_size=False), "document-prints")
    some = _prints(made.where(F.size("prints") > 0), "d", "doc_id", "text_hash")
    met = some.join(small_side(prints), "hash").where("d_size = i_size and d_gram = i_gram")
    before, after = _agreeing("d_before", "i_before"), _agreeing("d_after", "i_after")
    gram = F.least(F.col("d_size"), F.lit(GRAM)).cast("long")
    spans = met.select("doc_id", "text_hash", "item_id", "d_size", (F.col("d_at") - before).alias("start"), (F.col("d_at") + gram + after).alias("end"))
    return made.select("doc_id", "text_hash", "n_words"), spans.where("end - start >= d_size").drop("d_size")


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end: what documents share with items, joined where it overlaps or touches."""
    spans = scanned(docs, items)[1].groupBy("doc_id", "text_hash", "item_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    each = spans.select("doc_id", "text_hash", "item_id", F.posexplode("s").alias("k", "s")).select("doc_id", "text_hash", "item_id", "k", "s.*")
    by = Window.partitionBy("doc_id", "text_hash", "item_id").orderBy("k")
    new = each.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    runs = new.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "text_hash", "item_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("text_hash", "run")


def _covered(spans: Column) -> Column:
    """How many words the spans, in order, cover."""
    start = F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda done, s: F.struct(F.greatest(done["to"], s["end"]).alias("to"), (done["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(done["to"], s["start"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda done: done["n"])


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``.

    Items are counted and named by item_id; one without marks words, and is neither counted nor named.
    """
    rows, spans = scanned(docs, items)
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    found = spans.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), ids.alias("ids"))
    found = staged(found.select(F.col("doc_id").alias("f_id"), F.col("text_hash").alias("f_hash"), _covered(F.col("spans")).alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("text_hash") == F.col("f_hash"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = rows.join(small_side(found), same, "left")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
