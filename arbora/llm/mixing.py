"""Mixing sources to target weights by systematic sampling.

Each source has a target in words, and each of its documents a number of expected copies, which is fixed before anything is
drawn.  The documents of a source are ordered from the longest to the shortest, their expected copies are summed up, one random
offset is added, and a document is taken once for each whole number that its sum crosses.

Expected copies would be target / size of the source for all, but for documents of which one alone is more than the error
that is allowed: those are expected a whole number of times.  They fall into levels, by how many times they could be halved
until the error allowed; a level has a number of copies, spread evenly over its documents.  That is the level's share of the
target, rounded, or a few more or less, by which the words of the level and of all levels of longer documents come nearest to
their share.  What they leave of the target is shared evenly among all other documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import repeated, small_side, staged

WEIGHTS, MOST_TIMES, SEED = (1, 2, 3), 3.0, 23
WORD = r"[^\x20\x09-\x0D]+"
#: The share of a source's target that a document of fractional expected copies may have at most.
ERROR = 2.0**-10
#: By how many copies a level may differ from its share.
EITHER_WAY = 8


def numbered(rows: DataFrame, order: list[Column], label: str, by: str | None = None) -> DataFrame:
    """``rows`` with ``rank``, from 1 in ``order``, in each group ``by``.

    Ranks come from counts over range partitions, so a group of any share of the rows is spread over tasks; counts are one row
    for each partition, or each group in it.
    """
    keys = [by] if by else []
    placed = staged(rows.repartitionByRange(*[F.col(k).asc_nulls_last() for k in keys], *order).withColumn("range", F.spark_partition_id()), label)
    counts = placed.groupBy(*keys, "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("range")) - F.col("n")
    known = staged(counts.select(*[F.col(k).alias("k_by") for k in keys], F.col("range").alias("k_range"), before.alias("before")), f"{label}-counts")
    local = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "range").orderBy(*order)))
    same = F.col("range") == F.col("k_range")
    joined = local.join(small_side(known), same & F.col(by).eqNullSafe(F.col("k_by")) if by else same)
    return joined.withColumn("rank", F.col("rank") + F.col("before")).select(*rows.columns, "rank")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: shares of all words by weight, each at most ``most_times`` its size.

    Weights repeat over the sources in code-point order, null last.  What is over a source's most is shared again by weight
    among the others: the level at which nothing more is over is found from sums over the sources, a few rounds of them.
    """
    ranked = numbered(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], "sources")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int"))
    weighted = staged(ranked.select("source", "source_size", weight.alias("weight")), "weights")
    all_words = float(weighted.agg(F.sum("source_size")).first()[0] or 0)
    level = over = -1.0
    most = F.col("source_size") * F.lit(most_times)
    while True:
        capped = F.col("weight") * F.lit(level) > most
        got = weighted.agg(F.count(F.when(capped, 1)).alias("n"), F.sum(F.when(capped, most).otherwise(0.0)).alias("taken"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if got["n"] == over or not got["weight"]:
            break
        over, level = got["n"], (all_words - got["taken"]) / got["weight"]
    return weighted.select("source", "source_size", F.least(F.col("weight") * F.lit(level), most).alias("target"))


def offset(seed: int) -> Column:
    """The random offset of a source, in [0, 1)."""
    return F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _spread(copies: Column, n: Column, rank: Column) -> Column:
    """How many of ``copies``, spread evenly over ``n`` documents, are due up to a rank."""
    return F.floor(copies * rank / n + 0.5).cast("long")


def levels(ranked: DataFrame, most_times: float) -> DataFrame:
    """l_source, l_level, n, first (rank before it), copies, copies_before, words, taken of each level of long documents.

    Sums over a level's documents are made for each number of copies that it may have, and then a source's levels, a few dozen
    at most, are gone through from the longest documents on.
    """
    long = ranked.where("level is not null")
    counts = long.groupBy("source", "level").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.first("ratio").alias("ratio"))
    counts = staged(counts.select(F.col("source").alias("l_source"), F.col("level").alias("l_level"), "n", (F.col("first") - 1).alias("first"), F.col("ratio").alias("l_ratio")), "levels")
    same = F.col("source").eqNullSafe(F.col("l_source")) & (F.col("level") == F.col("l_level"))
    met = long.join(small_side(counts), same)
    due = lambda k: F.least(F.floor(F.col("n") * most_times), F.greatest(F.lit(0), F.floor(F.col("l_ratio") * F.col("n") + 0.5) + k)).cast("long")
    rank = F.col("rank") - F.col("first")
    own = lambda k: _spread(due(F.lit(k)), F.col("n"), rank) - _spread(due(F.lit(k)), F.col("n"), rank - 1)
    tries = range(-EITHER_WAY, EITHER_WAY + 1)
    each = met.groupBy("l_source", "l_level", "n", "first", "l_ratio").agg(F.sum("size").alias("words"), F.array(*[F.struct(F.first(due(F.lit(k))).alias("copies"), F.sum(own(k) * F.col("size")).alias("taken")) for k in tries]).alias("tries"))
    rows = F.array_sort(F.collect_list(F.struct("l_level", "n", "first", "words", "l_ratio", "tries")))
    chosen = "array<struct<level:int,n:long,first:long,copies:long,copies_before:long,words:long,taken:long>>"
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("copies"), F.array().cast(chosen).alias("done"))

    def step(s: Column, x: Column) -> Column:
        words = s["words"] + x["words"]
        best = F.array_min(F.transform(x["tries"], lambda t: F.struct(F.abs(s["taken"] + t["taken"] - x["l_ratio"] * words).alias("off"), t["copies"].alias("copies"), t["taken"].alias("taken"))))
        row = F.struct(x["l_level"].alias("level"), x["n"].alias("n"), x["first"].alias("first"), best["copies"].alias("copies"), s["copies"].alias("copies_before"), x["words"].alias("words"), best["taken"].alias("taken"))
        return F.struct(words.alias("words"), (s["taken"] + best["taken"]).alias("taken"), (s["copies"] + best["copies"]).alias("copies"), F.array_append(s["done"], row).alias("done"))

    folded = each.groupBy("l_source").agg(F.aggregate(rows, start, step, lambda s: s["done"]).alias("done"))
    return staged(folded.select("l_source", F.explode("done").alias("x")).select("l_source", F.col("x.level").alias("l_level"), "x.n", "x.first", "x.copies", "x.copies_before", "x.words", F.col("x.taken").alias("level_taken")), "level-copies")


def expected(ranked: DataFrame, most_times: float) -> DataFrame:
    """``ranked`` (source, source_size, target, size, rank from the longest, ...) with ``upto``, the expected copies of a source's
    documents up to this one, and ``before``, those before it."""
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(most_times), F.col("target") / F.col("source_size"))).otherwise(0.0)
    level = F.when(F.col("size") > F.col("target") * ERROR, F.greatest(F.lit(-20), F.floor(F.log2(F.col("target") / F.col("size")))).cast("int"))
    rows = ranked.withColumns({"ratio": ratio, "level": level})
    known = levels(rows, most_times)
    sums = known.groupBy(F.col("l_source").alias("s_source")).agg(F.sum("n").alias("n_long"), F.sum("words").alias("long_size"), F.sum("level_taken").alias("long_taken"), F.sum("copies").alias("long_copies"))
    rows = rows.join(small_side(staged(sums, "long-documents")), F.col("source").eqNullSafe(F.col("s_source")), "left").drop("s_source")
    own = small_side(known.select("l_source", "l_level", "n", "first", "copies", "copies_before"))
    rows = rows.join(own, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("level") == F.col("l_level")), "left").drop("l_source", "l_level")
    n_long, left = F.coalesce("n_long", F.lit(0)), F.col("source_size") - F.coalesce("long_size", F.lit(0))
    share = F.when(left > 0, F.least(F.lit(most_times), F.greatest(F.lit(0.0), (F.col("target") - F.coalesce("long_taken", F.lit(0))) / left))).otherwise(0.0)

    def upto(rank: Column) -> Column:
        long = F.col("copies_before") + _spread(F.col("copies"), F.col("n"), rank - F.col("first"))
        return F.when(F.col("level").isNotNull(), long).otherwise(F.coalesce("long_copies", F.lit(0)) + F.col("share") * (rank - n_long))

    made = rows.withColumn("share", share).withColumns({"upto": upto(F.col("rank")), "before": upto(F.col("rank") - 1)})
    return made.drop("ratio", "level", "share", "n", "first", "copies", "copies_before", "n_long", "long_size", "long_taken", "long_copies")


def sampled(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: float = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, text_hash, size, source_size, target, copies, taken.

    Size is the number of words, runs of characters other than white space (null text: 0; a text may be of any length).  Null
    is a source like others.  Ties in size are ordered by a hash of doc_id and seed, so that results are the same from run to
    run; rows that repeat are drawn each by itself.  No document is taken more than ``most_times``.  Texts are read once, and
    what is written and shuffled afterwards has no texts.  An empty table gives an empty one.  Columns other than doc_id, text
    and source aren't read, so names can't clash.
    """
    text = F.col("text").cast("string")
    sizes = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    goals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_times)
    goals = staged(goals.select(F.col("source").alias("g_source"), "source_size", "target", offset(seed).alias("offset")), "targets")
    rows = sizes.join(small_side(goals), F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source").withColumn("tie", F.xxhash64("doc_id", F.lit(seed)))
    order = [F.col("size").desc(), F.col("tie").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_hash").asc_nulls_first()]
    ranked = staged(numbered(rows, order, "ranges", "source").drop("tie"), "ranked")
    made = expected(ranked, most_times)
    copies = F.least(F.lit(math.floor(most_times)), F.floor(F.col("upto") + F.col("offset")) - F.floor(F.col("before") + F.col("offset"))).cast("long")
    drawn = made.select("doc_id", "source", "text_hash", "size", "source_size", "target", copies.alias("copies"))
    return drawn.withColumn("taken", F.col("size") * F.col("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as it is taken, with their columns.

    Rows alike in doc_id, source and text are taken together as often as each of them would be; their other columns are
    then those of one of them.  Nulls, ties, very long texts and empty tables are as in ``sampled``; columns may have any name.
    """
    key = ["m_id", "m_source", "m_hash"]
    got = sampled(docs, **options).select(F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("text_hash").alias("m_hash"), "copies")
    got = staged(got.groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("alike")), "copies")
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d_id"), F.col("source").cast("string").alias("d_source"), F.xxhash64(text).alias("d_hash"))
    alike = not got.where("alike > 1").isEmpty()
    if alike:
        rows = rows.groupBy("d_id", "d_source", "d_hash").agg(F.first("row").alias("row"))
    wanted = small_side(got.where("copies > 0").select(*key, "copies"))
    same = F.col("d_id").eqNullSafe(F.col("m_id")) & F.col("d_source").eqNullSafe(F.col("m_source")) & (F.col("d_hash") == F.col("m_hash"))
    return repeated(rows.join(wanted, same).select("row", *key, "copies"), "copies", key if alike else None).select("row.*")
