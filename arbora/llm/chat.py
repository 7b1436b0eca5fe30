"""Preference formatting of conversations, with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, END = "<|{}|>\n", "<|end|>\n"
TRAINED = "assistant"
#: Lengths of turns that are added up at once.
BLOCK = 64


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    """Each turn as ``<|role|>``, a line break, its text, ``<|end|>`` and a line break."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END))), "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column, start: Column, count: Column) -> Column:
    return F.aggregate(F.slice(values, start + 1, count), F.lit(0).cast("long"), lambda a, x: a + x)


def before(lengths: Column) -> Column:
    """Of an array of numbers, the sum of those before each.

    Sums of blocks of BLOCK numbers and of BLOCK blocks are made first, so that each place adds up a few of them; only the sums
    of whole groups of BLOCK blocks are gathered one after another.
    """
    blocks = lambda values: F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / F.lit(BLOCK)).cast("int")), lambda b: _sum(values, b * BLOCK, F.lit(BLOCK)))

    def running(values: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.array(F.lit(0).cast("long")).alias("sums"))
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.array_append(s["sums"], s["sum"] + x).alias("sums"))
        return F.aggregate(values, start, step, lambda s: s["sums"])

    def at(lengths: Column, small: Column, large: Column) -> Column:
        def one(_: Column, i: Column) -> Column:
            block = F.floor(i / F.lit(BLOCK)).cast("int")
            group = F.floor(i / F.lit(BLOCK * BLOCK)).cast("int")
            return F.get(large, group) + _sum(small, group * BLOCK, block - group * BLOCK) + _sum(lengths, block * BLOCK, i - block * BLOCK)

        return F.transform(lengths, one)

    return _let(lengths, lambda own: _let(blocks(own), lambda small: _let(running(blocks(small)), lambda large: at(own, small, large))))


def mask(turns: Column) -> Column:
    """Where the loss counts in the rendered turns: (start, end) in characters of each assistant's text with its end mark."""
    sizes = F.transform(turns, lambda t: F.struct((t["role"] == TRAINED).alias("trained"), F.length(_head(t)).cast("long").alias("head"), (F.length(t["text"]) + F.lit(len(END))).cast("long").alias("body")))

    def spans(sizes: Column) -> Column:
        begun = before(F.transform(sizes, lambda s: s["head"] + s["body"]))
        placed = F.zip_with(sizes, begun, lambda s, at: F.struct(s["trained"].alias("trained"), (at + s["head"]).alias("start"), (at + s["head"] + s["body"]).alias("end")))
        return F.transform(F.filter(placed, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    return _let(sizes, spans)


def preferences(pairs: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, chosen, rejected: arrays of role and text) as pair_id, n_prompt, prompt, chosen, rejected,
    chosen_mask, rejected_mask.

    The longest run of turns with which both conversations begin is rendered once as the prompt, which has no loss; what
    follows is each side's completion.  Conversations that are alike have two empty completions.  Turns that are both null in
    role or text are alike in it.  Texts may be of any length; a conversation is one row.  Rows that repeat are so many pairs,
    and nothing is ordered, so there are no ties.  An empty table gives an empty one.  Columns other than the three aren't
    read, so names can't clash.
    """
    alike = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    differs = F.array_position(alike, F.lit(False))
    n = F.when(differs > 0, differs - 1).otherwise(F.size(alike)).cast("int")
    cut = pairs.select("pair_id", "chosen", "rejected", n.alias("n"))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    cut = cut.select("pair_id", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("prompt"), rest("chosen").alias("chosen"), rest("rejected").alias("rejected"))
    return cut.select("pair_id", F.col("n").cast("long").alias("n_prompt"), rendered(F.col("prompt")).alias("prompt"), rendered(F.col("chosen")).alias("chosen"), rendered(F.col("rejected")).alias("rejected"), mask(F.col("chosen")).alias("chosen_mask"), mask(F.col("rejected")).alias("rejected_mask"))


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as pair k.

    Turns are ordered by turn (null first), then role and text; a turn that repeats is a turn again.  Null roles and texts are
    empty, and rows without conv_id belong to no conversation.  A pair of which one side is missing is left out.  Texts may be
    of any length.  An empty table gives an empty one.  Columns other than conv_id, turn, role and text aren't read, so names
    can't clash.
    """
    rows = conversations.where("conv_id is not null").select(
        F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"),
        F.pmod(F.col("conv_id"), F.lit(2)).cast("int").alias("side"),
        F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("t")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = rows.groupBy("pair_id").agg(side(0).alias("chosen"), side(1).alias("rejected"))
    return both.where((F.size("chosen") > 0) & (F.size("rejected") > 0))
