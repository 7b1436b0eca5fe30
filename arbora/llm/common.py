"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import drop_staged, shared_dir, staged

__all__ = ["BATCH_ROWS", "REPEATS", "drop_staged", "gathered", "packed", "repeated", "same_rows", "shared_dir", "small_batches", "small_side", "staged", "table", "text_of", "tidied"]

#: Most rows and bytes in one Arrow batch, so that batches of long texts stay small.
BATCH_ROWS, BATCH_BYTES = 500, 8_000_000

#: Copies of a row that one task makes at most.
REPEATS = 1000
#: Rows and bytes of text up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 300_000, 24_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes; smaller settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not str(now).isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def tidied(work: Callable[[Iterator], Iterator], encodes: bool = False) -> Callable[[Iterator], Iterator]:
    """``work`` on a task's batches, after which memory that Arrow and the C library keep for later goes back to the system.

    Workers live on for other tasks, whose memory it would add to.  So would the encoders that a worker holds for tasks that encode,
    which any other task drops.
    """

    def run(batches: Iterator) -> Iterator:
        if not encodes and (tokens := sys.modules.get(f"{__package__}.tokens")) is not None:
            tokens.drop_encoders()
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # only glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def gathered(batches: Iterator[pa.RecordBatch], enough_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``enough_bytes``, for work that costs less in larger parts."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= enough_bytes:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_of(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and the text, a null text being empty."""
    return df.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def packed(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``, so that the columns an operator adds can't clash with theirs."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def small_side(df: DataFrame) -> DataFrame:
    """``df``, a written table of narrow rows, to be broadcast if it has few rows and its strings few bytes, and else as it is."""
    texts = [F.octet_length(c) for c, t in df.dtypes if t in ("string", "binary")]
    size = F.sum(sum((F.coalesce(x, F.lit(0)).cast("long") for x in texts), F.lit(0).cast("long"))) if texts else F.lit(0)
    got = df.agg(F.count("*").alias("n"), size.alias("size")).first()
    return F.broadcast(df) if got["n"] <= BROADCAST_ROWS and (got["size"] or 0) <= BROADCAST_BYTES else df


def repeated(df: DataFrame, times: str, key: list[str] | None = None) -> DataFrame:
    """Each row as often as its column ``times`` says (null: never), without it.

    A row is repeated in parts of at most REPEATS, which are dealt to tasks by ``key``, the columns that tell rows apart.
    Without a key rows stay where they are, which is for rows that are all taken a few times only.
    """
    n = F.coalesce(F.col(times), F.lit(0)).cast("long")
    part = df.where(n > 0).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(n / F.lit(REPEATS)).cast("long") - 1)))
    left = F.least(F.lit(REPEATS).cast("long"), n - F.col("_part") * REPEATS).cast("int")
    part = part.withColumn("_left", left).drop(times)
    dealt = part.repartition(*key, "_part") if key else part
    return dealt.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_left")))).drop("_part", "_left", "_again")


@dataclass(frozen=True)
class SameRows:
    """How many rows there are, and those that repeat often (doc_id, text_hash, times; a written table), if any."""

    n: int
    often: DataFrame | None

    def spread(self, rows: DataFrame) -> DataFrame:
        """``rows`` (doc_id, text) with ``copy``: 0, or the number in parts of REPEATS of a row that repeats often.

        Such rows are counted, and made again from one of them, so that a row's number doesn't depend on where it was read.
        """
        if self.often is None:
            return rows.withColumn("copy", F.lit(0).cast("long"))
        same = [F.col("doc_id").eqNullSafe(F.col("o_id")), F.xxhash64("text") == F.col("o_hash")]
        often = small_side(self.often.select(F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"), "times"))
        few = rows.join(often, same, "left_anti").withColumn("copy", F.lit(0).cast("long"))
        one = rows.join(often, same).groupBy("doc_id", "o_hash", "times").agg(F.get(F.collect_set("text"), F.lit(0)).alias("text"))
        part = one.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("times") / F.lit(REPEATS)).cast("long") - 1)))
        left = F.least(F.lit(REPEATS).cast("long"), F.col("times") - F.col("copy") * REPEATS)
        part = part.withColumn("_left", left).repartition("doc_id", "o_hash", "copy")
        many = part.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_left"))))
        return few.unionByName(many.select(*rows.columns, "copy"))


def same_rows(rows: DataFrame) -> SameRows:
    """Counts the rows (doc_id, text) and finds those of which there are over REPEATS, at most one in REPEATS."""
    counted = rows.groupBy("doc_id", F.xxhash64("text").alias("text_hash")).agg(F.count("*").alias("times"))
    got = counted.agg(F.sum("times").alias("n"), F.max("times").alias("most")).first()
    often = staged(counted.where(F.col("times") > REPEATS), "repeated-rows") if (got["most"] or 0) > REPEATS else None
    return SameRows(got["n"] or 0, often)
