"""Token-id files: fixed-size blocks of ids, transposed into byte or bit planes, each compressed by itself.

A table of segments is the file.  A segment holds whole documents; its ``content`` is

    magic "APL1", then as little-endian u32: plane kind (8: byte, 1: bit), block size, ids, documents, blocks, planes;
    for each document its number of ids (u64);
    the chunk index: for each block and plane the offset in the payload (u64) and the compressed length (u64);
    the payload: zstandard frames, block after block, plane after plane.

A block holds ``block_ids`` ids, the last of a segment perhaps fewer.  The high planes of small ids are constant and cost a
few bytes; a reader of some ids decompresses only the blocks that hold them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import new_path
from .common import gathered, same_rows, small_batches, text_of, tidied
from .tokens import SLICE_BYTES, encoder

BLOCK_IDS, SEGMENT_IDS, END_ID = 65_536, 262_144, 0
_HEAD = struct.Struct("<4s6I")
SEGMENTS = "shard int, segment int, shard_start long, n_ids long, doc_ids array<long>, content binary"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The planes of one block: the least significant byte or bit of every id first."""
    raw = np.ascontiguousarray(ids, "<u4").view("u1").reshape(-1, 4)
    if not bits:
        return [raw[:, k].tobytes() for k in range(4)]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        return np.stack([np.frombuffer(x, "u1") for x in planes], axis=1).reshape(-1).view("<u4")
    spread = np.stack([np.unpackbits(np.frombuffer(x, "u1"), count=n, bitorder="little") for x in planes], axis=1)
    return np.packbits(spread, axis=1, bitorder="little").reshape(-1).view("<u4")


def write_segment(docs: list[bytes], block_ids: int = BLOCK_IDS, bits: bool = False, level: int = 3) -> bytes:
    """One segment of these documents' ids, each as little-endian u32."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    press = zstandard.ZstdCompressor(level=level)
    frames = [press.compress(plane) for i in range(0, len(ids), block_ids) for plane in to_planes(ids[i : i + block_ids], bits)]
    sizes = np.array([len(x) for x in frames], "<u8")
    index = np.stack([np.cumsum(sizes) - sizes, sizes], axis=1).astype("<u8")
    planes = 32 if bits else 4
    head = _HEAD.pack(b"APL1", 1 if bits else 8, block_ids, len(ids), len(docs), len(frames) // planes, planes)
    return b"".join([head, np.array([len(x) // 4 for x in docs], "<u8").tobytes(), index.tobytes(), *frames])


class Segment:
    """Reads a segment: ``lengths`` of the documents, and any range of ids through the chunk index."""

    def __init__(self, content: bytes):
        magic, kind, self.block_ids, self.n_ids, n_docs, n_blocks, self.planes = _HEAD.unpack_from(content)
        if magic != b"APL1":
            raise ValueError("not a segment of token ids")
        self.bits, at = kind == 1, _HEAD.size
        self.lengths = np.frombuffer(content, "<u8", n_docs, at).astype("i8")
        at += 8 * n_docs
        self.index = np.frombuffer(content, "<u8", 2 * n_blocks * self.planes, at).reshape(n_blocks, self.planes, 2)
        self.payload = memoryview(content)[at + 16 * n_blocks * self.planes :]

    def block(self, k: int) -> np.ndarray:
        open_ = zstandard.ZstdDecompressor()
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        return from_planes([open_.decompress(self.payload[int(a) : int(a + size)]) for a, size in self.index[k]], n, self.bits)

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else end
        if end <= start:
            return np.empty(0, "<u4")
        first = start // self.block_ids
        found = np.concatenate([self.block(k) for k in range(first, (end - 1) // self.block_ids + 1)])
        return found[start - first * self.block_ids : end - first * self.block_ids]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, segment_ids: int = SEGMENT_IDS, bits: bool = False) -> DataFrame:
    """The segments of all documents in ascending doc_id order, ``end_id`` after each.

    A null text is empty, a null doc_id comes first, and equal doc_ids are ordered by a hash of their texts, so that any
    number of them is spread over shards; rows that repeat are so many documents, and are numbered if they repeat very often, so
    that they are spread too.  Each range partition is a shard; ``shard_start`` counts the shard's ids before the segment.  A
    segment takes documents until it has ``segment_ids`` ids, so it is only larger where one very long document is.  An empty
    table gives no segments.  Columns other than doc_id and text aren't read, so names can't clash.
    """
    small_batches(docs.sparkSession)
    own = text_of(docs, F.col("doc_id").cast("long").alias("doc_id"))
    keyed = same_rows(own).spread(own).withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie", "copy").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, codec, end = context.partitionId() if context else 0, encoder(tokenizer), struct.pack("<I", end_id)
        segment = start = held = 0
        ids: list[bytes] = []
        names: list[int | None] = []

        def row() -> pa.RecordBatch:
            values = [shard], [segment], [start], [held], [names], [write_segment(ids, block_ids, bits)]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["shard", "segment", "shard_start", "n_ids", "doc_ids", "content"])

        for batch in gathered(batches, SLICE_BYTES):
            for name, got in zip(batch.column(0).to_pylist(), codec.encode(batch.column(1)), strict=True):
                ids.append(got.tobytes() + end)
                names.append(name)
                held += len(got) + 1
                if held >= segment_ids:
                    yield row()
                    start, segment, held, ids, names = start + held, segment + 1, 0, [], []
        if ids:
            yield row()

    return ordered.mapInArrow(tidied(write, encodes=True), SEGMENTS)


def read_ids(segments: DataFrame) -> DataFrame:
    """The documents of the segments: doc_id, start (ids before it in all), n_tokens, ids (binary, little-endian u32)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start, names, content in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                segment = Segment(content)
                ends = np.cumsum(segment.lengths)
                raw, starts = segment.ids().tobytes(), ends - segment.lengths
                for i in range(0, len(names), 1000):
                    part = slice(i, i + 1000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard] * len(names[part]), pa.int32()), pa.array(names[part], pa.int64()), pa.array(start + starts[part], pa.int64()), pa.array(segment.lengths[part], pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], pa.binary())],
                        ["shard", "doc_id", "in_shard", "n_tokens", "ids"],
                    )

    docs = segments.select("shard", "shard_start", "doc_ids", "content").mapInArrow(tidied(read), "shard int, doc_id long, in_shard long, n_tokens long, ids binary")
    # One row for each shard, and so as many as the writer had tasks.
    before = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("in_shard")).alias("start"), "n_tokens", "ids")


def file_round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write all documents to a file in the shared folder and read them back from it.

    The table isn't compressed once more, since its frames are."""
    segments, path = write_ids(docs, tokenizer, **options), new_path(docs.sparkSession, "token-ids")
    segments.write.option("compression", "none").parquet(path)
    return read_ids(docs.sparkSession.read.schema(segments.schema).parquet(path))

