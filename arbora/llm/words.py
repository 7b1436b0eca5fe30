"""White-space words and word windows of a whole Arrow batch of texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 5
#: Odd multipliers, one for each word of a window, by the 64-bit golden ratio.
_ODD = [((k * 0x9E3779B97F4A7C15) | 1) & 0xFFFFFFFFFFFFFFFF for k in range(3, 67)]


@dataclass
class Words:
    """Words are the runs of characters other than space and \\x09-\\x0D."""

    codes: np.ndarray  # of each word, its place in ``values``
    values: pa.Array  # the different words
    bounds: np.ndarray  # of text k: codes[bounds[k]:bounds[k + 1]]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def strings(column: pa.Array) -> pa.Array:
    """The texts with 64-bit offsets, so that a batch may hold more than 2 GB; null is empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def words(texts: pa.Array) -> Words:
    parts = pc.ascii_split_whitespace(texts)
    offsets = parts.offsets.to_numpy()
    values = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    kept = pc.greater(pc.binary_length(values), 0)
    before = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    coded = pc.dictionary_encode(values.filter(kept))
    return Words(coded.indices.to_numpy().astype("i8"), coded.dictionary, before[offsets - offsets[0]].astype("i8"))


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum over each text."""
    before = np.concatenate([[0], np.cumsum(flags, dtype="i8")])
    return before[bounds[1:]] - before[bounds[:-1]]


def window_starts(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of ``size`` words that lie in one text start, and their texts."""
    text = np.repeat(np.arange(len(found.counts)), found.counts)
    if len(text) < size:
        return np.empty(0, "i8"), np.empty(0, "i8")
    starts = np.flatnonzero(text[: len(text) - size + 1] == text[size - 1 :])
    return starts, text[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no visible pattern."""
    x = x.astype("u8", copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(of_word: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each window from those of its words."""
    total = np.zeros(len(starts), "u8")
    for k in range(size):
        total += of_word[starts + k] * np.uint64(_ODD[k])
    return mixed(total)
