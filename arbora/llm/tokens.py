"""Token ids of whole texts, as unsigned 32-bit integers."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import strings

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes that a worker's remembered units may take in all, units of the level that is merged often, and bytes of text that
#: are taken at a time if no text is longer.
CACHE_BYTES, RECENT_UNITS, SLICE_BYTES = 48_000_000, 50_000, 4_000_000

#: All white space of either the tokenizers library or Python, for RE2.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_encoders: dict[str, Encoder] = {}


class Remembered:
    """Ids of units by a 96-bit hash, in arrays of about 30 bytes a unit, so that what a worker holds is bounded in bytes.

    There are two levels sorted by the first part of the hash, a small one that is merged with what is new at each call, and
    a large one with which it is merged when it is full.  All is forgotten where more than CACHE_BYTES are held.
    """

    def __init__(self, most_id: int = 2**32 - 1):
        self.kind = "<u2" if most_id < 2**16 else "<u4"
        self.forget()

    def forget(self) -> None:
        self.levels = [tuple(np.empty(0, k) for k in ("u8", "u4", "u4", "u4"))] * 2  # first and second part, start, length
        self.ids, self.used = np.empty(1024, self.kind), 0

    @property
    def held(self) -> int:
        return self.ids.nbytes + sum(x.nbytes for level in self.levels for x in level)

    @staticmethod
    def keys(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, units)), "<u8").reshape(-1, 2)
        return np.ascontiguousarray(both[:, 0]), both[:, 1].astype("u4")

    def find(self, keys: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each key whether it is known, and where its ids start and how many they are."""
        n = len(keys[0])
        known, start, length = np.zeros(n, bool), np.zeros(n, "i8"), np.zeros(n, "i8")
        for first, second, starts, lengths in self.levels:
            if len(first):
                at = np.minimum(np.searchsorted(first, keys[0]), len(first) - 1)
                same = (first[at] == keys[0]) & (second[at] == keys[1])
                known |= same
                start[same], length[same] = starts[at[same]], lengths[at[same]]
        return known, start, length

    def add(self, keys: tuple[np.ndarray, np.ndarray], ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Remember the ids of new keys; where they start."""
        if self.used + len(ids) > len(self.ids):
            grown = np.empty(self.used + len(ids) + len(self.ids) // 4, self.kind)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(ids)] = ids
        start = self.used + np.cumsum(length) - length
        self.used += len(ids)
        self.levels[1] = self._merged(self.levels[1], (*keys, start.astype("u4"), length.astype("u4")))
        if len(self.levels[1][0]) > RECENT_UNITS:
            self.levels = [self._merged(*self.levels), tuple(x[:0] for x in self.levels[1])]
        return start

    @staticmethod
    def _merged(one: tuple, other: tuple) -> tuple:
        order = np.argsort(other[0], kind="stable")
        at = np.searchsorted(one[0], other[0][order])
        return tuple(np.insert(a, at, b[order]) for a, b in zip(one, other, strict=True))


class Encoder:
    """Ids by the tokenizers library without special tokens added.

    A byte-level pre-tokenizer never joins a visible character with white space that follows it, so a text may be cut
    there, and the ids of the whole are those of the units in turn.  Units repeat a lot; their ids are remembered.
    Only a text that holds a special token or a zero character is encoded in one piece.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        before = said.get("pre_tokenizer") or {}
        self.by_unit = before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space") and not said.get("normalizer")
        self.uncut = "|".join([r"\x00", *(re.escape(x["content"]) for x in said.get("added_tokens", []))])
        self.tokenizer = Tokenizer.from_file(path)
        if self.by_unit:
            vocabulary = said["model"]["vocab"]
            self.lengths = np.zeros(max(vocabulary.values()) + 1, "i8")  # each character of a byte-level token stands for a byte
            self.lengths[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.known = Remembered(max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, units: list[str], sizes: np.ndarray) -> list[bytes]:
        """Ids of units that each start with white space and end without: encoded as one text, then cut by the length of the tokens."""
        found: list[bytes] = []
        for i in range(0, len(units), 4096):
            some = units[i : i + 4096]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes[i : i + 4096]), side="left") + 1
            raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
            found += [raw[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        return found

    def _of_units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of these different units start in what is remembered, and how many they are."""
        if self.known.held > CACHE_BYTES:
            self.known.forget()
        first, second = self.known.keys(units.cast(pa.large_binary()).to_pylist())
        known, start, length = self.known.find((first, second))
        new = np.flatnonzero(~known)
        if len(new):
            fresh = units.take(pa.array(new))
            texts, sizes = fresh.to_pylist(), pc.binary_length(fresh).to_numpy()
            inner = np.fromiter((u[:1] in (" ", "\n") and not u[-1].isspace() for u in texts), bool, len(texts))
            found = np.empty(len(texts), object)
            found[inner] = self._joined([texts[k] for k in np.flatnonzero(inner)], sizes[inner])
            found[~inner] = self._whole([texts[k] for k in np.flatnonzero(~inner)])
            length[new] = [len(x) // 4 for x in found]
            start[new] = self.known.add((first[new], second[new]), np.frombuffer(b"".join(found), "<u4"), length[new])
        return start, length

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n")
        odd = pc.match_substring_regex(texts, f"[{_SPACE}][ \\n]")
        if pc.any(odd).as_py():  # only white space after something visible starts a unit
            marked = pc.replace_with_mask(marked, odd, pc.replace_substring_regex(texts.filter(odd), f"([^{_SPACE}])([ \\n])", "\\1\0\\2"))
        parts = pc.split_pattern(marked, "\0")
        at = parts.offsets.to_numpy()
        coded = pc.dictionary_encode(parts.values.slice(at[0], at[-1] - at[0]))
        starts, sizes = self._of_units(coded.dictionary)
        codes = coded.indices.to_numpy()
        each = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(each)])
        shift = starts[codes] - ends[:-1]
        narrow = np.int32 if max(ends[-1], self.known.used) < 2**31 else np.int64
        places = np.repeat(shift.astype(narrow), each)
        places += np.arange(ends[-1], dtype=narrow)
        return self.known.ids[places].astype("<u4", copy=False), ends[at - at[0]]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        uncut = np.ones(len(texts), bool) if not self.by_unit else pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False)
        if not uncut.any():
            return self._cut(texts)
        whole = iter(self._whole(texts.filter(pa.array(uncut)).to_pylist()))
        ids, bounds = self._cut(texts.filter(pa.array(~uncut))) if not uncut.all() else (None, None)
        rest, parts = iter(range(len(texts))), []
        for one in uncut.tolist():
            if one:
                parts.append(np.frombuffer(next(whole), "<u4"))
            else:
                k = next(rest)
                parts.append(ids[bounds[k] : bounds[k + 1]])
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null text has none."""
        texts = strings(texts)
        bytes_before = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])
        start = 0
        while start < len(texts):
            end = max(start + 1, int(np.searchsorted(bytes_before, bytes_before[start] + SLICE_BYTES, side="right")) - 1)
            ids, bounds = self._slice(texts.slice(start, end - start))
            for k in range(end - start):
                yield ids[bounds[k] : bounds[k + 1]]
            start = end


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def drop_encoders() -> None:
    """Forget all encoders of this worker."""
    _encoders.clear()
