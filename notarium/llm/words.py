"""Words, hashes and windows of whole text columns as numpy arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D; these bytes never occur inside a
UTF-8 sequence, so working on bytes gives the same words as working on characters.  A
missing text counts as an empty one.  Words and windows never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Finalizer constants of the public MurmurHash3.
_MIX_1, _MIX_2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_BASE = U64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> U64(33))) * _MIX_1
    h = (h ^ (h >> U64(33))) * _MIX_2
    return h ^ (h >> U64(33))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    steps = np.full(max(n, 1), base, U64)
    steps[0] = 1
    return np.cumprod(steps)


_POWERS = powers(256)


@dataclass
class Texts:
    """UTF-8 bytes of several documents and where each begins (one more offset than documents)."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        """A-Z to a-z; other letters stay."""
        return Texts(_LOWER[self.data], self.offsets)

    def part(self, begin: int, end: int) -> Texts:
        a, b = self.offsets[begin], self.offsets[end]
        return Texts(self.data[a:b], self.offsets[begin:end + 1] - a)


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(whole[offsets[0]:offsets[-1]], offsets - offsets[0])


def slices(texts: Texts, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together; a longer document is a range of its own."""
    begin, n = 0, len(texts)
    while begin < n:
        end = int(np.searchsorted(texts.offsets, texts.offsets[begin] + size, side="right")) - 1
        end = min(max(end, begin + 1), n)
        yield begin, end
        begin = end


@dataclass
class Words:
    """Byte spans of the words of several documents, and the first word of each document."""

    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    def place(self) -> np.ndarray:
        """Each word's position in its document."""
        return np.arange(len(self.starts)) - np.repeat(self.firsts[:-1], self.counts())

    def after(self) -> np.ndarray:
        """For each word, the number of words from it to its document's end, itself included."""
        return np.repeat(self.firsts[1:], self.counts()) - np.arange(len(self.starts))


def find_words(texts: Texts) -> Words:
    inside = ~_BLANK[texts.data]
    edge = np.zeros(len(inside) + 1, bool)
    edge[texts.offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(opens)
    return Words(starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, texts.offsets))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """64-bit hashes of byte spans that don't overlap and aren't empty; ``block`` bytes are unfolded at a time."""
    global _POWERS
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    longest = int(lengths.max())
    if longest > len(_POWERS):
        _POWERS = powers(max(longest, 2 * len(_POWERS)))
    total = np.cumsum(lengths)
    out, at = np.empty(len(starts), U64), 0
    while at < len(starts):
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + block, side="right")))
        part = lengths[at:to]
        begins = total[at:to] - part - before
        within = np.arange(int(total[to - 1]) - before) - np.repeat(begins, part)
        values = _BYTE_VALUES[data[within + np.repeat(starts[at:to], part)]] * _POWERS[within]
        out[at:to] = np.add.reduceat(values, begins)
        at = to
    return mix(out + lengths.astype(U64) * _MIX_1)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values, by doubling; runs past the end hold rubbish."""
    def joined(a: np.ndarray, b: np.ndarray, len_a: int, len_b: int) -> np.ndarray:
        out = a * U64(pow(int(_BASE), len_b, 1 << 64))
        out[:len(out) - len_a] += b[len_a:]
        return out

    done, have, step, size, left = None, 0, values, 1, width
    while left:
        if left & 1:
            done, have = (step, size) if done is None else (joined(done, step, have, size), have + size)
        left >>= 1
        if left:
            step, size = joined(step, step, size, size), 2 * size
    return mix(done)


def byte_values(data: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte value, to be hashed by ``rolling``."""
    return _BYTE_VALUES[data]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of several runs, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """An Arrow list column over flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def hex_digests(parts: list[bytes]) -> list[str]:
    import hashlib

    return [hashlib.sha256(p).hexdigest() for p in parts]
