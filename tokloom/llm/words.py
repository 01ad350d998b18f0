"""Vectorized text primitives over Arrow batches: bytes, words and n-grams of many documents at a time.

A word is a run of ASCII letters, digits and bytes from 0x80 on; an ideograph or kana (lead bytes E3 to E9) is a
word of its own. ASCII and Latin-1 letters are folded to lower case. Words and n-grams are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer document is one chunk by itself, which operators read in strips.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 2**64))):
            steps = np.full(1 << int(n - 1).bit_length(), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets into them) of a string or binary array; nulls are empty."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, at, data = arr.buffers()
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches in runs of whole rows of about CHUNK bytes of the column: (rows, bytes, offsets)."""
    for batch in batches:
        raw, at = string_buffers(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, "right")) - 1)
            yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


@dataclass
class Words:
    """hash, start and end (bytes) of each word; words of document d are those from at[d] to at[d + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def fold(raw: np.ndarray) -> np.ndarray:
    low = _FOLD[raw]
    if len(raw) > 1:
        upper = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][upper] += 0x20
    return low


def words(raw: np.ndarray, offsets: np.ndarray, low: np.ndarray | None = None) -> Words:
    n = len(raw)
    if not n:
        return Words(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(2)), np.zeros(len(offsets), np.int64))
    inside = _WORD[raw]
    edge = np.ones(n + 1, bool)  # no word goes over it
    edge[1:n] = ~(inside[1:] & inside[:-1])
    lead = np.flatnonzero((raw >= 0xE3) & (raw <= 0xE9))
    edge[lead] = True
    edge[np.minimum(lead + 3, n)] = True
    edge[offsets] = True
    start = np.flatnonzero(edge[:-1] & inside)
    end = np.flatnonzero(edge[1:] & inside) + 1
    return Words(run_hashes(fold(raw) if low is None else low, start, end), start, end, np.searchsorted(start, offsets))


def run_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each of some runs that are in order and share no byte."""
    n, value = len(low), np.zeros(len(start), np.uint64)
    for a in range(0, n, CHUNK):  # powers of the place are needed up to CHUNK only; a word that goes over a border is summed in parts
        b = min(a + CHUNK, n)
        p, inverse = powers(b - a)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[low[a:b]] * p, out=total[1:])
        first, last = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b))
        if first < last:
            s = np.maximum(start[first:last], a) - a
            part = (total[np.minimum(end[first:last], b) - a] - total[s]) * inverse[s]
            if start[first] < a:
                part[:1] *= np.array([pow(_P, int(a - start[first]), 2**64)], np.uint64)
            value[first:last] += part
    return mix(value)


def strips(raw: np.ndarray, shared: int) -> Iterator[tuple[int, int, Words]]:
    """One text in parts of about CHUNK bytes and whole words: (first byte, end, words). Each part but the first begins with the last ``shared`` words of the one before."""
    n, a, done = len(raw), 0, 0
    while True:
        b = min(done + CHUNK, n)
        while b < n:  # to a byte of no word, or the first of an ideograph
            x = raw[b : b + CHUNK]
            ends = np.flatnonzero(~_WORD[x] | ((x >= 0xE3) & (x <= 0xE9)))
            b += int(ends[0]) if len(ends) else len(x)
            if len(ends):
                break
        w = words(raw[a:b], np.array([0, b - a]))
        yield a, b, w
        if b >= n:
            return
        done, keep = b, min(shared, len(w.start))
        a = a + int(w.start[len(w.start) - keep]) if keep else b


def ngrams(w: Words, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, index of the first word, n-grams before each document) of the word n-grams of each document.

    With ``short``, a document of fewer than n words but at least one has a single gram of all its words.
    """
    size = np.diff(w.at)
    room = np.repeat(w.at[1:], size) - np.arange(len(w.hash))  # words from here to the document's end
    ok = room >= n
    if short:
        ok[w.at[:-1][(size > 0) & (size < n)]] = True
    first = np.flatnonzero(ok)
    value = np.zeros(len(first), np.uint64)
    for k in range(n):
        here = w.hash[np.minimum(first + k, max(0, len(w.hash) - 1))] * _STEP[k]
        value += here if not short else np.where(room[first] > k, here, np.uint64(0))
    return mix(value), first, np.searchsorted(first, w.at)


class Finder:
    """Membership of many hashes in a small sorted set, by a bit table first."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = max(12, int(len(known)).bit_length() + 5)
        self.table = np.zeros(1 << self.bits, bool)
        self.table[known >> np.uint64(64 - self.bits)] = True

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x, index in known) of the members."""
        at = np.flatnonzero(self.table[x >> np.uint64(64 - self.bits)])
        if not len(self.known):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.known, x[at]), len(self.known) - 1)
        ok = self.known[i] == x[at]
        return at[ok], i[ok]
