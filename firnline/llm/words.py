"""Words of Arrow text columns as 64-bit hashes, by whole-buffer numpy operations.

A word's hash is a mixed sum of values that look random, one for each byte at its place, so that no
family of words (long or periodic ones, say) is sure to collide.

Nothing here loops over characters or words in Python. A text column is taken in
blocks of whole texts of about ``BLOCK`` bytes, so that temporary arrays stay small;
one longer text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random value for each byte; A-Z have those of a-z.
_BYTE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_BYTE[65:91] = _BYTE[97:123]

#: Bytes of words that are separated by ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

@dataclass
class Words:
    """Words of the texts [first, first + texts) of a column, in order."""

    first: int
    texts: int
    hash: np.ndarray  # uint64, one for each word
    bounds: np.ndarray  # text i has the words [bounds[i], bounds[i + 1])
    ending: np.ndarray  # uint64, a hash of each word's last three bytes
    start: np.ndarray  # each word's place in the column's bytes, as ``buffers`` gives them
    length: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hash[self.bounds[i] : self.bounds[i + 1]]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_utf8())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), bounds


def blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK bytes."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(texts: pa.Array, kind: np.ndarray) -> Iterator[Words]:
    """Lower-cased (A-Z) words, where ``kind`` tells the bytes that belong to words."""
    data, bounds = buffers(texts)
    for i, j in blocks(bounds):
        at = bounds[i : j + 1] - bounds[i]
        body = data[bounds[i] : bounds[j]]
        inside = np.zeros(len(body) + 1, bool)
        inside[:-1] = kind[body]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = at[:-1][at[:-1] < len(body)]
        begins[cut] = inside[cut]
        starts = np.flatnonzero(begins)
        if not len(starts):
            yield Words(i, j - i, np.zeros(0, _U), np.zeros(j - i + 1, np.int64), np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
            continue
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        lengths = np.flatnonzero(ends) + 1 - starts
        final = starts + lengths - 1
        ending = _BYTE[body[final]]
        for back in (1, 2):
            ending = ending * _BASE + np.where(lengths > back, _BYTE[body[np.maximum(final - back, 0)]], _U(0))
        place = np.arange(len(body)) - _since(starts, len(body))
        values = mix(_BYTE[body] + place.view(_U) * _BASE)  # a value of its own for each byte at each place
        values[~inside[:-1]] = 0
        hashes = mix(np.add.reduceat(values, starts) + lengths.astype(_U) * _BASE)
        yield Words(i, j - i, hashes, np.searchsorted(starts, at), mix(ending), starts + bounds[i], lengths)


def _since(starts: np.ndarray, n: int) -> np.ndarray:
    """For each place the last start at or before it (the first start before that)."""
    out = np.zeros(n, np.int64)
    out[starts[0]] = starts[0]
    out[starts[1:]] = np.diff(starts)
    np.cumsum(out, out=out)
    out[: starts[0]] = np.arange(starts[0])
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[i : i + n]
    return mix(out + _U(k))


def shingles(w: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its row and its sorted, distinct ``k``-word shingles; a text of fewer words has one, of all of them."""
    runs = grams(w.hash, k)
    for i, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        if b - a >= k:
            yield w.first + i, np.unique(runs[a : b - k + 1])
        else:
            yield w.first + i, grams(w.hash[a:b], b - a) if b > a else np.zeros(0, _U)
