"""Words of Arrow text columns as 64-bit hashes, in numpy over whole buffers.

The texts of a batch are handled in slices of whole documents of about
``SLICE`` bytes (one long document may be larger), so the arrays stay small. A
byte b contributes T[b] * P**i (mod 2**64) with a fixed random table T and an odd
P; differences of the running sum, divided by P**start, give the hash of any byte
range wherever it stands, and a finalizer mixes the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64
P = U(0x9E3779B97F4A7C15)
P_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
# all ASCII but digits and letters
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = True
NON_ALNUM[48:58] = NON_ALNUM[65:91] = NON_ALNUM[97:123] = False


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class Powers:
    """Powers of P and of its inverse, grown as needed."""

    def __init__(self):
        self.n = 0
        self.grow(SLICE + 1)

    def grow(self, n: int) -> None:
        if n > self.n:
            self.n = n
            self.up, self.down = powers(P, n), powers(P_INV, n)

    def drop_to(self, n: int) -> None:
        """Gives the memory of one very long document back."""
        if self.n > 4 * n:
            self.n = 0
            self.grow(n)


_POWERS: Powers | None = None


def _shared_powers(n: int) -> Powers:
    global _POWERS
    if _POWERS is None:
        _POWERS = Powers()
    _POWERS.grow(n)
    return _POWERS


def finalize(h: np.ndarray) -> np.ndarray:
    """Mixes the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums S of a byte array, S[0] = 0, for ``range_hash``."""
    p = _shared_powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(TABLE[data] * p.up[:len(data)], out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end), the same wherever they stand."""
    p = _shared_powers(len(sums))
    return finalize((sums[end] - sums[start]) * p.down[start])


@dataclass
class Slice:
    """Documents [first, first + n) of a batch, their bytes and bounds in them."""

    first: int
    data: np.ndarray
    bounds: np.ndarray  # n + 1 offsets


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    """The texts of a column without nulls, some whole documents at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    buf = texts.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1, i + 1)
        yield Slice(i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        if _POWERS is not None:
            _POWERS.drop_to(SLICE + 1)
        i = j


def word_bounds(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words each document has. Words
    end at separators and at document bounds."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separators[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if len(cuts):  # a document that begins inside a run of word bytes splits it
        cuts = np.unique(cuts)
        split = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
        if len(split):
            starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    n_words = np.diff(np.searchsorted(starts, bounds))
    return starts, ends, n_words


def hashed_words(s: Slice, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, words per document, starts, ends) of the lower-cased words of a slice."""
    low = LOWER[s.data]
    starts, ends, n_words = word_bounds(low, s.bounds, separators)
    return range_hash(prefix_sums(low), starts, ends), n_words, starts, ends


def windows(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` consecutive words from each position on (by Horner's
    rule); the last ``size`` - 1 positions have none."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = word_hash[:n].copy()
    for k in range(1, size):
        h *= P
        h += word_hash[k:k + n]
    return finalize(h)
