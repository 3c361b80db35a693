"""Words of whole texts as numpy arrays: positions, 64-bit hashes, hashes of word runs.

A run's hash is a difference of prefix sums of ``h[i] * Q**i`` modulo 2**64, scaled back by the inverse power; so the
hash of any run costs the same, whatever its length, and equal runs have equal hashes wherever they stand.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_STEP = U(0x9E3779B97F4A7C15)
_BYTE_BASE = 0xD1342543DE82EF95
_WORD_BASE = 0xAF251AF3B0F025B5

#: Space and the control characters tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text worked on at once; arrays of eight bytes per byte of text are made from them.
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP + U(seed))


_BYTES = seeded(256, 7)
_POWERS: dict[int, np.ndarray] = {}
#: Powers that are kept; longer rows of them, for longer texts, are made anew each time.
_KEPT_POWERS = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, some of them kept for the next call."""
    known = _POWERS.get(base)
    if known is None or len(known) <= n:
        known = np.full(max(n + 1, 1 << 16), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if len(known) <= _KEPT_POWERS:
            _POWERS[base] = known
    return known


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=out[1:])
    return out


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


@dataclass
class Words:
    """Words of consecutive documents. ``first[d]`` is the index of document d's first word, ``first[-1]`` the end."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    prefix: np.ndarray
    #: Where the documents begin in ``data``, and its end.
    offsets: np.ndarray

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the word runs [lo, hi)."""
        back = powers(_inverse(_WORD_BASE), len(self.hashes))
        return mix((self.prefix[hi] - self.prefix[lo]) * back[lo])

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all runs of n words, document borders ignored."""
        count = max(0, len(self.hashes) - n + 1)
        back = powers(_inverse(_WORD_BASE), len(self.hashes))
        return mix((self.prefix[n : n + count] - self.prefix[:count]) * back[:count])


def words_of(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> Words:
    """Words of documents whose texts stand in ``data`` at ``offsets``; every text ends in a blank."""
    solid = ~blank[data]
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    if len(solid) and solid[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    sums = _prefix(_BYTES[data], _BYTE_BASE)
    back = powers(_inverse(_BYTE_BASE), len(data))
    hashes = mix((sums[ends] - sums[starts]) * back[starts])
    return Words(data, starts, ends, np.searchsorted(starts, offsets), hashes, _prefix(hashes, _WORD_BASE), offsets)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a column of texts: first and last row, their bytes (each text followed by a line feed), their offsets.

    A slice holds at most ``limit`` bytes unless one text alone is longer. A null counts as an empty text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lengths = pc.binary_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    totals = np.concatenate(([0], np.cumsum(lengths)))
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(totals, totals[lo] + limit, "right")) - 1)
        part = pc.binary_join_element_wise(pc.fill_null(texts.slice(lo, hi - lo), "").cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
        data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + hi - lo + 1]
        yield lo, hi, data[at[0] : at[-1]], at - at[0]
        lo = hi
    release()


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after its task, and would keep what it once used."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim is not None:
            trim(0)


def word_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, offsets in chunks(texts, limit):
        yield lo, hi, words_of(data, offsets)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - reach :]) if reach < width else out


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths laid out one after another: the group of every item, and its place in the group."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    start = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - start[owner]
