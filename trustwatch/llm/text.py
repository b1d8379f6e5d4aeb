"""Words of Arrow string columns as 64-bit hashes, found with array operations over the UTF-8 bytes.

No Python object is made per word. A word's hash is a polynomial in random byte values modulo 2**64, finished by a mixer; two
different words collide with probability about 2**-64. Temporary arrays are bounded: texts are read in slices, and a text longer
than a slice in blocks that end at a separator.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


SPACE = _lut(" \t\n\v\f\r")
"""Bytes outside words ``[^\\x20\\x09-\\x0D]+``."""
_b = np.arange(256)
NOT_ALNUM = (_b < 128) & ~(((_b >= 48) & (_b < 58)) | ((_b >= 97) & (_b < 123)) | ((_b >= 65) & (_b < 91)))
"""Bytes outside words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts whose A-Z are lower-cased."""
NEWLINE = _lut("\n")
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95)) | U(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = np.full(n, _P, np.uint64), np.full(n, _PINV, np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)


@dataclass
class Words:
    """Words of several texts: hashes, byte starts and ends, and for row r the words ptr[r]:ptr[r + 1]."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def hash_words(buf: np.ndarray, offs: np.ndarray, separators: np.ndarray, fold: np.ndarray) -> Words:
    """Words of the texts buf[offs[r]:offs[r + 1]]; none reaches over the end of its text."""
    inside = ~separators[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), np.uint64)
    values = _BYTE[fold]
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(i + 1, int(np.searchsorted(end, lo + BLOCK, "right")))
        hi = end[j - 1]
        p, q = _powers(BLOCK) if hi - lo <= BLOCK else _powers(int(hi - lo))
        c = np.empty(hi - lo + 1, np.uint64)
        c[0] = 0
        np.cumsum(values[buf[lo:hi]] * p[:hi - lo], out=c[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((c[e] - c[s]) * q[s] + (e - s).astype(np.uint64))
        i = j
    return Words(out, start, end, np.searchsorted(start, offs).astype(np.int64))


def slices(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets in them) of runs of rows with about ``limit`` bytes; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, whole[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = mix(h * U(0x9FB21C651E98DF25) + words[i:i + n])
    return h


def whole_sequence(words: np.ndarray) -> int:
    h = len(words)
    for w in words.tolist():
        h = int(mix(np.array([(h * 0x9FB21C651E98DF25 + w) & (2**64 - 1)], np.uint64))[0])
    return h


def row_counts(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """True values of ``mask`` in each offs[r]:offs[r + 1]."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]
