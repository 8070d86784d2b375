"""Vectorised kernels on the UTF-8 bytes of text batches, shared by the numpy operators.

A batch arrives as an Arrow string array. It is cut into groups of whole documents of about
GROUP_BYTES, so memory is bounded by that and by the longest single document.
All hashes are 64-bit polynomial sums over fixed random byte values, finished with a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_P = 0xD6E8FEB86659FD93 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x + _GOLD
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Everything that is neither an ASCII letter or digit nor part of a longer UTF-8 character.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
RAW = mix(np.arange(256, dtype=_U) + _U(1))
_low = np.arange(256)
_low[65:91] += 32
#: As RAW, with A-Z as a-z.
FOLD = RAW[_low]

_pow = np.ones(1, _U)
_inv = np.ones(1, _U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i below n at least."""
    global _pow, _inv
    if len(_pow) < n:
        m = -(-n // 65536) * 65536
        for name, base in (("_pow", _P), ("_inv", pow(_P, -1, 1 << 64))):
            a = np.full(m, base, _U)
            a[0] = 1
            globals()[name] = np.cumprod(a)
    return _pow, _inv


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * P**i, from which span() takes the hash of any span."""
    out = np.zeros(len(values) + 1, _U)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans, whatever their place."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


class Group:
    """The bytes of some whole documents; bounds[i] to bounds[i+1] is the i-th."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int):
        self.data, self.bounds, self.first, self.n = data, bounds, first, len(bounds) - 1
        self.empty = len(data) == 0

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def words(self, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that are no separators."""
        if self.empty:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = ~separators[self.data]
        first = m.copy()
        first[1:] &= ~m[:-1]
        last = m.copy()
        last[:-1] &= ~m[1:]
        inner = self.bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(m))]
        first[inner] = m[inner]
        last[inner - 1] = m[inner - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and documents of the lines split at newline; an empty text is one empty line."""
        nl = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], nl + 1]), kind="stable")
        doc = np.sort(np.concatenate([np.arange(self.n), self.doc_of(nl)]), kind="stable")
        ends = np.append(starts[1:] - 1, len(self.data))
        lasts = np.append(doc[1:] != doc[:-1], True)
        ends[lasts] = self.bounds[doc[lasts] + 1]
        return starts, ends, doc

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes flagged each document has."""
        c = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=c[1:])
        return c[self.bounds[1:]] - c[self.bounds[:-1]]


def groups(texts: pa.Array, limit: int = GROUP_BYTES) -> Iterator[Group]:
    """Groups of whole documents in order; null texts count as empty."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return
    _, off, data = arr.buffers()
    bounds = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        hi = min(hi, lo + 4096, len(arr))
        yield Group(raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], lo)
        lo = hi


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words inside a document, and the index of each run's first word."""
    if len(hashes) < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    sums = prefix(hashes)
    return span(sums, at, at + k), at


def keyed(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that also tell the document."""
    return mix(hashes + doc.astype(_U) * _U(0xA24BAED4963EE407))
