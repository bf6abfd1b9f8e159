"""Vectorised word splitting and hashing over Arrow string buffers.

A word is ``[^\\x20\\x09-\\x0D]+`` in the UTF-8 bytes, i.e. what ``bytes.split()`` gives.  Texts are
taken straight from the Arrow buffers, several documents at a time, so no Python string is made per
word.  A word's hash is a polynomial over a table of random 64-bit byte values (prefix sums modulo
2**64, then a finaliser); a window's hash is a polynomial over its word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` reproducible random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    t = stream(seed, 256)
    if lower:
        t[65:91] = t[97:123]
    return t


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BASE = 0x5851F42D4C957F2D
BASE_INV = pow(BASE, -1, 1 << 64)


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays([c.cast(pa.large_binary()) for c in col.chunks]) if col.num_chunks else \
            pa.array([], pa.large_binary())
    else:
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def doc_chunks(off: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``limit`` bytes (a longer document is a run of its own)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every word (``space``: the bytes that separate words)."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~space[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edge = off[(off > 0) & (off < n)]
    first[edge] = word[edge]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


class WordHasher:
    """Hash byte ranges of a buffer in a few vector operations."""

    def __init__(self, seed: int = 11, lower: bool = False):
        self.table, self.pow, self.inv = byte_table(seed, lower), np.ones(1, U64), np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            for name, base in (("pow", BASE), ("inv", BASE_INV)):
                a = np.full(n, base, U64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=U64))

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        self._grow(len(buf) + 1)
        c = np.empty(len(buf) + 1, U64)
        c[0] = 0
        np.cumsum(self.table[buf] * self.pow[:len(buf)], out=c[1:], dtype=U64)
        return c

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.inv[starts] + (ends - starts).astype(U64))


def window_hashes(h: np.ndarray, length: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of every run of ``length`` consecutive word hashes."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    acc, b = np.zeros(n, U64), U64(base)
    for k in range(length):
        acc = acc * b + h[k:k + n]
    return mix(acc)


def all_words(col, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document index of every word of an Arrow text column, in order (chunk by chunk)."""
    buf, off = text_buffer(col)
    hashes, docs = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for lo, hi in doc_chunks(off):
        part, rel = buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        starts, ends, doc = word_spans(part, rel)
        hashes.append(hasher.spans(hasher.prefix(part), starts, ends))
        docs.append(doc + lo)
    return np.concatenate(hashes), np.concatenate(docs)


def in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of ``x`` in a sorted array."""
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x
