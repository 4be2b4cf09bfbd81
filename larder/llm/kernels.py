"""NumPy kernels over UTF-8 buffers, shared by the text operators.

Everything works on whole texts.  A batch is cut into chunks of a few MB, so
memory is bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = (1 << 20) - 1  # tables of powers then have 2**20 entries

_MUL = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


caches: list[dict] = []  # what Python workers keep between tasks of one kind


def fresh() -> None:
    """To be called where tasks of other kinds begin: gives the caches' memory back."""
    if any(caches):
        for c in caches:
            c.clear()
        trim()


def trim() -> None:
    """Gives freed memory back to the system at a task's end (where the C library can): Python workers live on."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b & _MASK, dtype=U64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(_MUL), _Powers(0xD6E8FEB86659FD93 | 1)
_LETTER = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F))

SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = True
ALNUM_WORD[0x61:0x7B] = True
ALNUM_WORD[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def string_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, n + 1 offsets and a null mask of a string column, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    nulls = np.asarray(column.is_null()) if column.null_count else np.zeros(n, dtype=bool)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets, nulls


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes each; at least one row each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


class Words:
    """Words of the texts in rows lo..hi of a column.

    start, end: byte positions within `data`; doc: row number from 0 for `lo`;
    first: n_rows + 1 offsets into the words; hash: 64-bit hashes of the words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, table: np.ndarray, lower: bool, hashes: bool = True):
        base = int(offsets[lo])
        raw = data[base : int(offsets[hi])]
        self.data = LOWER[raw] if lower else raw
        n, rows = len(raw), hi - lo
        edge = (offsets[lo : hi + 1] - base).astype(np.int64)
        word = table[self.data]
        prev = np.zeros(n + 1, dtype=bool)
        prev[1:] = word
        cut = np.zeros(n + 1, dtype=bool)
        cut[edge] = True
        follows = prev & ~cut  # the byte before is a word byte of the same text
        self.start = np.flatnonzero(word & ~follows[:n])
        stops = prev.copy()
        stops[:n] &= ~word | cut[:n]
        self.end = np.flatnonzero(stops)
        self.first = np.searchsorted(self.start, edge)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(rows), self.n)
        if hashes:
            up, down = _BYTES.get(n + 1)
            total = np.zeros(n + 1, dtype=U64)
            np.cumsum(_LETTER[self.data] * up[:n], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def grams(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and which of them lie within one text.

    Both have one entry for each word position (the last k - 1 are invalid).
    """
    n = len(words.hash)
    if n < k:
        return np.zeros(n, dtype=U64), np.zeros(n, dtype=bool)
    up, down = _WORDS.get(n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(words.hash * up[:n], out=total[1:])
    h = np.zeros(n, dtype=U64)
    h[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1] + U64(k))
    ok = np.zeros(n, dtype=bool)
    ok[: n - k + 1] = words.doc[: n - k + 1] == words.doc[k - 1 :]
    return h, ok


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, in three passes (van Herk's block method)."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]) if pad else x
    blocks = y.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])
