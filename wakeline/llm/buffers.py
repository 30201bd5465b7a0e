"""Vectorised helpers over the UTF-8 buffers of Arrow string columns.

An Arrow string column is one contiguous byte buffer with row offsets. Tasks work on that
buffer in slices of a quarter of a megabyte with numpy, so memory stays bounded whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18  # of text; tasks hold some twenty arrays of eight times that
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


BYTE_HASH = mixed(np.arange(256, dtype=np.uint64))
_BASE = U(0x9FB21C651E98DF25)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 4096), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of its rows and end) with about limit bytes each; null is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def byte_class(pattern: bytes | range) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(pattern)] = True
    return table


#: ASCII upper case to lower case, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between ASCII white space.
NOT_SPACE = ~byte_class(b" \t\n\v\f\r")
#: Bytes of lower-cased words of letters, digits and everything beyond ASCII.
ALNUM = byte_class(b"0123456789abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)


class Words:
    """Maximal runs of word bytes within rows.

    start, end: byte positions of each word; first: index of each row's first word (and the
    end); counts: words by row; row: the row of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        w = table[data]
        edge = np.empty(len(w) + 1, bool)
        edge[0], edge[-1] = (w[0], w[-1]) if len(w) else (False, False)
        np.not_equal(w[1:], w[:-1], out=edge[1:-1]) if len(w) > 1 else None
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(w))]
        cut = np.unique(cut[w[cut] & w[cut - 1]]) if len(cut) else cut
        marks = np.flatnonzero(edge)
        if len(cut):  # a row's end between two word bytes ends one word and begins another
            marks = np.sort(np.concatenate([marks, cut, cut]))
        self.mask, self.start, self.end = w, marks[0::2], marks[1::2]
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.data = data

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes without what is between them, and each word's offset in them."""
        lens = self.end - self.start
        return self.data[self.mask], np.concatenate([[0], np.cumsum(lens)])

    def hashes(self) -> np.ndarray:
        data, offsets = self.compact()
        return hash_runs(data, offsets)


def hash_runs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[offsets[i]:offsets[i + 1]]; an empty run has the hash of its length."""
    lens = np.diff(offsets)
    if not len(lens):
        return np.zeros(0, np.uint64)
    out = lens.astype(np.uint64)
    full = np.flatnonzero(lens)
    if len(full):
        at = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], lens)
        values = BYTE_HASH[data[offsets[0] : offsets[-1]]] * powers(int(lens.max()))[at]
        out[full] += np.add.reduceat(values, (offsets[:-1] - offsets[0])[full]) * U(0xD6E8FEB86659FD93)
    return mixed(out)


def window_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words: entry i is of words i to i + n - 1, rows ignored."""
    m = len(word_hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for j in range(n):
        out = out * U(0xA0761D6478BD642F) + word_hashes[j : j + m]
    return mixed(out)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after another."""
    total = int(lens.sum())
    at = np.arange(total)
    return at + np.repeat(starts - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) if total else at


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]
