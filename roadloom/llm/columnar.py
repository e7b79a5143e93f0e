"""Texts as numpy arrays: the bytes of a block of texts, their words, word hashes and rolling hashes of word runs.

Blocks hold about ``BLOCK_BYTES``; one text is never split, so a text beyond that is a block of its own. Arrays of
eight bytes a text byte are made for ``SLICE`` bytes at a time only, whatever the text: a block takes some ten bytes
a byte of text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time, so that a task's memory doesn't follow its batch.
BLOCK_BYTES = 1_000_000
#: Bytes whose polynomials are computed at a time.
SLICE = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)


def _table(low: str) -> np.ndarray:
    out = np.ones(256, bool)
    out[[ord(c) for c in low]] = False
    return out


#: Bytes of words between ASCII white space, and of words of letters and digits (all of other scripts).
SPACED = _table(" \t\n\x0b\x0c\r")
ALNUM = _table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes; nulls are empty. One text is never split."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of a block of texts: ``starts`` and ``ends`` in ``data``, and ``doc``, the row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, lower: bool = True):
        self.data = LOWER[data] if lower else data
        self.n = len(offsets) - 1
        self.flag = flag = table[self.data]
        begin = flag.copy()
        begin[1:] &= ~flag[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        begin[first] = flag[first]
        end = flag.copy()
        end[:-1] &= ~flag[1:]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        end[last] = flag[last]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # words of row k: bounds[k] to bounds[k + 1]
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.n), self.counts)

    def cut_long(self, longest: int, overlap: int) -> None:
        """Cut words of over ``longest`` bytes into pieces of that size that share ``overlap`` bytes, words of their own."""
        size = self.ends - self.starts
        if not (size > longest).any():
            return
        each = np.where(size > longest, -(-(size - overlap) // (longest - overlap)), 1)
        word = np.repeat(np.arange(len(size)), each)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(each) - each, each)
        self.starts = self.starts[word] + nth * (longest - overlap)
        self.ends, self.doc = np.minimum(self.starts + longest, self.ends[word]), self.doc[word]
        self.counts = np.bincount(self.doc, minlength=self.n)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: a polynomial from prefix sums, then mixed."""
        value = np.zeros(len(self.starts), np.uint64)
        at = 0
        while at < len(value):
            low = int(self.starts[at])
            to = int(np.searchsorted(self.ends, low + SLICE, "right"))
            if to > at:
                value[at:to] = _polynomials(self.data[low : int(self.ends[to - 1])], self.starts[at:to] - low, self.ends[at:to] - low)
            else:  # one word longer than a slice
                to, width = at + 1, np.array([SLICE])
                with np.errstate(over="ignore"):
                    for k, a in enumerate(range(low, int(self.ends[at]), SLICE)):
                        part = self.data[a : min(a + SLICE, int(self.ends[at]))]
                        shift = np.uint64(pow(int(_BASE), k * SLICE, 1 << 64))
                        value[at] += _polynomials(part, width - SLICE, np.array([len(part)]))[0] * shift
            at = to
        return mix(value)

    def runs(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words within a text, and the number of each run's first word."""
        if len(hashes) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(hashes) - k + 1
        with np.errstate(over="ignore"):
            out = np.zeros(m, np.uint64)
            for i in range(k):
                out = out * _BASE + hashes[i : i + m]
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        return mix(out[at]), at


def _powers(base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        factors = np.full(SLICE + 1, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors)


_UP, _DOWN = _powers(int(_BASE)), _powers(pow(int(_BASE), -1, 1 << 64))


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial of each of some words in at most ``SLICE`` bytes; it doesn't depend on where a word stands."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=total[1:])
        return (total[ends] - total[starts]) * _DOWN[starts]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _SPREAD
        x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))
