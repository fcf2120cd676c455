"""Words, lines and shingles of whole texts as numpy arrays.

A batch of texts is one byte array with text bounds.  A word is a run of bytes
outside ``[\\x20\\x09-\\x0D]``; UTF-8 never uses those bytes inside a character.
Strings are hashed to 64 bits by a polynomial over random byte values (prefix
sums give any substring's hash) and a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled whole, by itself.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)
    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


class Texts:
    """Some texts: ``data`` bytes and ``bounds`` (text i is data[bounds[i]:bounds[i+1]])."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, fold: bool = False,
                 gaps: np.ndarray = _SPACE):
        self.data, self.bounds, self.count = data, bounds, len(bounds) - 1
        size = len(data)
        need = 1 << max(16, int(size + 1).bit_length())
        powers, self._inverse = _powers(need)
        self._sums = np.zeros(size + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[data] * powers[:size], out=self._sums[1:])
        self._edge = np.zeros(size + 1, bool)
        self._edge[bounds] = True
        word = ~gaps[data]
        self.is_word = word
        gap = ~word
        before, after = np.ones(size, bool), np.ones(size, bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        self.word_start = np.flatnonzero(word & (before | self._edge[:-1]))
        self.word_end = np.flatnonzero(word & (after | self._edge[1:])) + 1
        self.word_text = self.text_of(self.word_start)

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, position, side="right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(sums + (end - start).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.word_start, self.word_end)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of the lines that \\n makes; an empty text has none."""
        at = np.flatnonzero(self.data == 0x0A)
        full = self.bounds[:-1] < self.bounds[1:]
        start = np.sort(np.concatenate([self.bounds[:-1][full], at + 1]))
        end = np.sort(np.concatenate([self.bounds[1:][full], at]))
        text = self.text_of(end - (start < end))
        return start, end, text

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, first word) of all runs of ``size`` words.

        A text with fewer words has its whole sequence as its only shingle.
        """
        words, text = self.word_hashes(), self.word_text
        n = len(words)
        fewer = np.bincount(text, minlength=self.count) < size
        first = np.ones(n, bool)
        first[1:] = text[1:] != text[:-1]
        value = mix(words + np.uint64(1))
        at = np.arange(n)
        out, left = [], first & fewer[text]
        for k in range(1, size):
            ends = left.copy()  # short texts whose sequence has k words
            ends[:n - k] &= text[k:] != text[:n - k]
            out.append((value[ends[:len(value)]], at[ends]))
            keep = text[k:] == text[:n - k]
            longer = np.zeros(n, np.uint64)
            longer[:n - k] = mix(value[:n - k] * np.uint64(_BASE) + words[k:])
            value = longer
            inside = np.zeros(n, bool)
            inside[:n - k] = keep
            left &= inside
        whole = np.zeros(n, bool)
        if n >= size:
            whole[:n - size + 1] = text[size - 1:] == text[:n - size + 1]
        out.append((value[whole], at[whole]))
        hashes = np.concatenate([h for h, _ in out])
        where = np.concatenate([a for _, a in out])
        return hashes, text[where], where


def slices(column: pa.Array, fold: bool = False, gaps: np.ndarray = _SPACE,
           size: int = SLICE_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, Texts) over a string column; null is empty.

    ``gaps`` flags the bytes between words; ``size`` is the bytes of a slice.
    """
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    if not len(column):
        return
    data = (np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None
            else np.zeros(0, np.uint8))
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        yield row, Texts(data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row],
                         fold, gaps)
        row = last
