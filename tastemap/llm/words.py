"""Words and word shingles of Arrow text batches as NumPy arrays, with bounded memory."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 2_000_000

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII bytes that are neither letters nor digits.
_MARK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.cumprod(out, dtype=_U)


@dataclass
class Run:
    """The words of some consecutive texts: byte places in ``data``, hash, and text index."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes: a polynomial read off prefix sums, then scrambled."""
        n = len(self.data)
        total = np.zeros(n + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * powers(_BASE, n), out=total[1:])
        back = powers(_BASE_INVERSE, n + 1)
        return mix((total[self.end] - total[self.start]) * back[self.start])

    def trimmed(self) -> None:
        """Takes ASCII punctuation off both ends of every word; words of nothing else go."""
        n = len(self.data)
        if not n:
            return
        mark, at = _MARK[self.data], np.arange(n)
        # For each byte the first one from there on, and the last one up to there, that is no mark.
        after = np.minimum.accumulate(np.where(mark, n, at)[::-1])[::-1]
        before = np.maximum.accumulate(np.where(mark, -1, at))
        start, end = after[self.start], before[self.end - 1] + 1
        some = start < end
        self.start, self.end, self.text = start[some], end[some], self.text[some]

    def shingles(self, word_hash: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each ``size``-word shingle and the index of its first word."""
        n = len(word_hash) - size + 1
        if n <= 0:
            return np.empty(0, _U), np.empty(0, np.int64)
        first = np.flatnonzero(self.text[:n] == self.text[size - 1:])
        total = np.zeros(len(first), _U)
        for k in range(size):
            total = total * _U(0xD6E8FEB86659FD93) + word_hash[first + k]
        return mix(total), first


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def spans(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes, or one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def class_of(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes are in one of ``ranges``, ends included."""
    byte = np.arange(256)
    return np.logical_or.reduce([(a <= byte) & (byte <= b) for a, b in ranges])


def runs(column: pa.Array, lower: bool = False, gap: np.ndarray = _GAP) -> Iterator[Run]:
    """The column's texts in order, with A-Z lower-cased if asked for; ``gap`` are the bytes between words."""
    data, offsets = buffers(column)
    for i, j in spans(offsets):
        part = LOWER[data[offsets[i]:offsets[j]]] if lower else data[offsets[i]:offsets[j]]
        at = offsets[i:j + 1] - offsets[i]
        word = ~gap[part]
        before, after = np.ones(len(part), bool), np.ones(len(part), bool)
        before[1:] = ~word[:-1]
        after[:-1] = ~word[1:]
        inner = at[(at > 0) & (at < len(part))]
        before[inner] = True
        after[inner - 1] = True
        start = np.flatnonzero(word & before)
        end = np.flatnonzero(word & after) + 1
        yield Run(i, part, at, start, end, np.searchsorted(at[1:], start, "right"))
