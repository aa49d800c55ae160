"""Word positions and hashes of an Arrow text column, vectorised in numpy.

All separators used here are ASCII, so UTF-8 texts are cut bytewise. Work is done in chunks of
about a quarter of a megabyte, which bounds a task's memory whatever Spark's batch size is; one
longer text makes a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 256 * 1024
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown as texts need."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = max(n, CHUNK * 2)
            up, down = np.full(m, _BASE), np.full(m, _BASE_INV)
            up[0] = down[0] = 1
            cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up[:n], cls.down[:n]


@dataclass
class Words:
    """Words of the texts of one chunk; bounds[d]:bounds[d + 1] are the words of text d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.bounds) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of its bytes."""
        up, down = _Powers.get(len(self.data) + 1)
        acc = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=acc[1:])
        return mix((acc[self.end] - acc[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def left(self) -> np.ndarray:
        """Of each word: the number of words from it to the end of its text."""
        return np.repeat(self.bounds[1:], self.counts()) - np.arange(len(self.start))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def join(self, a: int, b: int) -> bytes:
        """Words a to b - 1 joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b]))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on, where n words are left in the chunk."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= _GRAM
        out += h[j : len(h) - n + 1 + j]
    return mix(out)


def split_words(texts: pa.Array, word: np.ndarray = SPACE, fold: bool = False) -> Words:
    """Words of each text (null: none). word: which bytes belong to words; fold: lower-case A-Z first."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    if fold:
        data = FOLD[data]
    inside = word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before &= ~edge[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def chunks(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about CHUNK bytes of text each."""
    col = batch.column(text)
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0)) if len(col) else np.empty(0, int)
    a = total = 0
    for i, n in enumerate(size):
        if total and total + n > CHUNK:
            yield batch.slice(a, i - a)
            a, total = i, 0
        total += int(n)
    if a < len(col):
        yield batch.slice(a)
