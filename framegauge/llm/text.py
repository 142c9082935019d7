"""Words and word n-gram hashes of many texts at once, on numpy arrays inside tasks.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what bytes.split() gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one vectorised step; keeps the arrays of a step near the CPU's caches.
STEP = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_TABLE = _rng.integers(0, 2**64, size=(64, 256), dtype=np.uint64).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _block(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = ~_IS_SPACE[b]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    k = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    values = _TABLE[((k & 63) << 8) | b[starts[0] :]]
    if k.max() >= 64:
        values *= ((k >> 6) * 2 + 1).astype(np.uint64)
    values[~solid[starts[0] :]] = 0
    return starts, ends, mix(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(np.uint64))


def word_hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash (by tabulation) of each word of blob."""
    found, at, b = [], 0, np.frombuffer(blob, np.uint8)
    while at < len(blob):
        end = at + STEP
        if end < len(blob):
            m = _SPACE.search(blob, end)
            end = m.start() if m else len(blob)
        s, e, h = _block(b[at:end])
        found.append((s + at, e + at, h))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Slice:
    """Consecutive texts of a batch: their words' starts, ends and hashes, and first[i]:first[i+1] as the words of text i."""

    def __init__(self, rows: range, texts: list[bytes], lower: bool):
        self.rows = rows
        self.blob = b" ".join(texts).lower() if lower else b" ".join(texts)
        self.starts, self.ends, self.hashes = word_hashes(self.blob)
        offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.first = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.n_words)

    def words(self, i: int) -> list[bytes]:
        if not self.n_words[i]:
            return []
        return self.blob[self.starts[self.first[i]] : self.ends[self.first[i + 1] - 1]].split()


def slices(column: pa.Array, lower: bool = False) -> Iterator[Slice]:
    """The texts of an Arrow column in slices of about STEP bytes; null counts as empty."""
    texts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size == 0 or size + len(texts[end]) <= STEP):
            size += len(texts[end]) + 1
            end += 1
        yield Slice(range(at, end), texts[at:end], lower)
        at = end


def ngram_hashes(words: np.ndarray, n: int, c: int) -> np.ndarray:
    """Hash of every n consecutive word hashes: sum of w[i+j] * c**(n-1-j), unmixed; c is odd."""
    if len(words) < n:
        return np.zeros(0, np.uint64)

    def times(x: np.ndarray, k: int) -> np.ndarray:
        return x * np.uint64(pow(c, k, 2**64))

    done, size, power, length = None, 0, words, 1
    while True:
        if n & length:
            if done is None:
                done, size = power, length
            else:
                m = len(words) - size - length + 1
                done, size = times(done[:m], length) + power[size : size + m], size + length
        if length * 2 > n:
            return done[: len(words) - n + 1]
        m = len(words) - 2 * length + 1
        power, length = times(power[:m], length) + power[length : length + m], length * 2


def batches(it: Iterable[pa.RecordBatch], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about limit bytes, so that very long texts don't pile up."""
    for batch in it:
        n, size = batch.num_rows, max(1, batch.nbytes)
        step = max(1, n * limit // size)
        for at in range(0, n, step):
            yield batch.slice(at, step)
