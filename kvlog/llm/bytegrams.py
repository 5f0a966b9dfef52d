"""Vectorised hashing of words and character n-grams over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in groups of about so many bytes, which bounds the arrays' memory.
GROUP_BYTES = 1 << 19
#: ASCII white space, as in ``[\x20\x09-\x0D]``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
#: The lowest 0 to 8 bytes of a number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def groups(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts as bytes) for runs of texts of about GROUP_BYTES; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lengths = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    begin = 0
    while begin < len(texts):
        base = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, base + GROUP_BYTES, side="right")))
        yield begin, [t or b"" for t in texts.slice(begin, end - begin).cast(pa.binary()).to_pylist()]
        begin = end


# Arrow's own pools hold on to freed memory; workers that idle between stages should not
pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """run, giving freed memory back to the system when a task ends: workers outlive their tasks."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few, so that what becomes Python objects stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Texts:
    """Several texts in one buffer, a space before, between and after them."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n = len(texts)
        self.buf = np.frombuffer(b" " + b" ".join(texts) + b" " * 9, dtype=np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=self.n)
        self.starts = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))  # of each text, and one past the last

    def split(self, gap: np.ndarray) -> None:
        """Words are runs of bytes outside ``gap``; sets begin, end, and first (index of each text's first word)."""
        inside = ~gap[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.begin, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.begin, self.starts)

    def word_hashes(self) -> np.ndarray:
        """One 64-bit hash a word, the same wherever the word stands: its bytes are mixed in eight at a time."""
        eight = np.ndarray(len(self.buf) - 7, dtype="<u8", buffer=self.buf, strides=(1,))
        left = self.end - self.begin
        out = mix(left.astype(np.uint64) * _P)
        at, which = self.begin, None  # None: all words
        while len(at):
            part = eight[at] & _LOW[np.minimum(left, 8)]
            if which is None:
                out = mix((out ^ part) * _P)
            else:
                out[which] = mix((out[which] ^ part) * _P)
            more = np.flatnonzero(left > 8)
            which = more if which is None else which[more]
            at, left = at[more] + 8, left[more] - 8
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the n-byte grams whose inner bytes are no white space; white space counts as one character."""
        b = np.where(SPACE[self.buf], np.uint8(32), self.buf)
        size = len(b) - 8
        h = np.zeros(size, dtype=np.uint64)
        for j in range(n):
            h = (h << np.uint64(8)) | b[j : j + size]
        ok = np.ones(size, dtype=bool)
        blank = b == 32
        for j in range(1, n - 1):
            ok &= ~blank[j : j + size]
        ok &= ~(blank[:size] & blank[n - 1 : n - 1 + size]) if n <= 2 else True
        at = np.flatnonzero(ok)
        return at, mix(h[at] * _P + np.uint64(n))

    def owner(self, at: np.ndarray) -> np.ndarray:
        """For sorted places, where each text's share begins (n + 1 numbers)."""
        return np.searchsorted(at, self.starts - 1)


def shingle_sets(t: Texts, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``size`` words; of all its words where it has fewer; none for none."""
    words = t.words = t.word_hashes()
    m = max(len(words) - size + 1, 0)
    h = np.zeros(m, dtype=np.uint64)
    for j in range(size):
        h = mix(h * _P + words[j : j + m])
    out = []
    for a, b in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True):
        if b - a >= size:
            one = np.sort(h[a : b - size + 1])
            out.append(one[np.concatenate(([True], one[1:] != one[:-1]))])
        elif b > a:
            x = np.array([b - a], dtype=np.uint64)
            for w in words[a:b]:
                x = mix(x * _P + w)
            out.append(x)
        else:
            out.append(words[:0])
    return out
