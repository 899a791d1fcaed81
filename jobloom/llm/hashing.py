"""Words of many texts at once, and 64-bit hashes of words and of windows of words, in numpy.

A hash of a run is a polynomial over random codes of its bytes (or of its words' hashes) modulo 2^64,
taken from prefix sums, then mixed. Everything is fixed, so that all tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; numpy needs about 40 times that.
BLOCK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """mix() the other way round."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as asked for so far."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            grow = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))])
            self.up, self.down = grow(np.uint64(self.base)), grow(np.uint64(self.back))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _WORDS2 = (Powers(b) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def places(buf: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words start and end."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~breaks[buf]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, block by block."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = ends[j - 1]
        up, down = _BYTES.get(int(high - low) + 1)
        sums = np.zeros(int(high - low) + 1, np.uint64)
        np.cumsum(_CODES[buf[low:high]] * up[:-1], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return mix(out)


def window_hashes(words: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """A hash of each run of ``size`` words; ``second`` gives another, independent one."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = (_WORDS2 if second else _WORDS).get(len(words))
    codes = mix(words ^ np.uint64(0x5851F42D4C957F2D)) if second else words
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(codes * up, out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[:n] + np.uint64(size))


def chunks(texts: list, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``most`` characters; a longer text stands alone."""
    first = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)


def slices(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """The same by bytes, for a column of texts that has not left Arrow yet."""
    first = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(column):
        yield first, len(column)


class Words:
    """The words of some texts: ``hash`` of each, ``doc`` (which text) and ``at`` (place in its text) of each, ``count`` by text."""

    def __init__(self, texts: list | pa.Array, breaks: np.ndarray = SPACES, lower: bool = False):
        if isinstance(texts, pa.Array):  # without making Python strings
            rows = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_string()), *(pa.scalar(x, pa.large_string()) for x in ("", " ")))
            firsts = np.frombuffer(rows.buffers()[1], np.int64)[: len(rows) + 1]
            buf = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[: firsts[-1]]
        else:
            raw = [(t or "").encode() for t in texts]
            firsts = np.cumsum([0, *[len(r) + 1 for r in raw]])
            buf = np.frombuffer(b" ".join(raw), np.uint8)
        if lower:
            buf = LOWER[buf]
        starts, ends = places(buf, breaks)
        self.first = np.searchsorted(starts, firsts)
        self.count = np.diff(self.first)
        self.hash = word_hashes(buf, starts, ends)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.at = np.arange(len(starts)) - self.first[:-1][self.doc]
        self.buf, self.starts, self.ends = buf, starts, ends
