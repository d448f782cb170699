"""Word shingles of Arrow string columns, as 64-bit hashes, computed for a whole batch at once.

Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A word's hash is a polynomial in its bytes and a
shingle's hash mixes the hashes of its words in their order; texts with fewer words than a shingle have one shingle of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
RUN_BYTES = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        if n:
            out[0] = 1
        return np.cumprod(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the public splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(texts: pa.Array) -> Iterator[pa.Array]:
    """The column in runs of about RUN_BYTES, which stay in the processor's caches."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + RUN_BYTES, "right")))
        yield texts.slice(low, high - low)
        low = high


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (faster here than numpy's own for short arrays)."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Spans:
    """Runs of bytes outside ``breaks`` in a column of texts (null: none): starts, ends, runs of each text, and hashes."""

    def __init__(self, texts: pa.Array, breaks: np.ndarray = _BREAK):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        self.raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0]
        inside = ~breaks[self.raw]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        borders = self.offsets[(self.offsets > 0) & (self.offsets < len(self.raw))]  # no run reaches over two texts
        first[borders] = inside[borders]
        last[borders - 1] = inside[borders - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.counts = np.diff(np.searchsorted(self.starts, self.offsets))
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(self.raw) + 1, np.uint64)
            np.cumsum((_LOWER[self.raw].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(self.raw)), out=self.sums[1:])
            self.scale = _powers(_INVERSE, len(self.raw))

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Of the runs, or of other ranges of bytes; A-Z count as a-z."""
        starts, ends = self.starts if starts is None else starts, self.ends if ends is None else ends
        with np.errstate(over="ignore"):
            value = (self.sums[ends] - self.sums[starts]) * self.scale[starts]
            return mixed(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text (null: none)."""
    spans = Spans(texts)
    return spans.hashes(), spans.counts


def rolled_windows(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The hash of every window of words, over the whole batch; windows over two texts are the caller's to leave out."""
    out = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words if len(out) else 0):
            out = mixed(out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k:len(hashes) - words + 1 + k])
    return out


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled, low = rolled_windows(hashes, words), 0
        for n in counts.tolist():
            if n >= words:
                yield distinct(rolled[low:low + n - words + 1])
            elif n:
                one = np.uint64(n)
                for h in hashes[low:low + n]:
                    one = mixed(np.array([one * np.uint64(0xA0761D6478BD642F) + h]))[0]
                yield np.array([one], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            low += n
