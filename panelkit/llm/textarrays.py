"""Words and lines of many texts as numpy arrays over their UTF-8 bytes.

Word separators are ASCII (space and the controls 9 to 13), so byte positions cut texts exactly where
``[^\\x20\\x09-\\x0D]+`` does. Hashes are polynomials modulo 2**64 over bytes or words, taken from prefix
sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled as one block of arrays; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd 64-bit multipliers of the polynomials: (bytes, words) of the first and the second hash.
_BASES = ((0x9E3779B97F4A7C15, 0xD1342543DE82EF95), (0xC2B2AE3D27D4EB4F, 0xAF251AF3B0F025B5))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)

        def run(step: int) -> np.ndarray:
            out = np.full(size, step, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        known = _POWERS[base] = (run(base), run(pow(base, -1, 1 << 64)))
    return known


def forget_powers() -> None:
    """Powers are as many as the bytes of the largest block so far."""
    _POWERS.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair of bounds."""
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start])


@dataclass
class Block:
    """Consecutive texts: their bytes, and the words in order with the text each belongs to."""

    first: int  # row of the first text
    body: np.ndarray  # bytes of all texts
    bounds: np.ndarray  # text i is body[bounds[i]:bounds[i + 1]]
    doc: np.ndarray  # per word: text within the block
    start: np.ndarray
    end: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.bounds) - 1

    @property
    def words_per_text(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.texts)

    def first_word(self) -> np.ndarray:
        """Number of the first word of each text, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.words_per_text)])

    def word_hash(self, which: int = 0) -> np.ndarray:
        return _span_hash(self.body.astype(np.uint64) + np.uint64(1), self.start, self.end, _BASES[which][0])

    def window_hash(self, words: np.ndarray, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of ``size`` words that lie in one text."""
        n = len(words) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, _span_hash(words, at, at + size, _BASES[which][1])

    def span_hash(self, words: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of runs of words between the given word numbers."""
        return _span_hash(words, start, end, _BASES[which][1])

    def byte_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _span_hash(self.body.astype(np.uint64) + np.uint64(1), start, end, _BASES[0][0])

    def word(self, i: int) -> bytes:
        return self.body[self.start[i] : self.end[i]].tobytes()


def blocks(texts: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a column of texts (null: empty) into blocks of about ``limit`` bytes. ``lower`` lowers A to Z."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield _block(data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at], at, lower)
        at = to


def _block(body: np.ndarray, bounds: np.ndarray, first: int, lower: bool) -> Block:
    if lower:
        body = _LOWER[body]
    n = len(body)
    word = np.zeros(n + 1, bool)
    word[:n] = ~_SEPARATOR[body]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.zeros(n + 1, bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge))
    end = np.flatnonzero(before & (~word | edge))
    doc = np.searchsorted(bounds, start, "right") - 1
    return Block(first, body, bounds, doc, start, end)


def per_text(block: Block, at: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Sum of ``values`` (or count) per text, for words ``at``."""
    return np.bincount(block.doc[at], weights=values, minlength=block.texts).astype(np.int64)
