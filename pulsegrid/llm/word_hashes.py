"""64-bit hashes of the words of many texts at once, straight from the UTF-8 bytes.

A word is a maximal run of bytes outside x20 and x09-x0D. Its hash is a polynomial in the bytes
(each replaced by a fixed random 64-bit value), taken from running sums over all bytes, and mixed.
Equal words have equal hashes everywhere; different words of a corpus of N have equal ones with a
chance of about N^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes of text that are worked on at once (a longer text is worked on by itself): few enough for the processor's cache.
CHUNK_BYTES = 1 << 18

_random = np.random.default_rng(20240501)
VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = VALUES.copy()
FOLDED[65:91] = VALUES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Weights for sequences of up to 64 words.
WEIGHTS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of STEP and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        out = []
        for base in (STEP, inverse):
            all_of = np.full(size, base, np.uint64)
            all_of[0] = 1
            out.append(np.cumprod(all_of))
        if size > 4 * CHUNK_BYTES:
            return out[0], out[1]  # for one very long text; not kept
        _powers[:] = out
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of consecutive texts: hash and byte span of each, and where each text's words start."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of text i: first[i] to first[i + 1]
    data: np.ndarray
    offsets: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def hash_words(texts: pa.Array, fold_case: bool = False) -> Words:
    texts = texts.fill_null("").cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, np.zeros(len(texts) + 1, np.int64), raw, offsets)
    space = SPACE[raw]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begins = ~space
    stops = begins.copy()
    begins[1:] &= space[:-1]
    begins[inner] = ~space[inner]
    stops[:-1] &= space[1:]
    stops[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    power, inverse = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((FOLDED if fold_case else VALUES)[raw] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), raw, offsets)


def pieces(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """(start, count) of consecutive runs of texts of at most ``limit`` bytes, or of one text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield at, i - at
            at, held = i, 0
        held += size
    if at < len(sizes):
        yield at, len(sizes) - at


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; shorter than ``hashes`` by n - 1."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:size] * WEIGHTS[0]
    for j in range(1, n):
        total += hashes[j : j + size] * WEIGHTS[j]
    return mix(total)
