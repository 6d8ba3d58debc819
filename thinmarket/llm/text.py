"""Words of a whole Arrow batch at once: spans and 64-bit hashes from the bytes of the column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Fixed values of the hashes: an odd base, its inverse modulo 2**64, and the mixing constants of splitmix64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
CHUNK_BYTES = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])

_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def word_table(is_word) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words are runs of anything but ASCII white space.
SPACED = word_table(lambda b: b not in SPACES)
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
ALNUM = word_table(lambda b: chr(b).isalnum() if b < 128 else True)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


class Words:
    """Words of some texts: ``first[i]:first[i + 1]`` are the words of text ``i``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, table: np.ndarray):
        inside = table[data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        begin, end = bounds[:-1], bounds[1:]
        full = begin < end
        before[begin[full]] = False
        after[end[full] - 1] = False
        self.data = data
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, bounds)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * powers(BASE, n), out=total[1:])
        raw = (total[self.end] - total[self.start]) * powers(INVERSE, n + 1)[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def windows(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, and the bounds of each text's runs.

    A text of fewer words, but not none, has one run of all its words.
    """
    count = np.diff(first)
    runs = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(first[:-1] - bounds[:-1], runs) + np.arange(bounds[-1])
    stop = np.repeat(first[1:], runs)
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        here = at + k
        inside = here < stop
        value = h[np.minimum(here, max(len(h) - 1, 0))] if len(h) else out
        out = np.where(inside, mix(out * np.uint64(BASE) + value), out)
    return out, bounds


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, bounds) of consecutive rows of about ``limit`` bytes; a longer text comes alone."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
