"""Words of many texts at once: positions and 64-bit hashes from the Arrow buffer of a text column.

No text is turned into Python strings and no loop runs over words, so a batch costs a few passes of numpy
over its bytes. Memory beyond the batch is bounded by ``CHUNK`` bytes and the words' own arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
SLICE = 512 << 10
BATCH = "8m"

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash's base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        made = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers = tuple(made)
    return _powers


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most ``limit`` bytes together; a longer text has a range of its own."""
    ends = offsets(texts)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


def small_batches(spark) -> None:
    """Have Spark send rows to Python in batches of a few megabytes; the setting holds for the session."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) != BATCH:
        spark.conf.set(name, BATCH)


def give_back() -> None:
    """Return freed memory to the system, for a worker that goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def as_bytes(texts: pa.Array) -> pa.Array:
    return texts.cast(pa.large_binary())


def offsets(texts: pa.Array) -> np.ndarray:
    """Byte offsets of a large binary array; a null text has no bytes."""
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


@dataclass
class Words:
    data: np.ndarray  # the bytes of all texts, lower-cased
    bounds: np.ndarray  # of the texts in them
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # the text that each word belongs to

    def per_doc(self) -> np.ndarray:
        """For each text the place of its first word, and at the end the number of words."""
        return np.searchsorted(self.start, self.bounds)

    def hashes(self, *ends: np.ndarray) -> list[np.ndarray]:
        """Hashes of the bytes from each word's start to each of ``ends`` (default: the words)."""
        ends = ends or (self.end,)
        out = [np.empty(len(self.start), np.uint64) for _ in ends]
        lo = 0
        while lo < len(self.start):
            a = int(self.start[lo])
            hi = max(int(np.searchsorted(self.start, a + CHUNK)), lo + 1)
            b = int(self.end[hi - 1])
            power, inverse = powers(b - a + 1)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[self.data[a:b]] * power[: b - a], out=sums[1:])
            first = self.start[lo:hi] - a
            for e, o in zip(ends, out, strict=True):
                o[lo:hi] = mix((sums[e[lo:hi] - a] - sums[first]) * inverse[first])
            lo = hi
        return out

    def prefix_ends(self, lengths: list[int]) -> list[np.ndarray]:
        """Ends of the first n characters of each word, for each n (at most the word's end)."""
        chars = np.flatnonzero((self.data & 0xC0) != 0x80)
        at = np.searchsorted(chars, self.start)
        return [np.minimum(np.append(chars, len(self.data))[np.minimum(at + n, len(chars))], self.end) for n in lengths]


def scan(texts: pa.Array, inside: np.ndarray, lower_latin: bool = False) -> Words:
    """Words are runs of bytes for which ``inside`` holds, after lower-casing A-Z.

    ``lower_latin`` also lower-cases the capitals of Latin-1 in their two-byte form.
    """
    bounds = offsets(texts)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None else np.empty(0, np.uint8)
    data = LOWER[data]
    bounds = bounds - bounds[0]
    if lower_latin and len(data):
        capital = (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        capital[1:] &= data[:-1] == 0xC3
        capital[0] = False
        data[capital] += 0x20
    word = inside[data]
    edge = np.empty(len(data), bool)
    edge[:1] = True
    np.logical_not(word[:-1], out=edge[1:])
    edge[bounds[:-1][bounds[:-1] < len(data)]] = True
    start = np.flatnonzero(word & edge)
    last = np.empty(len(data), bool)
    last[-1:] = True
    np.logical_not(word[1:], out=last[:-1])
    inner = bounds[1:][bounds[1:] > 0] - 1
    last[inner] = True
    end = np.flatnonzero(word & last) + 1
    doc = np.searchsorted(bounds, start, "right") - 1
    return Words(data, bounds, start, end, doc)
