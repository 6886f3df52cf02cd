"""Hashes of word windows, all at once by numpy, and a bitmap that says which windows may stand in a benchmark.

A text is its words in small letters with single blanks between them, as bytes. The hash of words i to j is made from
two prefix sums of byte times a power of an odd base, shifted back to the power 0, modulo 2^64: equal windows hash alike
wherever they stand, and a window costs the same whatever its length. Hashes only ever say where to look: what they
find is held against the items themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a text that are hashed at once, unless its words are longer.
STRETCH = 1 << 20
#: Bits of the bitmap for each window, and the most and fewest bits (as powers of two) that it may take.
BITS_A_WINDOW = 16
MOST_BITS, LEAST_BITS = 28, 16

_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRETCH + (1 << 12))
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def clear() -> None:
    _powers.clear()


def bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of a text with single blanks."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
    return np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(text)]])


def stretches(starts: np.ndarray, ends: np.ndarray, most: int, window: int) -> Iterator[tuple[int, int]]:
    """Word ranges [a, b) of about ``most`` bytes, or of ``window`` words if those are longer. A range shares its last
    ``window`` - 1 words with the next, so every window of that many words or fewer lies whole in a range; no range but
    the only one is shorter than the window."""
    a, n = 0, len(starts)
    while a < n:
        b = min(n, max(int(np.searchsorted(ends, starts[a] + most, side="right")), a + window))
        yield a, b
        if b == n:
            return
        a = b - window + 1


def hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` words of a text whose words lie at starts to ends, as signed numbers."""
    count = len(starts) - length + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    begin = int(starts[0])
    part = np.frombuffer(text, np.uint8, int(ends[-1]) - begin, begin)
    power, back = _power(len(part))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power, out=sums[1:])
    first, last = starts[:count] - begin, ends[length - 1 :] - begin
    h = (sums[last] - sums[first]) * back[first] + np.uint64(length)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h.view(np.int64)


class Bitmap:
    """Which hashes may be known: false alarms happen, misses do not. Its size goes by the number of hashes up to
    2^``MOST_BITS`` bits (32 MB); beyond that only the false alarms become more."""

    def __init__(self, known: DataFrame, count: int):
        """Of ``known`` (h long), of which there are ``count``. The driver gets one number for each 64 bits at most."""
        self.bits = min(MOST_BITS, max(LEAST_BITS, (BITS_A_WINDOW * count).bit_length()))
        slot = F.shiftrightunsigned("h", 64 - self.bits)
        cells = known.select(F.shiftrightunsigned(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - self.bits}) & 63 as int))").alias("bit"))
        got = cells.groupBy("cell").agg(F.bit_or("bit").alias("mask")).toArrow()
        self.cells = np.zeros(1 << (self.bits - 6), np.int64)
        self.cells[got["cell"].to_numpy()] = got["mask"].to_numpy()

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        slot = h.view(np.uint64) >> np.uint64(64 - self.bits)
        cell = self.cells[(slot >> np.uint64(6)).astype(np.int64)].view(np.uint64)
        return (cell >> (slot & np.uint64(63))) & np.uint64(1) == 1


def candidate_runs(text: bytes, lengths: list[int], window: int, bitmap: Bitmap) -> tuple[int, list[tuple[int, bytes, list[int]]]]:
    """The number of words, and (first word, words, hashes) of each stretch of overlapping windows of the given lengths
    that the bitmap may hold."""
    starts, ends = bounds(text)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in stretches(starts, ends, STRETCH, window):
        for n in lengths:
            h = hashes(text, starts[a:b], ends[a:b], n)
            at = np.flatnonzero(bitmap.may_hold(h))
            if len(at):
                found.append((at + a, at + a + n, h[at]))
    if not found:
        return len(starts), []
    since, to, marks = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(since, kind="stable")
    since, to, marks = since[order], to[order], marks[order]
    reach = np.maximum.accumulate(to)
    cuts = np.concatenate([[0], np.flatnonzero(since[1:] >= reach[:-1]) + 1, [len(since)]])
    runs = []
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        first, last = int(since[x]), int(reach[y - 1])
        runs.append((first, text[starts[first] : ends[last - 1]], np.unique(marks[x:y]).tolist()))
    return len(starts), runs
