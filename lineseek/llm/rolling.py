"""Polynomial hashes of byte ranges, with NumPy.

With prefix sums of ``byte * MULTIPLIER ** place`` (modulo 2 ** 64), the hash of
any range is a difference times a power, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MULTIPLIER = 0x9E3779B97F4A7C15 | 5  # fixed odd value
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(held: np.ndarray, factor: int, size: int) -> np.ndarray:
    while len(held) < size:
        step = np.uint64(pow(factor, len(held), 1 << 64))
        held = np.concatenate([held, held * step])
    return held


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, from 0."""
    global _powers, _inverses
    _powers, _inverses = _grown(_powers, MULTIPLIER, size), _grown(_inverses, INVERSE, size)
    return _powers, _inverses


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit over all others."""
    values = values ^ (values >> np.uint64(32))
    values *= MIX
    values ^= values >> np.uint64(32)
    values *= MIX
    values ^= values >> np.uint64(32)
    return values


class Hashed:
    """Prefix hashes of ``data`` (bytes), place 0 first."""

    def __init__(self, data: np.ndarray):
        ahead, self.back = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ahead[: len(data)], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """The hash of each run of ``length`` bytes, by its start."""
        starts = max(0, len(self.sums) - length)
        return (self.sums[length:] - self.sums[:starts]) * self.back[:starts]

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of ``texts`` in a row, and where each begins (one bound more); null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]
