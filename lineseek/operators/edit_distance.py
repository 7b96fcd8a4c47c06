"""Edit distances from one text to many others at once.

Texts stand side by side in one whole number, a bit for each code point and one
between two texts. A code point of the query then moves the column of every
text by a few operations on whole numbers (Myers' bit vectors); the bit between
keeps carries of one text out of the next. Distances are exact, for texts of any length.
"""

from __future__ import annotations

import sys
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Tasks get the functions below themselves, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACK_BITS = 1 << 16  # bits of texts set side by side
BETWEEN = 0xFFFFFFFF  # no code point
SUBSET = 4  # less than one text of so many asked for: they are set side by side anew


class Packed(NamedTuple):
    every: int  # bits of code points
    first: int  # the first bit of each text
    equal: dict[int, int]  # places of a code point
    starts: np.ndarray
    size: int


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _bits(mask: np.ndarray) -> int:
    return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")


def pack(texts: list[np.ndarray], alphabet: np.ndarray) -> Packed:
    """``alphabet`` holds the code points that queries may have, each once."""
    between = np.array([BETWEEN], np.uint32)
    flat = np.concatenate([part for text in texts for part in (text, between)])
    sizes = np.array([len(text) + 1 for text in texts])
    starts = np.cumsum(sizes) - sizes
    first = np.zeros(len(flat), bool)
    first[starts] = True
    shared = np.intersect1d(flat, alphabet)
    return Packed(
        _bits(flat != BETWEEN), _bits(first), {point: _bits(flat == point) for point in shared.tolist()}, starts, len(flat)
    )


def distances(query: list[int], packed: Packed) -> np.ndarray:
    """The distance of ``query``, as code points, to each text."""
    every, first, equal = packed.every, packed.first, packed.equal
    more, less = every, 0  # where a column rises and falls from one place of a text to the next
    for point in query:
        same = equal.get(point, 0)
        level = ((((same & more) + more) ^ more) | same | less) & every
        up = (((less | (every ^ (level | more))) << 1) | first) & every
        down = ((level & more) << 1) & every
        more = down | (every ^ (level | up))
        less = up & level

    def counted(bits: int) -> np.ndarray:
        held = np.frombuffer(bits.to_bytes(-(-packed.size // 8), "little"), np.uint8)
        return np.add.reduceat(np.unpackbits(held, count=packed.size, bitorder="little"), packed.starts, dtype=np.int64)

    return len(query) + counted(more) - counted(less)


class Titles:
    """A batch of lower-cased titles; equal ones are compared once."""

    def __init__(self, titles: pa.Array, alphabet: np.ndarray):
        coded = titles.fill_null("").dictionary_encode()
        self.alphabet = alphabet
        self.place = coded.indices.to_numpy()
        self.texts = [code_points(text) for text in coded.dictionary.to_pylist()]
        self.lengths = np.array([len(text) for text in self.texts], np.int64)
        self.groups = self._groups(np.argsort(self.lengths, kind="stable"))
        self.packed: dict[int, Packed] = {}

    def _groups(self, order: np.ndarray) -> list[np.ndarray]:
        """``order`` cut into runs of about ``PACK_BITS``."""
        if not len(order):
            return []
        run = np.cumsum(self.lengths[order] + 1) // PACK_BITS
        return np.split(order, np.flatnonzero(np.diff(run)) + 1)

    def _shares(self, query: list[int], group: np.ndarray, packed: Packed) -> np.ndarray:
        longer = np.maximum(self.lengths[group], len(query))
        share = np.divide(longer - distances(query, packed), longer, out=np.zeros(len(group)), where=longer > 0)
        return np.where(self.lengths[group] > 0, share, 0.0)

    def bound(self, length: int, group: int) -> float:
        """What a query of ``length`` code points can reach in a group, by the lengths alone."""
        held = self.lengths[self.groups[group]]
        near = min(max(length, held[0]), held[-1])
        return min(length, near) / max(length, near) if near and length else 0.0

    def group_matches(self, query: list[int], group: int) -> np.ndarray:
        """Share of code points that need no edit, for each text of a group."""
        if group not in self.packed:
            self.packed[group] = pack([self.texts[i] for i in self.groups[group]], self.alphabet)
        return self._shares(query, self.groups[group], self.packed[group])

    def matches(self, query: list[int], rows: np.ndarray | None = None) -> np.ndarray:
        """The same for each title of the batch, or for those at ``rows``."""
        found = np.zeros(len(self.texts))
        wanted = None if rows is None else np.unique(self.place[rows])
        if wanted is None or len(wanted) * SUBSET >= len(self.texts):
            for number, group in enumerate(self.groups):
                found[group] = self.group_matches(query, number)
        else:
            for group in self._groups(wanted):
                found[group] = self._shares(query, group, pack([self.texts[i] for i in group], self.alphabet))
        return found[self.place if rows is None else self.place[rows]]
