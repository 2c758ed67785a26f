"""An n-gram trie in Elias-Fano levels.

Level k holds, context by context, the last words of the k-grams. Within a context words rise; adding each context's
number times the size of the vocabulary makes the whole level rise, so it is an Elias-Fano sequence, and so are the
pointers from each k-gram to its first successor. A path is followed by searching, on every level, for a word relative
to its context among the successors its pointers delimit. Leaves carry a probability quantised in the logarithm and a
count. All arrays of all levels lie in one temporary file that is memory-mapped and has no name, so that nothing is
left behind.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_U = np.uint64
#: Ones in each byte, and the place of each byte's first, second, ... one.
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)
_PLACE = np.argsort(~np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(bool), axis=1, kind="stable")
#: Logarithms (base 10) from -FLOOR to 0 in steps of FLOOR / STEPS; code 0 means none.
FLOOR, STEPS = 9.0, 65534


def quantised(probability: np.ndarray) -> np.ndarray:
    scaled = np.log10(np.maximum(probability, 10.0**-FLOOR)) / FLOOR + 1
    return (np.rint(np.clip(scaled, 0, 1) * STEPS) + 1).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    """Probabilities of codes; 0 for code 0."""
    return np.where(codes == 0, 0.0, 10.0 ** (((codes.astype(np.float64) - 1) / STEPS - 1) * FLOOR))


class Shelf:
    """Arrays that are put into a file one after another and then mapped."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.places: list[tuple[int, int, np.dtype]] = []
        self.map: mmap.mmap | None = None

    def put(self, values: np.ndarray) -> int:
        values = np.ascontiguousarray(values)
        self.places.append((self.file.tell(), len(values), values.dtype))
        self.file.write(values.tobytes())
        self.file.write(b"\0" * (-self.file.tell() % 8))
        return len(self.places) - 1

    def close(self) -> None:
        """Writing is over."""
        self.file.write(b"\0" * 8)
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)

    def get(self, number: int) -> np.ndarray:
        start, size, kind = self.places[number]
        return np.frombuffer(self.map, dtype=kind, count=size, offset=start)

    @property
    def size(self) -> int:
        return self.file.tell()


class Monotone:
    """A rising sequence: low bits as they are, high bits in unary with a count of ones per 64 bits."""

    def __init__(self, values: np.ndarray, universe: int, shelf: Shelf):
        values = values.astype(np.uint64)
        self.n, self.shelf = len(values), shelf
        spare = (int(universe) // max(1, self.n)).bit_length()
        self.shift = next(width for width in (8, 16, 32, 48) if width >= min(spare, 48))
        kind = {8: np.uint8, 16: np.uint16, 32: np.uint32, 48: np.uint64}[self.shift]
        high = values >> _U(self.shift)
        self.buckets = int(high[-1]) + 1 if self.n else 0
        bits = np.zeros(-(-(self.n + self.buckets + 1) // 64) * 64, dtype=np.uint8)
        bits[high.astype(np.int64) + np.arange(self.n)] = 1
        ones = bits.reshape(-1, 64).sum(axis=1)
        self.low = shelf.put((values & _U((1 << self.shift) - 1)).astype(kind))
        self.high = shelf.put(np.packbits(bits, bitorder="little"))
        self.ones = shelf.put(np.concatenate(([0], np.cumsum(ones))).astype(np.uint32))

    def _select(self, ranks: np.ndarray, bit: int) -> np.ndarray:
        """Places of the ones or zeros of the given numbers."""
        ones = self.shelf.get(self.ones).astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * 64 - ones
        words = self.shelf.get(self.high).reshape(-1, 8)
        out = np.empty(len(ranks), dtype=np.int64)
        for start in range(0, len(ranks), 1 << 16):
            part = ranks[start : start + (1 << 16)]
            word = np.searchsorted(before, part, side="right") - 1
            own = words[word] if bit else ~words[word]
            counts = _ONES[own]
            upto = np.cumsum(counts, axis=1)
            rank = part - before[word]
            byte = (upto <= rank[:, None]).sum(axis=1)
            at = np.arange(len(part)), byte
            out[start : start + len(part)] = word * 64 + byte * 8 + _PLACE[own[at], rank - upto[at] + counts[at]]
        return out

    def at(self, numbers: np.ndarray) -> np.ndarray:
        """The values of the given numbers."""
        high = self._select(numbers, 1) - numbers
        return high.astype(np.uint64) << _U(self.shift) | self.shelf.get(self.low)[numbers].astype(np.uint64)

    def find(self, values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Numbers of the smallest elements not below the values, between `first` and `last` (which is outside)."""
        high = (values >> _U(self.shift)).astype(np.int64)
        inside = high < self.buckets
        high = np.where(inside, high, max(self.buckets - 1, 0))
        end = self._select(high, 0) - high
        start = np.where(high > 0, self._select(np.maximum(high - 1, 0), 0) - np.maximum(high - 1, 0), 0)
        low, wanted = self.shelf.get(self.low), values & _U((1 << self.shift) - 1)
        begin, stop = np.maximum(start, first), np.minimum(end, last)
        begin = np.where(inside, begin, last)
        stop = np.maximum(np.where(inside, stop, last), begin)
        while True:
            open_ = np.flatnonzero(begin < stop)
            if not len(open_):
                return begin
            middle = (begin[open_] + stop[open_]) // 2
            less = low[middle].astype(np.uint64) < wanted[open_]
            begin[open_] = np.where(less, middle + 1, begin[open_])
            stop[open_] = np.where(less, stop[open_], middle)


class Trie:
    """n-grams (rows of word numbers, sorted and distinct) with probabilities and counts."""

    def __init__(self, grams: np.ndarray, words: int, probability: np.ndarray, counts: np.ndarray):
        self.words, self.shelf = words, Shelf()
        self.levels: list[Monotone] = []
        self.pointers: list[Monotone] = []
        parent = np.zeros(len(grams), dtype=np.int64)  # number of each row's context on the level above
        contexts = 1
        for depth in range(grams.shape[1]):
            new = np.ones(len(grams), dtype=bool)
            if depth + 1 < grams.shape[1]:
                new[1:] = (parent[1:] != parent[:-1]) | (grams[1:, depth] != grams[:-1, depth])
            rising = parent[new].astype(np.uint64) * _U(words) + grams[new, depth].astype(np.uint64)
            self.levels.append(Monotone(rising, contexts * words, self.shelf))
            starts = np.searchsorted(parent[new], np.arange(contexts + 1)) if len(grams) else np.zeros(contexts + 1)
            self.pointers.append(Monotone(starts, int(new.sum()) + 1, self.shelf))
            parent, contexts = np.cumsum(new) - 1, int(new.sum())
        self.codes, self.counts = self.shelf.put(quantised(probability)), self.shelf.put(counts.astype(np.int64))
        self.shelf.close()

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Leaf number of each row, -1 where the trie does not hold it."""
        context = np.zeros(len(grams), dtype=np.int64)
        for depth, (level, pointer) in enumerate(zip(self.levels, self.pointers, strict=True)):
            here = np.flatnonzero(context >= 0)
            if not len(here) or not level.n:
                return np.full(len(grams), -1)
            own = context[here]
            first, last = pointer.at(own).astype(np.int64), pointer.at(own + 1).astype(np.int64)
            wanted = own.astype(np.uint64) * _U(self.words) + grams[here, depth].astype(np.uint64)
            found = level.find(wanted, first, last)
            hit = found < last
            hit[hit] = level.at(found[hit]) == wanted[hit]
            context[here] = np.where(hit, found, -1)
        return context

    def values(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and counts of leaves, zeros for -1."""
        held = leaves >= 0
        if not held.any():
            return np.zeros(len(leaves), dtype=np.uint16), np.zeros(len(leaves), dtype=np.int64)
        at = np.where(held, leaves, 0)
        return np.where(held, self.shelf.get(self.codes)[at], 0).astype(np.uint16), np.where(held, self.shelf.get(self.counts)[at], 0)
