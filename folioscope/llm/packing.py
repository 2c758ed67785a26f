"""Best-fit packing of token sequences by exact complements.

The driver plans on a histogram of piece lengths, which has at most `capacity` entries whatever the data: the longest
length left asks an index of single, pair and triple sums for a combination that fills its gap exactly; the
combination is taken as often as all its lengths are available. What no combination fills goes by best fit. The plan
says which ranks of each length go to which sequences; pieces learn their rank from counts per task and length, so no
length, however common, is gathered in one place.

Null text counts as empty (one piece holding only the end id); repeated rows are packed each. Null ids are kept. An
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.bpe import Vocabulary, byte_alphabet, shared
from folioscope.llm.common import extended, stored

#: Fixed value: how the byte-level tokenizer splits text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def fast_encoder(vocabulary: Vocabulary):
    """Text to ids (numpy, four bytes each) by a compiled encoder built from the same vocabulary.

    Its ranks are the vocabulary's ids, which is only right when ids follow the order of the merges.
    """
    import tiktoken

    alphabet = byte_alphabet()
    order = [vocabulary.ids[a + b] for a, b in vocabulary.merges]
    if order != sorted(order):
        raise ValueError("token ids do not follow the order of the merges")
    ranks = {bytes(map(alphabet.__getitem__, token)): number for token, number in vocabulary.ids.items()}
    encoding = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=vocabulary.special)
    special = set(vocabulary.special)

    def encode(text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, dtype=np.uint32)
        if any(mark in text for mark in special):
            return encoding.encode_to_numpy(text, allowed_special=special)
        return encoding.encode_to_numpy(text, disallowed_special=())

    return encode


def cuts(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all of `capacity` but, where it does not divide, the first."""
    first = size % capacity or capacity
    starts = [0, *range(first, size, capacity)] if size > first else [0]
    return [(start, (starts + [size])[i + 1] - start) for i, start in enumerate(starts)]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, the task that made it and its number there; with `ids` if asked."""
    vocabulary = shared(docs.sparkSession, path)
    given = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = fast_encoder(Vocabulary(*vocabulary.value))
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, rows, lists = batch.column("doc_id"), [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                tokens = np.append(encode(text).astype("<u4"), np.uint32(end_id)).astype("<u4")
                raw = tokens.tobytes()
                for number, (start, length) in enumerate(cuts(len(tokens), capacity)):
                    rows.append((i, number, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                    if with_ids:
                        lists.append(tokens[start : start + length].astype("<i4"))
            at = np.array(rows, dtype=np.int64).reshape(-1, 5)
            own = made + np.arange(len(at))
            made += len(at)
            columns = [
                ids.take(pa.array(at[:, 0])), pa.array(at[:, 1].astype(np.int32)), pa.array(at[:, 2]), pa.array(at[:, 3]),
                pa.array(at[:, 4]), pa.array(np.full(len(at), part, dtype=np.int32)), pa.array(own),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_made"]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = "piece int, start long, length long, ids_crc32 long, _part int, _made long"
    return given.mapInArrow(work, extended(given.select("doc_id"), fields + ", ids array<int>" * with_ids))


@dataclass
class _Index:
    """Which lengths, pairs and triples are available for a sum. Availability only falls, so `none` stays true."""

    have: np.ndarray
    pairs: dict[int, tuple[int, int] | None] = field(default_factory=dict)

    def _fits(self, lengths: tuple[int, ...]) -> bool:
        return all(self.have[length] >= n for length, n in Counter(lengths).items())

    def pair(self, total: int) -> tuple[int, int] | None:
        known = self.pairs.get(total, ())
        if known is None or known and self._fits(known):
            return known
        large = np.arange((total + 1) // 2, total)
        both = (self.have[large] > 0) & (self.have[total - large] > 0)
        if total % 2 == 0 and len(large):
            both[0] &= self.have[total // 2] > 1
        found = np.flatnonzero(both)
        best = None if not len(found) else (int(large[found[-1]]), int(total - large[found[-1]]))
        self.pairs[total] = best
        return best

    def filling(self, gap: int) -> tuple[int, ...] | None:
        """Lengths that add up to a gap: one, else two, else three, large ones first."""
        if gap == 0:
            return ()
        if self.have[gap] > 0:
            return (gap,)
        two = self.pair(gap)
        if two is not None:
            return two
        for third in np.flatnonzero(self.have[: gap - 1])[::-1].tolist():
            two = self.pair(gap - third)
            if two is not None and self._fits((third, *two)):
                return (third, *two)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns of lengths with the number of sequences that follow each."""
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    index, patterns, left = _Index(have), [], {}
    for length in range(capacity, 0, -1):
        while have[length] > 0:
            have[length] -= 1
            filling = index.filling(capacity - length)
            have[length] += 1
            if filling is None:
                left[length] = int(have[length])
                have[length] = 0
                break
            need = Counter((length, *filling))
            times = int(min(have[item] // n for item, n in need.items()))
            for item, n in need.items():
                have[item] -= times * n
            patterns.append((times, (length, *filling)))
    return patterns + _best_fit(left, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best fit by falling length, many equal pieces at a time."""
    open_bins: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    gaps: list[int] = []

    def put(times: int, items: tuple[int, ...], gap: int) -> None:
        if times:
            if gap not in open_bins:
                open_bins[gap] = []
                insort(gaps, gap)
            open_bins[gap].append((times, items))

    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                put(n // each, (length,) * each, capacity - each * length)
                put(1 if n % each else 0, (length,) * (n % each), capacity - n % each * length)
                break
            gap = gaps[at]
            times, items = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(at)
            taken = min(times, n)
            n -= taken
            put(times - taken, items, gap)
            put(taken, (*items, length), gap - length)
    return [group for groups in open_bins.values() for group in groups]


def _places(patterns: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, ...]:
    """Per run of ranks of a length: (length, first rank), first sequence, offset; in order."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for times, items in patterns:
        offset = 0
        for length in items:
            rows.append((length, used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return table[:, 0] << 48 | table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def placed(made: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to stored pieces."""
    counts = stored(made.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n")))
    histogram = {row["length"]: row["n"] for row in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    keys, ranks, sequences, offsets = _places(plan(histogram, capacity))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_part", "length", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_part", "length").orderBy("_made")) - 1
    ranked = made.withColumn("_own", own).join(bases, ["_part", "length"])
    ranked = ranked.withColumn("_rank", F.col("_own") + F.col("_base")).drop("_own", "_base", "_part", "_made")
    names = [c for c in ranked.columns if c != "_rank"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, batch.column("length").to_numpy() << 48 | rank, side="right") - 1
            columns = [*(batch.column(c) for c in names), pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(work, extended(ranked.select(*names), "sequence_id long, offset long"))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place: doc_id, piece, start, length, ids_crc32, (ids,)
    sequence_id, offset."""
    rows = placed(stored(pieces(docs, path, capacity, end_id, with_ids)), capacity)
    ids = ["ids"] if with_ids else []
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", *ids, "sequence_id", "offset")
