"""Benchmark passages in training documents, found by a full-text index of every training shard.

Each task gathers its documents into shards of about `SHARD` words, numbers their words by the benchmark's vocabulary,
and builds an index of the shard (`fmindex`). The benchmark's windows are searched backwards through the index, all
of a shard together; occurrences are located by sampled suffix positions, and the spans they cover are merged. No
document is shuffled.

A window is `width` consecutive words of an item; an item of fewer words is one window. Words are runs of ASCII letters
and digits and of anything beyond ASCII, with A-Z in lower case.

* Stretches of a document that hold an unknown word are breaks of the index, and known stretches shorter than the
  shortest window are left out of it: no window can lie there.
* Equal texts of a shard are indexed once.
* The benchmark is the stated query set. It is handed to the tasks in blocks of at most `BLOCK` bytes of text (a single
  item is never split), one pass over the documents per block; each pass merges its spans with those found before.
* Null and empty texts have no words. An item without words has no window. An item without an id marks words but is not
  listed; rows that repeat an id are one item. Repeated documents stay. Empty tables are fine on either side.
* Texts of any length are searched whole; a text longer than a shard is a shard of its own.
* Other columns are kept; where they are named like a column the operator adds, the latter wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import extended, parts
from folioscope.llm.fmindex import Index

SHARD = 1 << 20
BLOCK = 16 * 1024 * 1024
_CHARS = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Windows:
    """The distinct windows of some items: their vocabulary, their words backwards, and the items that hold them."""

    def __init__(self, items: list[tuple], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list = []
        numbers: dict = {}
        holders: dict[tuple, set[int]] = {}
        for item, text in items:
            if item is not None and item not in numbers:
                numbers[item] = len(self.ids)
                self.ids.append(item)
            words = [self.vocabulary.setdefault(word, len(self.vocabulary) + 1) for word in words_of(text)]
            for start in range(max(1, len(words) - width + 1) if words else 0):
                held = holders.setdefault(tuple(words[start : start + width]), set())
                if item is not None:
                    held.add(numbers[item])
        self.lengths = np.array([len(w) for w in holders], dtype=np.int64)
        self.backwards = np.zeros((len(holders), max(1, width)), dtype=np.int64)
        for i, window in enumerate(holders):
            self.backwards[i, : len(window)] = window[::-1]
        self.holders = np.array([number for held in holders.values() for number in sorted(held)], dtype=np.int64)
        self.upto = np.concatenate(([0], np.cumsum([len(held) for held in holders.values()], dtype=np.int64))).astype(np.int64)


def _kept(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Which places of a shard its index holds: stretches of known words that are long enough, and a break after each."""
    edges = np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    enough = ends - starts >= shortest
    steps = np.zeros(len(ids) + 1, dtype=np.int8)
    steps[starts[enough]] += 1
    steps[ends[enough] + 1] -= 1  # each document is followed by a break, so there is a place after the end
    return np.flatnonzero(np.cumsum(steps[:-1], dtype=np.int8))


def occurrences(ids: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Place and window of every occurrence in a sequence of word numbers that ends with a break (0)."""
    none = np.empty(0, dtype=np.int64)
    if not len(windows.lengths):
        return none, none
    kept = _kept(ids, int(windows.lengths.min()))
    if not len(kept):
        return none, none
    index = Index(ids[kept].astype(np.int64), len(windows.vocabulary) + 1)
    low, high = index.search(windows.backwards, windows.lengths)
    counts = high - low
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
    return kept[index.locate(rows)], which


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _searched(texts: list[np.ndarray], windows: Windows) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For every sequence of word numbers, the words it shares with windows (from, to) and the numbers of the items."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    ids = np.zeros(int((sizes + 1).sum()), dtype=np.int32)
    for start, text in zip(starts.tolist(), texts, strict=True):
        ids[start : start + len(text)] = text
    places, which = occurrences(ids, windows)
    steps = np.bincount(places, minlength=len(ids) + 1) - np.bincount(places + windows.lengths[which], minlength=len(ids) + 1)
    edges = np.diff(np.concatenate(([0], (np.cumsum(steps) > 0).astype(np.int8), [0])))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(starts, begin, side="right") - 1
    spans = np.stack([begin - starts[owner], end - starts[owner]], axis=1)
    cuts = np.searchsorted(owner, np.arange(1, len(texts)))
    # Items of a document: those of its distinct windows.
    pairs = np.unique(np.stack([np.searchsorted(starts, places, side="right") - 1, which], axis=1), axis=0)
    held = np.diff(windows.upto)[pairs[:, 1]]
    items = windows.holders[_ranges(windows.upto[pairs[:, 1]], held)]
    listed = np.unique(np.stack([np.repeat(pairs[:, 0], held), items], axis=1), axis=0)
    apart = np.searchsorted(listed[:, 0], np.arange(1, len(texts)))
    return np.split(spans, cuts), np.split(listed[:, 1], apart)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))


def _pass(rows: DataFrame, shared, shard: int) -> DataFrame:
    """One block of windows: adds to the columns spans and items of each document."""
    names = [c for c in rows.columns if c not in ("n_words", "spans", "items")]

    def finish(held: list[pa.RecordBatch], which: list[np.ndarray], texts: list[np.ndarray], windows: Windows) -> Iterator[pa.RecordBatch]:
        spans, items = _searched(texts, windows) if texts else ([], [])
        for batch, own in zip(held, which, strict=True):
            before = [batch.column(c).to_pylist() for c in ("spans", "items")]
            new_spans, new_items, counts = [], [], []
            for number, old, listed in zip(own.tolist(), *before, strict=True):
                counts.append(len(texts[number]))
                fresh = [*map(tuple, spans[number].tolist())]
                fresh = _merged([*((s["from"], s["to"]) for s in old), *fresh]) if old else fresh
                new_spans.append([{"from": a, "to": b} for a, b in fresh])
                new_items.append(list(dict.fromkeys([*listed, *(windows.ids[i] for i in items[number].tolist())])))
            kind = batch.schema.field("items").type
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(new_spans, _SPANS), pa.array(new_items, kind)],
                names=[*names, "n_words", "spans", "items"],
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        get = windows.vocabulary.get
        held: list[pa.RecordBatch] = []
        which: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        seen: dict[str | None, int] = {}
        size = 0
        for batch in parts(batches):
            own = []
            for text in batch.column("text").to_pylist():
                number = seen.setdefault(text, len(texts))
                if number == len(texts):
                    words = words_of(text)
                    texts.append(np.fromiter(map(get, words, repeat(0)), dtype=np.int32, count=len(words)))
                    size += len(words)
                own.append(number)
            held.append(batch)
            which.append(np.array(own, dtype=np.int64))
            if size >= shard:
                yield from finish(held, which, texts, windows)
                held, which, texts, seen, size = [], [], [], {}, 0
        yield from finish(held, which, texts, windows)

    kind = rows.schema["items"].dataType.simpleString()
    return rows.mapInArrow(work, extended(rows.select(*names), f"n_words long, spans array<struct<from:long,to:long>>, items {kind}"))


def searched(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Documents with all their columns and n_words, spans (word numbers from and to, the end exclusive; disjoint and in
    order) and items (ids of the items of which a window occurs)."""
    spark = docs.sparkSession
    kind = benchmark.schema["item_id"].dataType
    rows = docs.drop("n_words", "spans", "items").withColumns(
        {
            "n_words": F.lit(0).cast("long"),
            "spans": F.array().cast("array<struct<from:long,to:long>>"),
            "items": F.array().cast(T.ArrayType(kind)),
        }
    )
    queries = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    payload = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-payload // block))
    for number in range(blocks):
        chosen = queries.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == number) if blocks > 1 else queries
        items = sorted((tuple(r) for r in chosen.collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        rows = _pass(rows, spark.sparkContext.broadcast(Windows(items, width)), shard)
    return rows


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the given words and what stood between and after them, up to the next word."""
    places = [m.span() for m in _CHARS.finditer(text)]
    keep, at = [], 0
    for start, end in spans:
        keep.append(text[at : places[start][0]])
        at = places[end][0] if end < len(places) else len(text)
    return "".join([*keep, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """The documents, with all their columns, without the words that occur in benchmark windows. `n_chars`, where present,
    follows the text; documents of which no word is left go."""
    clash = {c: f"_in_{c}" for c in docs.columns if c in ("n_words", "spans", "items")}
    rows = searched(docs.withColumnsRenamed(clash), benchmark, width)
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    texts[i] = without(texts[i], [(s["from"], s["to"]) for s in spans])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names], names=names)

    rows = rows.mapInArrow(work, rows.schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    rows = rows.where((F.size("spans") == 0) | (hit < F.col("n_words")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])


def digests(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows = searched(docs.select("doc_id", "text"), benchmark, width)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return rows.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )
