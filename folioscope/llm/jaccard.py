"""Similarity join of word-shingle sets by parity sketches.

Every shingle flips one bit of a sketch, so the Hamming distance of two sketches is at most the size of the sets'
symmetric difference, which a Jaccard threshold bounds by the sizes. Per band of sizes, the sketch is cut into more
parts than that bound: two similar sets must agree on a part. A part's bits are so many that it is kept as the XOR of
its shingles' hashes. A part no shingle falls into says nothing; there are spare parts, so that up to `slack` of them
can be left out: a pair agrees on more parts than either set leaves out, and agreeing parts are empty in both or in
neither. A set with more empty parts than that keeps them all.

Sets that share a part are first checked against the smallest of them. What hangs together then needs no further
check; only where a part still spans several components are the remaining pairs made, between components alone and
with sizes and sketches tested inside the join. These
sketches have as many bits as the set has shingles, to a power of two, so that a longer one folds onto a shorter. Every candidate is verified on the whole sets. So no link is
lost, and a group of n copies costs n checks per part.

Null and empty texts have no shingles and link with nothing. Texts with fewer words than a shingle are one shingle.
Equal sets are linked by a 128-bit signature. Rows that repeat an id share its component; null ids get a null one. An
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import discard, extended, hashed_texts, long_lists, mix, parts, small, stored, windows
from folioscope.llm.graph import components

LEAST_BITS = 512
_U = np.uint64


@dataclass(frozen=True)
class Bands:
    """Sizes in geometric bands of ratio 100 / percent, and the cut of a sketch for pairs whose larger set is in one."""

    percent: int

    def of(self, size: int) -> int:
        band = max(0, int(math.log(size) / math.log(100 / self.percent)) - 1)
        while self.first(band + 1) <= size:
            band += 1
        return band

    def first(self, band: int) -> int:
        return math.ceil(round((100 / self.percent) ** band, 9))

    def parts(self, band: int) -> tuple[int, int]:
        """Number of parts and how many of them may be left out."""
        largest = self.first(band + 1) - 1
        differ = (100 - self.percent) * 2 * largest // (100 + self.percent)
        slack = 0 if differ == 0 else math.ceil(0.03 * differ + 6 * math.sqrt(0.03 * differ))
        return differ + 1 + slack, slack


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` of a text's hashed words; of the whole text where it has fewer."""
    if not len(words):
        return words
    return np.unique(windows(words, min(width, len(words))))


def part_keys(found: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the parts in the set's own band and the next one, where it can be the smaller of a pair."""
    home, keys = bands.of(len(found)), []
    for band in (home, home + 1):
        count, slack = bands.parts(band)
        spread = mix(found + _U(2 * band + 1))
        part = ((spread >> _U(32)) * _U(count)) >> _U(32)
        value = np.zeros(count, dtype=np.uint64)
        np.bitwise_xor.at(value, part.astype(np.int64), mix(spread))
        filled = np.bincount(part.astype(np.int64), minlength=count) > 0
        named = mix(value + mix(np.arange(count, dtype=np.uint64) + _U(band << 40)))
        keys.append(named[filled] if count - filled.sum() <= slack else named)
    return np.concatenate(keys)


def sketch(found: np.ndarray) -> np.ndarray:
    size = max(LEAST_BITS, 1 << len(found).bit_length())
    bits = np.bincount((mix(found + _U(7)) % _U(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def described(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, signature (_a, _b), sketch and part keys.

    A task leaves the keys out of sets it has already seen, which the signature links.
    """
    given = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        nothing = np.empty(0, dtype=np.uint64)
        for batch in parts(batches):
            sizes, first, second, sketches, keys = [], [], [], [], []
            for words in hashed_texts(batch.column("text").to_pylist()):
                found = shingles(words, width)
                sizes.append(len(found))
                a, b = np.bitwise_xor.reduce(mix(found + _U(1))), mix(found + _U(2)).sum(dtype=np.uint64)
                first.append(a)
                second.append(b)
                sketches.append(sketch(found) if len(found) else nothing)
                again = (int(a), int(b)) in seen
                keys.append(nothing if again or not len(found) else part_keys(found, bands))
                if len(seen) < 200_000:
                    seen.add((int(a), int(b)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(first, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(second, dtype=np.uint64).view(np.int64)), long_lists(sketches), long_lists(keys),
                ],
                names=["doc_id", "n_shingles", "_a", "_b", "_sketch", "_keys"],
            )

    fields = "n_shingles long, _a long, _b long, _sketch array<long>, _keys array<long>"
    return given.mapInArrow(work, extended(given.select("doc_id"), fields))


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and the set itself (_set)."""
    given = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found = [shingles(words, width) for words in hashed_texts(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), long_lists(found)], names=["doc_id", "_set"])

    return given.mapInArrow(work, extended(given.select("doc_id"), "_set array<long>"))


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches allow the similarity."""
    size_a, size_b = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    x, y = F.col(f"{a}._sketch"), F.col(f"{b}._sketch")
    words = F.least(F.size(x), F.size(y))
    differing = F.zip_with(_folded(x, words), _folded(y, words), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    distance = F.aggregate(differing, F.lit(0), lambda total, n: total + n)
    ratio = (100 * F.least(size_a, size_b)) >= percent * F.greatest(size_a, size_b)
    # Sizes are compared first: within the ratio, one sketch is at most twice as long as the other.
    return F.when(ratio, (100 + percent) * distance <= (100 - percent) * (size_a + size_b)).otherwise(False)


def _folded(sketch: Column, words: Column) -> Column:
    halves = F.slice(sketch, F.lit(1), words), F.slice(sketch, words + 1, words)
    return F.when(F.size(sketch) == words, sketch).otherwise(F.zip_with(*halves, lambda p, q: p.bitwiseXOR(q)))


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are as similar as asked, stored; by the sets of just the documents concerned."""
    pairs = stored(pairs)
    ids = stored(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    whole = stored(sets_of(docs.select("doc_id", "text").join(small(ids), "doc_id", "left_semi"), width))
    sets = whole.dropDuplicates(["doc_id"])
    both = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("_set").alias("_x")), "u")
    both = both.join(sets.select(F.col("doc_id").alias("v"), F.col("_set").alias("_y")), "v")
    shared = F.size(F.array_intersect("_x", "_y"))
    links = stored(both.where(100 * shared >= percent * (F.size("_x") + F.size("_y") - shared)).select("u", "v"))
    discard(pairs, ids, whole)
    return links


def linked(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id per row: the smallest id reachable over links of at least `percent` Jaccard."""
    made = stored(described(docs, width, percent))
    about = stored(made.drop("_keys"))
    filled = about.where(F.col("n_shingles") > 0)
    groups = filled.groupBy("n_shingles", "_a", "_b").agg(F.min("doc_id").alias("_head"), F.count(F.lit(1)).alias("_n"))
    equal = filled.join(groups.where("_n > 1"), ["n_shingles", "_a", "_b"]).select(F.col("doc_id").alias("u"), F.col("_head").alias("v"))
    equal = stored(equal.where("u <> v").distinct())

    keys = made.select("doc_id", F.explode("_keys").alias("_key"))
    part = Window.partitionBy("_key")
    met = keys.withColumns({"_head": F.min("doc_id").over(part), "_last": F.max("doc_id").over(part)})
    met = stored(met.where("_head <> _last").select("_key", "doc_id", "_head"))
    discard(made)

    concerned = about.select("doc_id", "n_shingles", "_sketch").join(small(stored(met.select("doc_id").distinct())), "doc_id", "left_semi")
    concerned = stored(concerned.dropDuplicates(["doc_id"]))
    stars = met.where("doc_id <> _head").select(F.col("doc_id").alias("u"), F.col("_head").alias("v")).distinct()
    a = concerned.select(F.col("doc_id").alias("u"), F.struct("n_shingles", "_sketch").alias("_p"))
    b = concerned.select(F.col("doc_id").alias("v"), F.struct("n_shingles", "_sketch").alias("_q"))
    stars = stars.join(a, "u").join(b, "v").where(_possible("_p", "_q", percent)).select("u", "v")
    links = _verified(stars, docs, width, percent)
    edges = equal.unionByName(links)
    so_far = stored(components(edges))

    # Parts that still span several components: all pairs between those components.
    rows = met.select("_key", "doc_id").join(so_far.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = rows.withColumn("_group", F.coalesce("component", "doc_id")).drop("component")
    mixed = rows.groupBy("_key").agg(F.min("_group").alias("_x"), F.max("_group").alias("_y")).where("_x <> _y")
    open_rows = rows.join(mixed.select("_key"), "_key", "left_semi").join(concerned, "doc_id")
    open_rows = stored(open_rows.select("_key", "doc_id", "_group", F.struct("n_shingles", "_sketch").alias("_p")))
    left, right = open_rows.alias("l"), open_rows.withColumnRenamed("_p", "_q").alias("r")
    apart = (F.col("l._key") == F.col("r._key")) & (F.col("l._group") < F.col("r._group"))
    pairs = left.join(right, apart & _possible("_p", "_q", percent))
    pairs = pairs.select(F.col("l.doc_id").alias("u"), F.col("r.doc_id").alias("v")).distinct()
    pairs = pairs.join(stars_seen(met), ["u", "v"], "left_anti")
    late = _verified(pairs, docs, width, percent)
    final = so_far if late.isEmpty() else stored(components(edges.unionByName(late)))
    discard(equal, links, late, met, concerned, open_rows)
    result = about.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return result.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def stars_seen(met: DataFrame) -> DataFrame:
    """Pairs that were checked against the head of a part, either way round."""
    pairs = met.where("doc_id <> _head").select(F.col("doc_id").alias("u"), F.col("_head").alias("v"))
    return pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` that stay when one document of every component does, with all their columns.

    Documents without words are all kept: they link with nothing.
    """
    groups = linked(docs.select("doc_id", "text"), width, percent)
    gone = stored(groups.where("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
