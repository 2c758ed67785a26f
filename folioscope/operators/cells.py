"""Nearest neighbours from a stored index of cells with 8-bit residuals.

Vectors lie in the cell of their nearest centroid, which is a folder of the stored table, in parts of bounded size. A
search compares each query with its nearest cells only; the cells of a batch reach the scan as literals, so the other
folders are not opened. Parts of neighbouring cells make a shelf, so that a query travels once to a shelf, not to every
cell, and leaves it with its best of the whole shelf. Codes give every similarity to within a known error. What could be among the best by
that error, and nothing else, is scored again with the exact vectors, so the result is exact for the cells looked at, and
exact altogether if all are.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.constants import CANDIDATES
from folioscope.functions.sizing import top_ranked
from folioscope.operators.dense import SCORE_DIGITS, _matrix
from folioscope.session import materialise

#: Vectors the centroids are fitted on at most, cells at most, vectors a part of a cell is meant to hold, vectors a shelf
#: is meant to hold at most, queries that meet it at once, and similarities that are held at once.
SAMPLE, CELLS, PART, SHELF, QUERIES, PIECE = 50_000, 4096, 16_384, 65_536, 16_384, 2_097_152


@dataclass(frozen=True)
class CellIndex:
    spark: SparkSession
    folder: str
    centroids: np.ndarray
    parts: tuple[int, ...]  # of each cell
    sizes: tuple[int, ...]  # vectors of each cell

    def shelves(self) -> list[list[int]]:
        """The number of the shelf of every part of every cell."""
        found, number, held = [], 0, 0
        for parts, size in zip(self.parts, self.sizes, strict=True):
            own = []
            for _ in range(parts):
                if held and held + size / parts > SHELF:
                    number, held = number + 1, 0
                own.append(number)
                held += size / parts
            found.append(own)
        return found

    @staticmethod
    def save(vectors: DataFrame, folder: str, cells: int | None = None) -> CellIndex:
        """Fits centroids on at most `SAMPLE` vectors (those of the smallest hashes of their ids) and stores all vectors.

        `vectors` has `chunk_id, embedding`, of unit length. Without `cells` there are as many as the square root of the
        rows, between 1 and `CELLS`.
        """
        spark = vectors.sparkSession
        rows = vectors.select("chunk_id", "embedding").where("embedding IS NOT NULL")
        total = rows.count()
        cells = max(1, min(cells or round(math.sqrt(total)), CELLS, total or 1))
        sample = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE)
        points = materialise(sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
        if total > 1 and cells > 1:
            model = KMeans(k=cells, seed=7, maxIter=10, distanceMeasure="cosine").fit(points)
            centroids = np.array(model.clusterCenters())
            centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
        else:
            centroids = np.array([r[0].toArray() for r in points.limit(1).collect()]).reshape(min(total, 1), -1)
        shared = spark.sparkContext.broadcast(centroids)
        kind = rows.schema["chunk_id"].dataType.simpleString()

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = shared.value
            for batch in batches:
                given = _matrix(batch.column("embedding"))
                cell = (given @ centres.T).argmax(axis=1) if len(given) else np.empty(0, dtype=np.int64)
                rest = given - centres[cell] if len(given) else given
                low = rest.min(axis=1) if len(given) else np.empty(0)
                step = np.maximum((rest.max(axis=1) - low) / 255, 1e-12) if len(given) else np.empty(0)
                codes = np.rint((rest - low[:, None]) / step[:, None]).astype(np.uint8) if len(given) else rest
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("chunk_id"), batch.column("embedding"), pa.array(cell.astype(np.int32)), pa.array(low), pa.array(step),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                    ],
                    names=["chunk_id", "embedding", "cell", "low", "step", "code"],
                )

        element = rows.schema["embedding"].dataType.simpleString()
        coded = materialise(rows.mapInArrow(encode, f"chunk_id {kind}, embedding {element}, cell int, low double, step double, code binary"))
        held = {r["cell"]: r["n"] for r in coded.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cell
        parts = tuple(max(1, math.ceil(held.get(c, 0) / PART)) for c in range(max(1, len(centroids))))
        number = F.get(F.array(*[F.lit(p) for p in parts]), F.col("cell")) if len(parts) <= 256 else None
        if number is None:
            sizes = spark.createDataFrame([*enumerate(parts)], "cell int, _parts int")
            coded = coded.join(F.broadcast(sizes), "cell")  # a row per cell, `CELLS` at most
            number = F.col("_parts")
        placed = coded.withColumn("part", F.pmod(F.xxhash64("chunk_id"), number).cast("int")).repartition("cell", "part")
        placed.select("cell", "part", "chunk_id", "low", "step", "code").write.partitionBy("cell").parquet(f"{folder}/codes")
        placed.select("cell", "chunk_id", "embedding").sortWithinPartitions("cell", "chunk_id").write.partitionBy("cell").parquet(f"{folder}/exact")
        sizes = tuple(held.get(c, 0) for c in range(len(parts)))
        facts = json.dumps({"centroids": centroids.tolist(), "parts": parts, "sizes": sizes})
        spark.createDataFrame([(facts,)], "facts string").coalesce(1).write.text(f"{folder}/facts")
        return CellIndex(spark, folder, centroids, parts, sizes)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> CellIndex:
        facts = json.loads(spark.read.text(f"{folder}/facts").first()[0])
        return CellIndex(spark, folder, np.array(facts["centroids"]), tuple(facts["parts"]), tuple(facts["sizes"]))


def _probed(index: CellIndex, queries: DataFrame, probes: int) -> DataFrame:
    """`query_id, asked, shelf, cells`: every query once per shelf that holds some of its nearest cells, with those (null: all)."""
    shared = index.spark.sparkContext.broadcast(index.centroids)
    shelves = index.shelves()
    whole = probes >= len(index.centroids)
    count = max((s[-1] for s in shelves), default=-1) + 1
    holds = np.zeros((len(shelves), count), dtype=bool)  # cells x shelves
    for cell, own in enumerate(shelves):
        holds[cell, own] = True

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = _matrix(batch.column("embedding"))
            if not len(given):
                continue
            if whole:
                at, shelf = (a.ravel() for a in np.indices((len(given), count)))
                cells = pa.nulls(len(at), pa.list_(pa.int32()))
            else:
                order = np.sort(np.argsort(-(given @ shared.value.T), axis=1, kind="stable")[:, :probes], axis=1)
                at, place, shelf = np.nonzero(holds[order])
                cell = order[at, place]
                by = np.lexsort((cell, shelf, at))
                at, shelf, cell = at[by], shelf[by], cell[by]
                first = np.flatnonzero(np.diff(at, prepend=-1) | np.diff(shelf, prepend=-1))
                cells = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(cell, pa.int32()))
                at, shelf = at[first], shelf[first]
            at = pa.array(at)
            columns = [batch.column("query_id").take(at), batch.column("embedding").take(at), pa.array(shelf, pa.int32()), cells]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "asked", "shelf", "cells"])

    kinds = [queries.schema[c].dataType.simpleString() for c in ("query_id", "embedding")]
    return queries.select("query_id", "embedding").mapInArrow(nearest, f"query_id {kinds[0]}, asked {kinds[1]}, shelf int, cells array<int>")


class _Bounds:
    """What may be among the `limit` best of each query: pairs with the least and the most their similarity can be."""

    def __init__(self, queries: np.ndarray, limit: int):
        sums = np.abs(queries).sum(axis=1, keepdims=True)
        self.asked = np.concatenate([queries, sums], axis=1).astype(np.float32)
        self.sums, self.limit = sums[:, 0], limit
        self.best = np.full((len(queries), limit), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []

    def add(self, vectors: np.ndarray, columns: np.ndarray, rows: np.ndarray) -> None:
        """Compares queries `rows` with vectors numbered `columns`; the last dimension of a vector is its error."""
        for start in range(0, len(columns), 2048):
            some = vectors[columns[start : start + 2048]]
            height = max(1, PIECE // len(some))
            for low in range(0, len(rows), height):
                self._add(some, columns[start : start + 2048], rows[low : low + height])

    def _add(self, some: np.ndarray, columns: np.ndarray, rows: np.ndarray) -> None:
        most = self.asked[rows] @ some.T + np.float32(10.0**-SCORE_DIGITS)
        r, c = np.nonzero(most >= self.best[rows].min(axis=1).astype(np.float32)[:, None])
        if not len(r):
            return
        most = most[r, c].astype(np.float64)
        least = most - 2 * (self.sums[rows[r]] * some[c, -1] + 10.0**-SCORE_DIGITS)
        self.found.append((rows[r], columns[c], least, most))
        touched, first, counts = np.unique(r, return_index=True, return_counts=True)
        padded = np.full((len(touched), self.limit + counts.max()), -np.inf)
        padded[:, : self.limit] = self.best[rows[touched]]
        padded[np.repeat(np.arange(len(touched)), counts), self.limit + np.arange(len(r)) - np.repeat(first, counts)] = least
        self.best[rows[touched]] = np.partition(padded, -self.limit, axis=1)[:, -self.limit :]
        if sum(len(f[0]) for f in self.found) > 4 * self.best.size + PIECE:
            self.found = [self.rows()]

    def rows(self) -> tuple[np.ndarray, ...]:
        if not self.found:
            return np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty(0), np.empty(0)
        columns = [np.concatenate(c) for c in zip(*self.found, strict=True)]
        kept = columns[3] >= self.best.min(axis=1).astype(np.float32)[columns[0]]
        return tuple(c[kept] for c in columns)


def _decoded(some: pa.Table, centroids: np.ndarray) -> np.ndarray:
    """Stored vectors up to a known error, which is their last dimension: per unit of a query's sum of absolute values."""
    code = np.frombuffer(b"".join(some["code"].to_pylist()), dtype=np.uint8).reshape(some.num_rows, -1)
    step, low, centre = some["step"].to_numpy(), some["low"].to_numpy(), centroids[some["cell"].to_numpy()]
    # Single precision adds what rounding may cost in a sum of so many products.
    rounding = code.shape[1] * 2.0**-21 * (255 * step + np.abs(low) + np.abs(centre).max(axis=1, initial=0))
    return np.concatenate([code * step[:, None] + low[:, None] + centre, (0.5 * step + rounding)[:, None]], axis=1).astype(np.float32)


def search(index: CellIndex, queries: DataFrame, limit: int = CANDIDATES, probes: int | None = None) -> DataFrame:
    """`query_id, rank, chunk_id, score` from the `probes` nearest cells of each query; three quarters of them if not given, which
    finds 0.975 of the best ten among 2,000 vectors without clusters, where a quarter finds 0.71."""
    cells = len(index.centroids)
    probes = min(cells, probes or math.ceil(cells * 3 / 4))
    queries = queries.where("embedding IS NOT NULL")
    pairs = _probed(index, queries, probes)
    codes = index.spark.read.parquet(f"{index.folder}/codes")
    exact = index.spark.read.parquet(f"{index.folder}/exact")
    if probes < cells:
        pairs = materialise(pairs)
        wanted = [r[0] for r in pairs.select(F.explode("cells")).distinct().collect()]  # a number per cell, `CELLS` at most
        codes, exact = (stored.where(F.col("cell").isin(wanted)) for stored in (codes, exact))
    # A shelf meets the queries in blocks, so no group grows with either side.
    blocks = max(1, math.ceil(queries.count() / QUERIES))
    places = [(c, p, s) for c, own in enumerate(index.shelves()) for p, s in enumerate(own)]
    places = F.broadcast(index.spark.createDataFrame(places, "cell int, part int, shelf int"))  # a row per part of a cell
    left = codes.join(places, ["cell", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = pairs.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    centroids = index.spark.sparkContext.broadcast(index.centroids)
    query_kind, chunk_kind = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (codes, "chunk_id")))

    def compare(some: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "chunk_id", "cell", "least", "most"]
        if not some.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, [asked["query_id"].type, some["chunk_id"].type, pa.int32(), pa.float64(), pa.float64()], strict=True)})
        bounds = _Bounds(_matrix(asked["asked"]), limit)
        vectors, cell = _decoded(some, centroids.value), some["cell"].to_numpy()
        if probes >= cells:
            bounds.add(vectors, np.arange(len(cell)), np.arange(asked.num_rows))
        else:
            lists = asked["cells"].combine_chunks()
            owner, named = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            for one in np.unique(cell):
                bounds.add(vectors, np.flatnonzero(cell == one), owner[named == one])
        q, c, least, most = bounds.rows()
        columns = [asked["query_id"].take(pa.array(q)), some["chunk_id"].take(pa.array(c)), pa.array(cell[c], pa.int32()), pa.array(least), pa.array(most)]
        return pa.table(columns, names=names)

    grouped = left.groupBy("shelf", "block").cogroup(right.groupBy("shelf", "block"))
    found = materialise(grouped.applyInArrow(compare, f"query_id {query_kind}, chunk_id {chunk_kind}, cell int, least double, most double"))
    best = top_ranked(found, ["query_id"], [F.col("least").desc()], limit, spread="chunk_id")
    level = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == limit, F.min("least")).alias("_level"))
    kept = found.join(level, "query_id").where(F.col("most") >= F.coalesce("_level", F.lit(float("-inf"))))
    # Few rows a query are left; their exact vectors come from the cells looked at.
    rows = kept.select("query_id", "chunk_id", "cell").join(exact, ["cell", "chunk_id"])
    rows = rows.join(queries.select("query_id", F.col("embedding").alias("_asked")), "query_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.einsum("ij,ij->i", _matrix(batch.column("embedding")), _matrix(batch.column("_asked"))) if batch.num_rows else np.empty(0)
            columns = [batch.column("query_id"), batch.column("chunk_id"), pa.array(np.round(value, SCORE_DIGITS) + 0.0)]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

    scored = rows.mapInArrow(score, f"query_id {query_kind}, chunk_id {chunk_kind}, score double")
    ranked = top_ranked(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], limit, spread="chunk_id")
    return ranked.select("query_id", "rank", "chunk_id", "score")
