"""Exact nearest neighbours by cosine similarity over unit vectors.

Each task multiplies its Arrow batches of corpus vectors with a block of query
vectors and keeps only the best `k` per query, so no (query, chunk) pair leaves a
task unless it can still be in the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.constants import CANDIDATES
from folioscope.functions.sizing import Extent, measure, top_ranked

SCORE_DIGITS = 6
QUERY_BLOCK = 16384
CORPUS_BLOCK = 65536
# Rows of a ranking that each task may hand on; with more, tasks are groups of bounded number instead of batches read.
KEPT_ROWS = 500_000
# Similarities held at once by a task: 8 MB.
QUERY_PIECE = 1024
CHUNK_PIECE = 1024


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def result(corpus: DataFrame, queries: DataFrame) -> str:
    """Columns of a ranking; identifiers keep the types they came with."""
    query, chunk = (df.schema[name].dataType.simpleString() for df, name in ((queries, "query_id"), (corpus, "chunk_id")))
    return f"query_id {query}, chunk_id {chunk}, score double"


def id_types(schema: str) -> tuple[pa.DataType, pa.DataType]:
    """Types of a ranking's identifiers; asked for on the driver."""
    fields = T.StructType.fromDDL(schema).fields
    return to_arrow_type(fields[0].dataType), to_arrow_type(fields[1].dataType)


def id_array(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Identifiers that compare as the engine compares them: integers as such, anything else as objects."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().astype(np.int64) if isinstance(column, pa.ChunkedArray) else column.to_numpy(False).astype(np.int64)
    values = np.empty(len(column), dtype=object)
    values[:] = column.to_pylist()
    return values


class Best:
    """The best `k` chunks of every query of a block, updated block by block.

    Order is score descending, then identifier. Scores are rounded to
    `SCORE_DIGITS`, so scaled scores and positions make one exact integer key.
    """

    def __init__(self, query_ids: np.ndarray, k: int):
        self.query_ids, self.k = query_ids, k
        self.scores = np.full((len(query_ids), 0), -np.inf)
        self.ids: np.ndarray | None = None
        self.kinds: tuple[pa.DataType, pa.DataType] = (pa.int64(), pa.int64())

    def of_types(self, kinds: tuple[pa.DataType, pa.DataType]) -> Best:
        """Fixes the types of the result's identifiers."""
        self.kinds = kinds
        return self

    def add(self, similarity: np.ndarray, ids: np.ndarray, at: slice) -> None:
        """Takes in similarities (queries x chunks) of the queries at `at`, unrounded. Once a query has its `k`, only
        what reaches its k-th best is looked at."""
        if self.ids is None:
            self.ids = np.empty((len(self.query_ids), 0), dtype=ids.dtype)
        if self.scores.shape[1] < self.k:
            self._take(*self._chosen(_round(similarity), ids), at)
            return
        held = self.scores[at]
        level = np.where(np.isnan(held), -np.inf, held).min(axis=1) - 10.0**-SCORE_DIGITS
        reach = similarity >= level[:, None]
        counts = reach.sum(axis=1)
        # Queries that many chunks reach, as those of equal scores do, go the long way; they widen no others.
        many, few = np.flatnonzero(counts > self.k), np.flatnonzero((counts > 0) & (counts <= self.k))
        if len(many):
            self._take(*self._chosen(_round(similarity[many]), ids), at.start + many)
        if len(few):
            row, column = np.nonzero(reach[few])
            size = counts[few]
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            padded = np.full((len(few), size.max()), -np.inf)
            candidates = np.full(padded.shape, ids[0], dtype=ids.dtype)
            padded[row, place], candidates[row, place] = _round(similarity[few[row], column]), ids[column]
            self._take(padded, candidates, at.start + few)

    def _chosen(self, similarity: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The `k` best of rounded similarities in each row, with their chunks."""
        by_id = np.argsort(ids, kind="stable")
        ids, similarity = ids[by_id], similarity[:, by_id]
        n = len(ids)
        if n <= self.k:
            return similarity, np.broadcast_to(ids, similarity.shape)
        key = np.rint(similarity * 10**SCORE_DIGITS).astype(np.int64) * n + np.arange(n - 1, -1, -1)
        chosen = np.argpartition(key, n - self.k, axis=1)[:, n - self.k :]
        return np.take_along_axis(similarity, chosen, 1), ids[chosen]

    def _take(self, similarity: np.ndarray, candidates: np.ndarray, at: slice | np.ndarray) -> None:
        """Sorts rounded similarities in among those that the rows at `at` hold already."""
        scores = np.concatenate([self.scores[at], similarity], axis=1)
        candidates = np.concatenate([self.ids[at], candidates], axis=1)
        order = np.lexsort((_places(candidates), -scores), axis=1)[:, : self.k]
        scores, candidates = np.take_along_axis(scores, order, 1), np.take_along_axis(candidates, order, 1)
        missing = scores.shape[1] - self.scores.shape[1]
        if missing > 0:
            rows = len(self.query_ids)
            self.scores = np.concatenate([self.scores, np.full((rows, missing), -np.inf)], axis=1)
            self.ids = np.concatenate([self.ids, np.full((rows, missing), candidates.flat[0], dtype=candidates.dtype)], axis=1)
        self.scores[at], self.ids[at] = scores, candidates

    def rows(self) -> pa.RecordBatch:
        real = np.isfinite(self.scores)
        owners = np.broadcast_to(self.query_ids[:, None], self.scores.shape)[real]
        chunks = [] if self.ids is None else self.ids[real]
        query, chunk = self.kinds
        return pa.RecordBatch.from_arrays(
            [pa.array(owners, query), pa.array(chunks, chunk), pa.array(self.scores[real], pa.float64())],
            names=["query_id", "chunk_id", "score"],
        )


def _places(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of identifiers of any type."""
    return ids if ids.dtype != object else np.unique(ids.ravel(), return_inverse=True)[1].reshape(ids.shape)


def _round(similarity: np.ndarray) -> np.ndarray:
    # The zero is added so that a rounded -0.0 equals 0.0 everywhere.
    return np.round(similarity, SCORE_DIGITS) + 0.0


def _add(best: Best, queries: np.ndarray, chunks: np.ndarray, ids: np.ndarray) -> None:
    """Compares all queries with all chunks of a batch, a bounded piece at a time."""
    for q in range(0, len(queries), QUERY_PIECE):
        at = slice(q, min(q + QUERY_PIECE, len(queries)))
        for c in range(0, len(chunks), CHUNK_PIECE):
            part = slice(c, c + CHUNK_PIECE)
            best.add(queries[at] @ chunks[part].T, ids[part], at)


def _by_broadcast(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    block = queries.toArrow()
    query_ids = id_array(block["query_id"])
    schema = result(corpus, queries)
    kinds = id_types(schema)
    shared = corpus.sparkSession.sparkContext.broadcast((query_ids, _matrix(block["embedding"])))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, vectors = shared.value
        best = Best(wanted, k).of_types(kinds)
        for batch in batches:
            if batch.num_rows and len(wanted):
                _add(best, vectors, _matrix(batch.column("embedding")), id_array(batch.column("chunk_id")))
        yield best.rows()

    return corpus.mapInArrow(nearest, schema)


def _numbers(count: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))


def _by_blocks(corpus: DataFrame, queries: DataFrame, k: int, extent: Extent, chunks: int) -> DataFrame:
    """Every query block meets every corpus block in a group of bounded size."""
    query_blocks = max(1, math.ceil(extent.rows / QUERY_BLOCK))
    corpus_blocks = max(1, math.ceil(chunks / CORPUS_BLOCK))

    left = corpus.withColumn("cb", F.pmod(F.xxhash64("chunk_id"), F.lit(corpus_blocks))).withColumn(
        "qb", F.explode(_numbers(query_blocks))
    )
    right = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))).withColumn(
        "cb", F.explode(_numbers(corpus_blocks))
    )

    schema = result(corpus, queries)
    kinds = id_types(schema)

    def nearest(some: pa.Table, asked: pa.Table) -> pa.Table:
        best = Best(id_array(asked["query_id"]), k).of_types(kinds)
        if some.num_rows and asked.num_rows:
            _add(best, _matrix(asked["embedding"]), _matrix(some["embedding"]), id_array(some["chunk_id"]))
        return pa.Table.from_batches([best.rows()])

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(nearest, schema)


def search(
    corpus: DataFrame,
    queries: DataFrame,
    limit: int = CANDIDATES,
    extent: Extent | None = None,
    by_blocks: bool | None = None,
) -> DataFrame:
    """Nearest chunks of each query vector with `1 - cosine distance` as score.

    `corpus` has `chunk_id, embedding`, `queries` has `query_id, embedding`; all
    vectors are of unit length and identifiers of any type with an order. The query matrix is broadcast only when its
    measured size and the ranking each task would hand on are small; otherwise both sides are cut into blocks.
    """
    corpus = corpus.select("chunk_id", "embedding")
    # Under names of their own: both sides may stem from one table.
    queries = queries.select(F.col("query_id").alias("query_id"), F.concat("embedding").alias("embedding"))
    extent = extent or measure(queries)
    if by_blocks is None:
        by_blocks = not extent.fits(copies=2) or extent.rows * limit > KEPT_ROWS
    if by_blocks:
        near = _by_blocks(corpus, queries, limit, extent, corpus.count())
    else:
        near = _by_broadcast(corpus, queries, limit)
    best = top_ranked(near, ["query_id"], [F.col("score").desc(), F.col("chunk_id").asc()], limit, spread="chunk_id")
    return best.select("query_id", "rank", "chunk_id", "score")
