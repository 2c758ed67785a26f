"""Term scoring by blocks, for question batches whose vocabulary is small.

The engine tokenises; each task then looks the tokens up in the batch's
vocabulary and keeps one compact row per chunk. Scoring multiplies blocks of
chunk-by-term weights with term-by-question matrices and keeps the best few per
question, so neither postings nor (question, chunk) pairs are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.constants import BM25_B, BM25_K1
from folioscope.operators.dense import Best, id_array, id_types
from folioscope.session import small_batches

COUNTED = "chunk_id {}, length long, ids array<int>, counts array<int>"
BLOCK_ROWS = 1024  # chunks per block, fewer when the vocabulary is wide
BLOCK_CELLS = 8_000_000
QUERY_COLUMNS = 256  # questions scored at a time
KEPT_ROWS = 50_000_000  # rows that all tasks together hand on, at some 24 bytes
LEAST_TASKS = 24


@dataclass(frozen=True)
class Lookup:
    """The terms a batch of questions uses, and how often each question uses them.

    The usage is kept as (term, question, weight) triples; tasks turn them into
    matrices for a few questions at a time.
    """

    vocabulary: list[str]
    query_ids: np.ndarray
    query_type: str
    terms: np.ndarray
    questions: np.ndarray
    usage: np.ndarray

    @staticmethod
    def of(pairs: DataFrame, weight: str | None = None) -> Lookup:
        """From `query_id, term[, weight]` rows whose size has been measured."""
        rows = pairs.select("query_id", "term", *([weight] if weight else [])).toArrow()
        queries, column = np.unique(id_array(rows["query_id"]), return_inverse=True)
        vocabulary = sorted(set(rows["term"].to_pylist()))
        place = pc.index_in(rows["term"], value_set=pa.array(vocabulary, pa.string())).to_numpy()
        usage = rows[weight].to_numpy().astype(float) if weight else np.ones(rows.num_rows)
        by_question = np.argsort(column, kind="stable")
        return Lookup(
            vocabulary,
            queries,
            pairs.schema["query_id"].dataType.simpleString(),
            place[by_question].astype(np.int64),
            column[by_question],
            usage[by_question],
        )


def counted(chunks: DataFrame, words: Column, vocabulary: list[str]) -> DataFrame:
    """`chunk_id, length, ids, counts`: one row per chunk with the vocabulary terms
    it holds; the length counts all of its words."""
    shared = chunks.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, len(shared.value))
        for batch in batches:
            lists = batch.column(1)
            known = pa.array(shared.value, lists.type.value_type)
            lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            found = pc.fill_null(pc.index_in(lists.flatten(), value_set=known), -1).to_numpy()
            rows = np.repeat(np.arange(batch.num_rows, dtype=np.int64), lengths)
            cells, counts = np.unique((rows * size + found)[found >= 0], return_counts=True)
            ends = np.searchsorted(cells, np.arange(batch.num_rows + 1, dtype=np.int64) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(ends, pa.array((cells % size).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int32))),
                ],
                names=["chunk_id", "length", "ids", "counts"],
            )

    small_batches(chunks.sparkSession)
    tokenised = chunks.select("chunk_id", words.alias("words"))
    return tokenised.mapInArrow(count, COUNTED.format(chunks.schema["chunk_id"].dataType.simpleString()))


def totals(rows: DataFrame, terms: int) -> tuple[int, float, np.ndarray]:
    """Number of chunks, mean length and the document frequency of each term."""
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
    frequency = np.zeros(terms)
    held = rows.select(F.explode_outer("ids").alias("id")).where("id is not null").groupBy("id").count().toArrow()
    frequency[held["id"].to_numpy()] = held["count"].to_numpy()
    return int(row["n"]), float(row["mean"] or 0.0), frequency


def best(rows: DataFrame, lookup: Lookup, weights: np.ndarray, k: int, mean_length: float | None) -> DataFrame:
    """The `k` best chunks per question and task as `query_id, chunk_id, score`.

    `weights` is the weight of each term. With a mean length the counts are
    damped as in BM25, without one they are used as they are.
    """
    schema = f"query_id {lookup.query_type}, chunk_id {rows.schema['chunk_id'].dataType.simpleString()}, score double"
    kinds = id_types(schema)
    value = lookup.usage * weights[lookup.terms]
    starts = np.searchsorted(lookup.questions, np.arange(0, len(lookup.query_ids) + QUERY_COLUMNS, QUERY_COLUMNS))
    shared = rows.sparkSession.sparkContext.broadcast(
        (lookup.query_ids, lookup.terms, lookup.questions, value, starts, len(weights))
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, term, question, weight, start, width = shared.value
        kept = Best(asked, k).of_types(kinds)
        height = int(np.clip(BLOCK_CELLS // max(1, width), 64, BLOCK_ROWS))
        for whole in batches:
            for first in range(0, whole.num_rows, height):
                batch = whole.slice(first, height)
                block = _damped(batch, width, mean_length)
                ids = id_array(batch.column("chunk_id"))
                for part in range(len(start) - 1):
                    low, high = start[part], start[part + 1]
                    at = slice(part * QUERY_COLUMNS, min((part + 1) * QUERY_COLUMNS, len(asked)))
                    used, row = np.unique(term[low:high], return_inverse=True)
                    matrix = np.zeros((at.stop - at.start, len(used)))
                    matrix[question[low:high] - at.start, row] = weight[low:high]
                    kept.add(matrix @ block[:, used].T, ids, at)
        yield kept.rows()

    # Every task hands on its best `k` of every question: many questions need few tasks, with more chunks each.
    rows = rows.coalesce(max(LEAST_TASKS, KEPT_ROWS // max(1, k * len(lookup.query_ids))))
    return rows.mapInArrow(score, schema)


def _damped(batch: pa.RecordBatch, width: int, mean_length: float | None) -> np.ndarray:
    """Chunks x terms: counts, damped by repetition and relative length."""
    ids, counts = batch.column("ids"), batch.column("counts")
    chunk = np.repeat(np.arange(batch.num_rows), np.diff(ids.offsets.to_numpy()))
    value = counts.flatten().to_numpy().astype(np.float64)
    if mean_length:
        length = batch.column("length").to_numpy()[chunk]
        value = value * (BM25_K1 + 1.0) / (value + BM25_K1 * (1.0 - BM25_B + BM25_B * length / mean_length))
    block = np.zeros((batch.num_rows, width))
    block[chunk, ids.flatten().to_numpy()] = value
    return block
