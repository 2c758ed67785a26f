"""Answers kept by question similarity.

The cache holds at most `capacity` entries, oldest dropped first. That bound is
the feature itself, and it is what lets the entries be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.constants import CACHE_CAPACITY, CACHE_SIMILARITY
from folioscope.functions.sizing import top_ranked
from folioscope.operators.dense import _matrix, _round


def surviving(entries: DataFrame, capacity: int = CACHE_CAPACITY, by: list[str] | None = None) -> DataFrame:
    """Entries left after storing all of `entries` in `seq` order.

    Each cache holds the latest `capacity` of them; `by` names the columns that
    tell several caches apart.
    """
    if by:
        kept = top_ranked(entries, by, [F.col("seq").desc()], capacity, rank="_age")
        return kept.drop("_age")
    return entries.orderBy(F.col("seq").desc()).limit(capacity)


def nearest(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """`query_id, seq, similarity` of the closest entry; the oldest wins a tie.

    `questions` has `query_id, embedding`, `entries` at most a cache full of
    `seq, embedding`. Without entries every question gets a null and a zero.
    """
    held = entries.select("seq", "embedding").orderBy("seq").toArrow()
    shared = questions.sparkSession.sparkContext.broadcast(
        (held["seq"].to_numpy().astype(np.int64), _matrix(held["embedding"]))
    )

    def closest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, vectors = shared.value
        for batch in batches:
            if not len(order):
                best, score = pa.nulls(batch.num_rows, pa.int64()), np.zeros(batch.num_rows)
            else:
                similarity = _round(_matrix(batch.column("embedding")) @ vectors.T)
                at = similarity.argmax(axis=1) if batch.num_rows else np.zeros(0, dtype=int)
                best, score = pa.array(order[at]), similarity[np.arange(batch.num_rows), at] if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), best, pa.array(score)], names=["query_id", "seq", "similarity"]
            )

    kind = questions.schema["query_id"].dataType.simpleString()
    asked = questions.select("query_id", "embedding")
    return asked.mapInArrow(closest, f"query_id {kind}, seq long, similarity double")


def lookup(
    questions: DataFrame, entries: DataFrame, threshold: float = CACHE_SIMILARITY, capacity: int = CACHE_CAPACITY
) -> DataFrame:
    """`query_id, seq, similarity, hit` against the entries a cache of `capacity` still holds."""
    found = nearest(questions, surviving(entries, capacity))
    hit = F.col("seq").isNotNull() & (F.col("similarity") >= threshold)
    return found.withColumn("hit", hit)


def hit_rate(lookups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits, misses and their share; zero when nothing was asked."""
    hits = F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0))
    total = F.count(F.lit(1))
    return lookups.groupBy(*(by or [])).agg(
        hits.alias("hits"),
        (total - hits).alias("misses"),
        F.when(total > 0, hits / total).otherwise(0.0).alias("hit_rate"),
    )


def health(entries: DataFrame, lookups: DataFrame) -> DataFrame:
    """One row: how many entries are held and the hit rate to three decimals."""
    held = entries.agg(F.count(F.lit(1)).alias("entries")).select("entries").scalar()
    return hit_rate(lookups).select(held.alias("entries"), F.round("hit_rate", 3).alias("hit_rate"))
