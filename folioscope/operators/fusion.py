"""Reciprocal rank fusion of any number of rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.constants import RRF_K

SCORE_DIGITS = 9


def fuse(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """Sums 1/(k + rank) over the lists a chunk appears in.

    Only ranks count, because scores of different retrievers are not comparable.
    On a tie the chunk seen first wins: earlier list, then better rank in it. The
    lists are appended and grouped, which takes one shuffle however many lists
    there are.
    """
    tagged = [
        ranking.select("query_id", "chunk_id", "rank", F.lit(number).alias("list"))
        for number, ranking in enumerate(rankings)
    ]
    merged = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("query_id", "chunk_id")
        .agg(
            F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), SCORE_DIGITS).alias("score"),
            F.min(F.struct("list", "rank")).alias("seen"),
        )
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seen", "chunk_id")
    return merged.select(
        "query_id", F.row_number().over(order).cast("long").alias("rank"), "chunk_id", "score"
    )
