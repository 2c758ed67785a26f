"""Routing, query planning and the passages handed to the answer model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.constants import (
    COMPARISON_PATTERN,
    CONTEXT_PASSAGES,
    MIN_SIDE_WORDS,
    SIDE_PATTERN,
    WHITESPACE,
)
from folioscope.functions.sizing import top_ranked
from folioscope.functions.text import let


def is_comparison(question: Column) -> Column:
    return question.rlike(f"(?iU){COMPARISON_PATTERN}")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WHITESPACE + "+"), lambda w: F.length(w) > 0))


def planned(question: Column) -> Column:
    """Queries to run for a question, itself first.

    A comparison adds one query per side with enough words; when no side has
    enough, the question is repeated.
    """
    parts = F.transform(F.split(question, f"(?iU){SIDE_PATTERN}"), lambda p: F.btrim(p, F.lit(" ?.,")))
    sides = F.filter(parts, lambda p: word_count(p) >= MIN_SIDE_WORDS)
    with_sides = let(
        sides,
        lambda s: F.concat(F.array(question), F.when(F.size(s) > 0, s).otherwise(F.array(question))),
    )
    return F.when(is_comparison(question), with_sides).otherwise(F.array(question))


def route(questions: DataFrame) -> DataFrame:
    return questions.withColumn("comparative", is_comparison(F.col("text")))


def plan(questions: DataFrame) -> DataFrame:
    """`query_id, query_no, text`: one row per query to run."""
    return questions.select("query_id", F.posexplode(planned(F.col("text"))).alias("query_no", "text")).withColumn(
        "query_no", F.col("query_no").cast("long")
    )


def numbered(plans: DataFrame) -> DataFrame:
    """`query_id, text, question_id, query_no`: planned queries under identifiers
    of their own, repeats left out.

    A repeated query would only return passages that are already there. The
    identifier is the question's with the query's number behind it, as text, so
    questions may have identifiers of any type and size.
    """
    first = plans.groupBy("query_id", "text").agg(F.min("query_no").alias("query_no"))
    own = F.concat(F.col("query_id").cast("string"), F.lit("#"), F.col("query_no").cast("string"))
    return first.select(own.alias("query_id"), "text", F.col("query_id").alias("question_id"), "query_no")


def merge(rankings: DataFrame, queries: DataFrame, cap: int = CONTEXT_PASSAGES, interleave: bool = False) -> DataFrame:
    """Passages of all queries of a question, each once, at most `cap`.

    `rankings` of the `queries` that `numbered` made.

    Earlier queries fill the slots first. With `interleave` the queries take
    turns instead, which gives every side of a comparison a place.
    """
    owners = queries.select("query_id", "question_id", "query_no")
    single = rankings.join(owners, "query_id").select(
        F.col("question_id").alias("query_id"), "query_no", "rank", "chunk_id", "score"
    )
    place = F.struct("rank", "query_no", "score") if interleave else F.struct("query_no", "rank", "score")
    unique = single.groupBy("query_id", "chunk_id").agg(F.min(place).alias("place"))
    chosen = top_ranked(unique, ["query_id"], [F.col("place").asc(), F.col("chunk_id").asc()], cap, rank="number")
    return chosen.select("query_id", "number", "chunk_id", F.col("place.score").alias("score"))
