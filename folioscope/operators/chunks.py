"""Paragraphs to chunks, chunk identifiers, and the checks a chunk table must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.constants import MAX_CHARS, OVERLAP_SENTENCES
from folioscope.functions.text import pack


def chunk(paragraphs: DataFrame, key: str, limit: int = MAX_CHARS, overlap: int = OVERLAP_SENTENCES) -> DataFrame:
    """Cuts each paragraph into chunks that carry its section and number."""
    pieces = paragraphs.select(key, "section", "paragraph", pack(F.col("text"), limit, overlap).alias("_pieces"))
    return (
        pieces.select(key, "section", "paragraph", F.posexplode_outer("_pieces").alias("chunk_index", "text"))
        .where("text is not null")
        .withColumn("chunk_index", F.col("chunk_index").cast("long"))
    )


def with_ids(chunks: DataFrame, key: str) -> DataFrame:
    """Adds `chunk_id`, a function of the chunk's location alone.

    A hash of (paper, paragraph, piece) is stable under retries and re-runs and
    needs no global numbering, which would order the whole table in one task.
    """
    return chunks.withColumn("chunk_id", F.xxhash64(F.col(key), "paragraph", "chunk_index"))


def duplicate_locations(chunks: DataFrame, key: str) -> DataFrame:
    """Locations that name more than one chunk; empty for a sound table."""
    return (
        chunks.groupBy(key, "paragraph", "chunk_index")
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def orphans(chunks: DataFrame, papers: DataFrame, key: str) -> DataFrame:
    """Chunks whose paper is not stored."""
    return chunks.join(papers.select(key), key, "left_anti")


def corpus_summary(chunks: DataFrame, key: str) -> DataFrame:
    """Size of the corpus: papers, chunks, sections, chunks per paper, mean length."""
    per_paper = chunks.groupBy(key, "section").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")
    )
    return per_paper.agg(
        F.countDistinct(key).alias("papers"),
        F.sum("n").alias("chunks"),
        F.countDistinct("section").alias("sections"),
        F.round(F.sum("n") / F.countDistinct(key), 6).alias("chunks_per_paper"),
        F.round(F.sum("chars") / F.sum("n"), 6).alias("mean_chars"),
    )
