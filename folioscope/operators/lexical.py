"""BM25: term index, inverse document frequency, scoring, top-k.

The index is two DataFrames. `postings` holds one row per (chunk, term) with the
chunk's length beside it; `lengths` one row per chunk. The driver only ever holds
the number of chunks and their mean length.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.constants import BM25_B, BM25_K1, CANDIDATES, LIBRARY_IDF_FLOOR
from folioscope.functions.sizing import Extent, measure, rounded, spread_join, top_ranked
from folioscope.functions.text import bags, question_terms, tokens
from folioscope.operators import blocks
from folioscope.operators.blocks import Lookup
from folioscope.session import materialise

SCORE_DIGITS = 6
BUCKETS = 256
#: Postings, or pairs of a question and a chunk, that meet in one task.
TASK_ROWS = 2_000_000


@dataclass(frozen=True)
class TermIndex:
    postings: DataFrame  # chunk_id, length, term, tf
    lengths: DataFrame  # chunk_id, length
    buckets: int | None = None  # term partitions of a stored index

    def totals(self) -> tuple[int, float]:
        """Number of chunks and their mean length: two numbers, read once."""
        row = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
        return int(row["n"]), float(row["mean"] or 0.0)

    def document_frequency(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def save(self, folder: str, buckets: int = BUCKETS) -> None:
        """Stores the index with its postings partitioned by a hash of the term.

        A search then opens only the partitions its terms fall into. The salt
        spreads a partition over several files, because a stop word's postings
        are a large part of the index.
        """
        self.lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
        stored = TermIndex(self.postings, self.postings.sparkSession.read.parquet(f"{folder}/lengths"))
        count, mean = stored.totals()
        placed = self.postings.withColumn("bucket", _bucket(buckets))
        placed = placed.withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), F.lit(32)))
        (
            placed.repartition(_tasks(placed, count * mean), "bucket", "_salt")
            .drop("_salt")
            .sortWithinPartitions("bucket", "term")
            .write.mode("overwrite")
            .partitionBy("bucket")
            .parquet(f"{folder}/postings")
        )

    @staticmethod
    def load(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> TermIndex:
        return TermIndex(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths"), buckets)

    def restricted(self, terms: DataFrame, extent: Extent) -> TermIndex:
        """The part of a stored index a batch needs.

        The partitions come from the batch's terms, of which there are never more
        than `buckets`, as literals, so the others are not even listed.
        """
        needed = self.postings
        if self.buckets:
            wanted = [r["b"] for r in terms.select(_bucket(self.buckets).alias("b")).distinct().collect()]
            needed = needed.where(F.col("bucket").isin(wanted))
        vocabulary = terms.select("term").distinct()
        kept = spread_join(needed, vocabulary, ["term"], extent.fits(copies=2), ["chunk_id"], how="left_semi")
        return TermIndex(materialise(kept.select("chunk_id", "length", "term", "tf")), self.lengths)


def _tasks(df: DataFrame, rows: float) -> int:
    """So many tasks that none sorts or adds up more than `TASK_ROWS`, and at least as many as any other shuffle has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / TASK_ROWS))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def build_index(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> TermIndex:
    """The whole term index of a chunk table, lazily. Needs no shuffle."""
    rows = bags(chunks, key, text).withColumnRenamed(key, "chunk_id")
    postings = rows.selectExpr("chunk_id", "length", "inline_outer(terms) as (term, tf)")
    return TermIndex(postings.where("term is not null"), rows.select("chunk_id", "length"))


def index_for(
    chunks: DataFrame,
    terms: DataFrame,
    extent: Extent,
    key: str = "chunk_id",
    text: str = "text",
) -> TermIndex:
    """Index restricted to the terms a batch of questions uses, written once.

    One pass over the corpus produces the surviving postings and every chunk's
    length (a row whose term is null); document frequency, corpus totals and
    scoring then read that table instead of the corpus.
    """
    vocabulary = terms.select("term").distinct().withColumn("wanted", F.lit(True))
    rows = bags(chunks, key, text).withColumnRenamed(key, "chunk_id")
    nothing = F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("tf"))
    entries = rows.select("chunk_id", "length", F.concat(F.array(nothing), F.col("terms")).alias("terms")).selectExpr(
        "chunk_id", "length", "inline_outer(terms) as (term, tf)"
    )
    if extent.fits(copies=2):
        kept = entries.join(F.broadcast(vocabulary), "term", "left").where("term is null or wanted")
    else:
        found = spread_join(
            entries.where("term is not null"), vocabulary, ["term"], fits=False, spread=["chunk_id"], how="left_semi"
        )
        kept = found.unionByName(entries.where("term is null"))
    kept = materialise(kept.select("chunk_id", "length", "term", "tf"))
    return TermIndex(kept.where("term is not null"), kept.where("term is null").select("chunk_id", "length"))


# --- weights ---------------------------------------------------------------


def smoothed_idf(df: Column, chunks: int) -> Column:
    """Positive for every term, also for one that is in every chunk."""
    return F.log(1.0 + (F.lit(chunks) - df + 0.5) / (df + 0.5))


def plain_idf(df: Column, chunks: int) -> Column:
    """Unsmoothed; negative once a term is in more than half of the chunks."""
    return F.log(F.lit(chunks) - df + 0.5) - F.log(df + 0.5)


def term_stats(index: TermIndex, chunks: int | None = None) -> DataFrame:
    """`term, df, idf` over the whole index."""
    chunks = index.totals()[0] if chunks is None else chunks
    return index.document_frequency().select("term", "df", smoothed_idf(F.col("df"), chunks).alias("idf"))


def library_term_stats(index: TermIndex, chunks: int | None = None) -> DataFrame:
    """Unsmoothed weights, the negative ones replaced by a share of the mean."""
    chunks = index.totals()[0] if chunks is None else chunks
    plain = index.document_frequency().select("term", "df", plain_idf(F.col("df"), chunks).alias("idf"))
    floor = plain.agg((LIBRARY_IDF_FLOOR * F.avg("idf")).alias("floor")).scalar()
    return plain.select("term", "df", F.when(F.col("idf") < 0, floor).otherwise(F.col("idf")).alias("idf"))


def saturation(tf: Column, length: Column, mean_length: float) -> Column:
    """Term frequency damped by repetition and by the chunk's relative length."""
    if mean_length <= 0:
        return F.lit(BM25_K1 + 1.0)
    norm = BM25_K1 * (1.0 - BM25_B + BM25_B * length / F.lit(mean_length))
    return tf * (BM25_K1 + 1.0) / (tf + norm)


# --- scoring ---------------------------------------------------------------


def score(
    index: TermIndex, terms: DataFrame, stats: DataFrame, extent: Extent, mean_length: float | None = None, chunks: int | None = None
) -> DataFrame:
    """`query_id, chunk_id, score` for every chunk sharing a term with a question.

    With few questions the postings are placed by chunk before they meet the
    broadcast weights. What is shuffled is then the postings, however many
    (question, chunk) pairs come of them, and each pair is summed where it arises.
    """
    if mean_length is None or chunks is None:
        chunks, mean_length = index.totals()
    small = extent.fits(per_row=16, copies=24)
    weights = spread_join(stats.select("term", "idf"), terms, ["term"], fits=small, spread=["term"]).select(
        "term", "query_id", (F.col("idf") * F.col("qtf")).alias("weight")
    )
    tasks = _tasks(terms, chunks * extent.rows)
    postings = index.postings.repartition(tasks, "chunk_id") if small else index.postings
    hits = spread_join(postings, weights, ["term"], fits=small, spread=["chunk_id"])
    part = F.col("weight") * saturation(F.col("tf"), F.col("length"), mean_length)
    return hits.groupBy("query_id", "chunk_id").agg(rounded(F.sum(part), SCORE_DIGITS).alias("score"))


def top_chunks(scores: DataFrame, limit: int) -> DataFrame:
    """Best chunks per question; ties go to the lower id; zero scores are dropped."""
    best = top_ranked(
        scores.where("score > 0"),
        ["query_id"],
        [F.col("score").desc(), F.col("chunk_id").asc()],
        limit,
        spread="chunk_id",
    )
    return best.select("query_id", "rank", "chunk_id", "score")


def search(
    chunks: DataFrame,
    questions: DataFrame,
    limit: int = CANDIDATES,
    index: TermIndex | None = None,
    extent: Extent | None = None,
    library: bool = False,
) -> DataFrame:
    """Ranks chunks for every question of the batch.

    `questions` has `query_id, text`; `chunks` has `chunk_id, text`. Without a
    stored `index` the pass over the corpus keeps only the batch's terms: in
    blocks when the measured batch is small, as joined postings otherwise. With
    `library` the weights need the frequency of every term, which takes a second,
    aggregate-only pass.
    """
    extent = extent or measure(questions.select("query_id", "text"))
    terms = question_terms(questions)
    if index is None and extent.fits(per_row=16, copies=24):
        return top_chunks(_by_blocks(chunks, Lookup.of(terms, "qtf"), limit, library), limit)
    pruned = index.restricted(terms, extent) if index else index_for(chunks, terms, extent)
    total, mean_length = pruned.totals()
    if library:
        stats = library_term_stats(index or build_index(chunks), total)
    else:
        stats = term_stats(pruned, total)
    return top_chunks(score(pruned, terms, stats, extent, mean_length, total), limit)


def _by_blocks(chunks: DataFrame, lookup: Lookup, limit: int, library: bool) -> DataFrame:
    """Scores a batch small enough for every task to hold its terms."""
    rows = materialise(blocks.counted(chunks, tokens(F.col("text")), lookup.vocabulary))
    total, mean_length, df = blocks.totals(rows, len(lookup.vocabulary))
    if library:
        idf = np.log(total - df + 0.5) - np.log(df + 0.5)
        idf = np.where(idf < 0, library_floor(chunks, total), idf)
    else:
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
    return blocks.best(rows, lookup, idf, limit, mean_length)


def library_floor(chunks: DataFrame, total: int) -> float:
    """What replaces a negative weight: a share of the mean over all terms."""
    words = chunks.select(F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("term"))
    frequency = words.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    mean = frequency.agg(F.avg(plain_idf(F.col("df"), total)).alias("mean")).first()["mean"]
    return LIBRARY_IDF_FLOOR * (mean or 0.0)


def keep_zero(ranking: DataFrame, chunks: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """Fills a ranking up to `limit` with zero-scored chunks in id order.

    The benchmark does not drop zero scores. Only the `limit` lowest ids beyond
    those ranked can be needed, so 2 x `limit` ids are enough for any question.
    """
    first = chunks.select("chunk_id").orderBy("chunk_id").limit(2 * limit)
    short = (
        questions.select("query_id")
        .join(ranking.groupBy("query_id").agg(F.max("rank").alias("have")), "query_id", "left")
        .select("query_id", F.coalesce("have", F.lit(0)).alias("have"))
        .where(F.col("have") < limit)
    )
    ids = first.agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))
    padded = short.withColumn("chunk_id", F.explode(ids.select("ids").scalar()))
    missing = padded.join(ranking.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    fill = top_ranked(missing, ["query_id"], [F.col("chunk_id").asc()], limit, rank="extra")
    fill = fill.select(
        "query_id", (F.col("have") + F.col("extra")).alias("rank"), "chunk_id", F.lit(0.0).alias("score")
    ).where(F.col("rank") <= limit)
    return ranking.unionByName(fill)


def index_size(index: TermIndex) -> DataFrame:
    """Bytes a compressed term-by-chunk matrix of the index would take.

    Per posting a 4-byte value and a 4-byte position, per term an 8-byte weight
    and offset (one offset more than terms), per chunk a 4-byte norm.
    """
    postings = index.postings.select(F.count(F.lit(1)).alias("postings")).scalar()
    vocabulary = index.document_frequency().select(F.count(F.lit(1)).alias("vocabulary")).scalar()
    return index.lengths.agg(F.count(F.lit(1)).alias("chunks")).select(
        "chunks",
        vocabulary.alias("vocabulary"),
        postings.alias("postings"),
        (postings * 8 + vocabulary * 8 + 4 + F.col("chunks") * 4).alias("bytes"),
    )
