"""From paper metadata and source archives to the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import chunks as chunking
from folioscope.operators.paragraphs import paragraphs
from folioscope.plugins import Encoder, HashingEncoder
from folioscope.session import materialise
from folioscope.sources.archives import flatten, member_array
from folioscope.sources.markup import latex_text
from folioscope.sources.store import Store, unseen


def chunk_sources(sources: DataFrame) -> DataFrame:
    """Chunks of `paper_id, latex`, with identifiers."""
    text = sources.select("paper_id", latex_text(F.col("latex")).alias("text"))
    return chunking.with_ids(chunking.chunk(paragraphs(text, "paper_id"), "paper_id"), "paper_id")


def ingest(store: Store, papers: DataFrame, archives: DataFrame, batch: int, encoder: Encoder | None = None) -> DataFrame:
    """Stores the papers that are new, have a source and yield at least one chunk.

    `papers` as read from a feed, `archives` as `paper_id, content`. New is what no
    other batch holds, so a batch can be repeated with the same result, finished or
    not. Papers are matched by identifier alone, the longest archive counts where
    several have arrived, and contents are read for those only. Returns one row of
    counts: papers stored and skipped, chunks written.
    """
    encoder, since = encoder or HashingEncoder(), store.version()
    fresh = materialise(unseen(papers, store.stored_ids(but=batch)))
    sized = archives.select("paper_id", F.octet_length("content").alias("_size"), F.xxhash64("content").alias("_hash"))
    best = sized.groupBy("paper_id").agg(F.max(F.struct("_size", "_hash")).alias("_best"))
    chosen = best.join(fresh.select("paper_id"), "paper_id", "left_semi").select("paper_id", "_best.*")
    # The few columns above are all that is shuffled; contents meet them by a hash of what they are.
    marked = archives.select("paper_id", "content", F.octet_length("content").alias("_size"), F.xxhash64("content").alias("_hash"))
    sources = (
        marked.join(chosen, ["paper_id", "_size", "_hash"], "left_semi")
        .dropDuplicates(["paper_id", "_size", "_hash"])
        .select("paper_id", flatten(member_array(F.col("content"))).alias("latex"))
        .where("latex <> ''")
    )
    store.write(fresh, encoder.passages(chunk_sources(sources)), batch, since)
    stored = store.papers().where(F.col("batch") == batch)
    chunks = store.chunks().where(F.col("batch") == batch)
    offered = fresh.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    count = stored.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return chunks.agg(F.count(F.lit(1)).alias("chunks")).select(
        count.alias("stored"), (offered - count).alias("skipped"), "chunks"
    )
