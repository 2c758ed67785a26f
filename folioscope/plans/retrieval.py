"""Whole retrieval plans over a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.constants import (
    CANDIDATES,
    QUESTION_MIN_CHARS,
    RERANK_BY_DEFAULT,
    RERANK_DEPTH,
    TOP_K,
    TOP_K_MAX,
)
from folioscope.functions.sizing import Extent, measure
from folioscope.operators import dense, lexical
from folioscope.operators.fusion import fuse
from folioscope.operators.rerank import attach, ranking_fits, rerank
from folioscope.plugins import Encoder, HashingEncoder, OverlapScorer, PairScorer
from folioscope.session import materialise


@dataclass(frozen=True)
class Corpus:
    """A chunk table with what retrieval needs to know about it.

    `chunks` has `chunk_id, text` and, where stored, `embedding` and provenance
    columns. Vectors that are not stored are computed by the encoder.
    """

    chunks: DataFrame
    encoder: Encoder = HashingEncoder()
    scorer: PairScorer = OverlapScorer()
    index: lexical.TermIndex | None = None

    def vectors(self) -> DataFrame:
        if "embedding" in self.chunks.columns:
            return self.chunks.select("chunk_id", "embedding")
        return self.encoder.passages(self.chunks.select("chunk_id", "text")).select("chunk_id", "embedding")


def validate(top_k: int) -> None:
    if not 1 <= top_k <= TOP_K_MAX:
        raise ValueError(f"top_k must be between 1 and {TOP_K_MAX}")


def acceptable(questions: DataFrame) -> DataFrame:
    """Questions long enough to be searched for."""
    return questions.where(F.length("text") >= QUESTION_MIN_CHARS)


def lexical_ranking(corpus: Corpus, questions: DataFrame, limit: int, extent: Extent) -> DataFrame:
    return lexical.search(corpus.chunks, questions, limit, corpus.index, extent)


def dense_ranking(corpus: Corpus, questions: DataFrame, limit: int) -> DataFrame:
    vectors = corpus.encoder.questions(questions.select("query_id", "text")).select("query_id", "embedding")
    return dense.search(corpus.vectors(), vectors, limit)


def fused_ranking(
    corpus: Corpus, questions: DataFrame, candidates: int = CANDIDATES, extent: Extent | None = None
) -> DataFrame:
    """Dense and lexical candidates of each question, fused; the dense list first."""
    extent = extent or measure(questions.select("query_id", "text"))
    return fuse(
        [
            dense_ranking(corpus, questions, candidates),
            lexical_ranking(corpus, questions, candidates, extent),
        ]
    )


def search(
    corpus: Corpus,
    questions: DataFrame,
    top_k: int = TOP_K,
    candidates: int = CANDIDATES,
    reranked: bool = RERANK_BY_DEFAULT,
    depth: int = RERANK_DEPTH,
) -> DataFrame:
    """The first `top_k` chunks per question as `query_id, rank, chunk_id, score`."""
    extent = measure(questions.select("query_id", "text"))
    ranking = fused_ranking(corpus, questions, candidates, extent)
    if reranked:
        ranking = rerank(materialise(ranking), questions, corpus.chunks, corpus.scorer, extent, depth)
    return ranking.where(F.col("rank") <= top_k)


def passages(
    corpus: Corpus, questions: DataFrame, top_k: int = TOP_K, reranked: bool = RERANK_BY_DEFAULT
) -> DataFrame:
    """Search results as numbered passages with provenance and text."""
    validate(top_k)
    asked = acceptable(questions)
    extent = measure(asked.select("query_id", "text"))
    ranking = search(corpus, asked, top_k, reranked=reranked)
    columns = [c for c in corpus.chunks.columns if c not in ("chunk_id", "embedding")]
    return attach(ranking, corpus.chunks, columns, ranking_fits(extent, top_k)).withColumnRenamed("rank", "number")
