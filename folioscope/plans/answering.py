"""From questions to checked answers: route, plan, retrieve, answer, verify."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.constants import CONTEXT_PASSAGES, RERANK_BY_DEFAULT, TOP_K
from folioscope.functions.sizing import measure, spread_join
from folioscope.operators import cache as answer_cache
from folioscope.operators import citations, context, events, planning
from folioscope.operators.rerank import attach, ranking_fits
from folioscope.plans.retrieval import Corpus, acceptable, search, validate
from folioscope.plugins import ExtractiveProvider, Provider
from folioscope.session import materialise

PROVENANCE = ["paper_id", "section", "paragraph", "text"]


def gather(
    corpus: Corpus,
    questions: DataFrame,
    top_k: int = TOP_K,
    reranked: bool = RERANK_BY_DEFAULT,
    cap: int = CONTEXT_PASSAGES,
    interleave: bool = False,
) -> DataFrame:
    """`query_id, number, chunk_id, score`: the context of every question."""
    validate(top_k)
    sub_queries = planning.numbered(planning.plan(acceptable(questions)))
    ranking = search(corpus, sub_queries.select("query_id", "text"), top_k, reranked=reranked)
    return planning.merge(ranking, sub_queries, cap, interleave)


def with_prompts(corpus: Corpus, questions: DataFrame, found: DataFrame) -> DataFrame:
    """`query_id, question, passages, prompt` for every question, also for one
    that found nothing. `corpus.chunks` carries the provenance columns."""
    extent = measure(questions.select("query_id", "text"))
    listed = context.passage_arrays(
        attach(found, corpus.chunks, PROVENANCE, ranking_fits(extent, CONTEXT_PASSAGES))
    )
    empty = F.expr(
        "cast(array() as array<struct<number:bigint,paper_id:string,section:string,paragraph:bigint,text:string>>)"
    )
    asked = questions.select("query_id", F.col("text").alias("question"))
    joined = asked.join(listed, "query_id", "left").withColumn("passages", F.coalesce("passages", empty))
    return joined.withColumn("prompt", context.prompt(F.col("question"), F.col("passages")))


def answer(
    corpus: Corpus,
    questions: DataFrame,
    provider: Provider | None = None,
    top_k: int = TOP_K,
    reranked: bool = RERANK_BY_DEFAULT,
    entries: DataFrame | None = None,
    capacity: int = answer_cache.CACHE_CAPACITY,
) -> DataFrame:
    """Checked answers, one row per question; the model is asked once for each.

    Answers are written down as they come, so that whatever reads them later,
    checks, storage or event streams, sees the same ones.

    With cache `entries` (`seq, question, answer, embedding`) every question is
    looked up first in those that a cache of `capacity` still holds. A hit takes the stored answer and reaches
    no model; its citations are checked against the new question's passages.
    """
    provider = provider or ExtractiveProvider()
    prompts = with_prompts(corpus, questions, gather(corpus, questions, top_k, reranked))
    if entries is None:
        answered = materialise(provider.complete(prompts).withColumn("cached", F.lit(False)))
    else:
        entries = materialise(answer_cache.surviving(entries, capacity))
        vectors = corpus.encoder.questions(questions.select("query_id", "text"))
        hits = answer_cache.lookup(vectors, entries).where("hit").select("query_id", "seq")
        stored = spread_join(hits, entries.select("seq", "answer"), ["seq"], fits=True, spread=["query_id"])
        looked_up = materialise(prompts.join(stored.select("query_id", "answer"), "query_id", "left"))
        replayed = looked_up.where("answer is not null").withColumn("cached", F.lit(True))
        fresh = materialise(provider.complete(looked_up.where("answer is null").drop("answer")))
        answered = replayed.unionByName(fresh.withColumn("cached", F.lit(False)))
    return citations.check(answered.select("query_id", "question", "passages", "answer", "cached"))


def stored_entries(
    corpus: Corpus, checked: DataFrame, entries: DataFrame | None = None, capacity: int | None = None
) -> DataFrame:
    """The cache after a batch: fresh answers appended in question order, the
    oldest dropped. The sequence continues behind the entries already held."""
    fresh = checked.where(~F.col("cached")).select("query_id", "question", "answer")
    start = 0 if entries is None else (entries.agg(F.max("seq")).first()[0] or 0) + 1
    added = corpus.encoder.questions(fresh, "question").select(
        (F.col("query_id") + start).alias("seq"), "question", "answer", "embedding"
    )
    everything = added if entries is None else entries.select(*added.columns).unionByName(added)
    return answer_cache.surviving(everything, capacity or answer_cache.CACHE_CAPACITY)


def stream_events(checked: DataFrame) -> DataFrame:
    """Answers as ordered events: passages, tokens, citations."""
    return events.event_rows(checked)
