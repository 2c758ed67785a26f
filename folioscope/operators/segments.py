"""BM25 over immutable index segments, with blocks that cannot reach the best k left unscored.

Every ingested batch becomes one segment. Its chunks are dealt into groups of like length, and a block holds one term's
postings in one group together with what bounds them: the largest frequency and the shortest length. Statistics add up
over segments. Removing chunks writes tombstones, small segments can be merged, and nothing written is ever changed:
what is visible is said by numbered commits, each of which exists once. A writer that has read an older commit than the
last one fails instead of undoing the other's work.

A search bounds each (question, group) by the sum over its terms, scores the most promising groups, takes the k-th best
score as the threshold, and scores those of the other groups whose bound reaches it. The result is exact.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.constants import CANDIDATES
from folioscope.functions.sizing import Extent, measure, rounded, spread_join, top_ranked
from folioscope.functions.text import bags, question_terms
from folioscope.operators.lexical import BUCKETS, SCORE_DIGITS, _bucket, _tasks, saturation, smoothed_idf, top_chunks
from folioscope.session import materialise
from folioscope.sources.commits import Commits

#: Chunks a group is meant to hold, groups scored to find the threshold, and what a bound may lack by rounding.
GROUP, FIRST, SLACK = 256, 4, 1e-6


@dataclass(frozen=True)
class Segment:
    name: str
    chunks: int
    length: int


@dataclass(frozen=True)
class State:
    """What one commit shows: segments, and tombstones with what they take off the totals."""

    number: int = 0
    segments: list[Segment] = field(default_factory=list)
    removed: list[Segment] = field(default_factory=list)

    def totals(self) -> tuple[int, float]:
        chunks = sum(s.chunks for s in self.segments) - sum(s.chunks for s in self.removed)
        length = sum(s.length for s in self.segments) - sum(s.length for s in self.removed)
        return chunks, length / chunks if chunks else 0.0


class SegmentedIndex:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    # --- commits ---

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, f"{self.folder}/commits")

    def state(self) -> State:
        """The last commit that can be read."""
        for number in reversed(self.commits.numbers()):
            content = self.commits.read(number)
            if content:
                return State(number, [Segment(**s) for s in content["segments"]], [Segment(**s) for s in content["removed"]])
        return State()

    def _commit(self, before: State, segments: list[Segment], removed: list[Segment]) -> None:
        content = {"segments": [s.__dict__ for s in segments], "removed": [s.__dict__ for s in removed]}
        self.commits.create(before.number + 1, content)

    # --- writing ---

    def add(self, chunks: DataFrame) -> None:
        """One more segment, of chunks (chunk_id, text) that are not in the index."""
        before = self.state()
        rows = materialise(bags(chunks, "chunk_id", "text"))
        segment = self._write(rows.select("chunk_id", "length"), rows.selectExpr("chunk_id", "length", "inline(terms) as (term, tf)"))
        self._commit(before, [*before.segments, segment], before.removed)

    def remove(self, ids: DataFrame) -> None:
        """Chunks with these ids (chunk_id) are no longer found. They may be added anew."""
        before = self.state()
        if not before.segments:
            return
        gone = self._lengths(before).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
        name = uuid.uuid4().hex
        gone.write.parquet(f"{self.folder}/removed/{name}")
        count, length = self._sums(self.spark.read.parquet(f"{self.folder}/removed/{name}"))
        if count:
            self._commit(before, before.segments, [*before.removed, Segment(name, count, length)])

    def merge(self, below: int) -> None:
        """Puts segments of fewer than `below` chunks into one, without what has been removed from any."""
        before = self.state()
        small = [s for s in before.segments if s.chunks < below]
        if len(small) < 2:
            return
        part = State(before.number, small, before.removed)
        postings = self._alive(self._blocks(small).selectExpr("segment", "term", "inline(entries)"), before)
        segment = self._write(self._lengths(part).select("chunk_id", "length"), postings.select("chunk_id", "length", "term", "tf"))
        kept = [s for s in before.segments if s not in small]
        removed = self._removed(before)
        rest = []
        if removed is not None and kept:
            left = removed.where(F.col("segment").isin([s.name for s in kept]))
            count, length = self._sums(left)
            if count:
                name = uuid.uuid4().hex
                left.write.parquet(f"{self.folder}/removed/{name}")
                rest = [Segment(name, count, length)]
        self._commit(before, [*kept, segment], rest)

    def _sums(self, rows: DataFrame) -> tuple[int, int]:
        count, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return int(count), int(length)

    def _write(self, lengths: DataFrame, postings: DataFrame) -> Segment:
        name = f"s{uuid.uuid4().hex}"
        path = f"{self.folder}/lengths/segment={name}"
        lengths.write.parquet(path)
        count, length = self._sums(self.spark.read.parquet(path))
        # Alike in length to a factor of 1.4, so that one bound fits the postings of a group. Rows that share an
        # identifier share a group, so that a chunk's score is summed within one.
        twice = lengths.groupBy(F.col("chunk_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.max("length").alias("_longest"))
        twice = materialise(twice.where("_n > 1").drop("_n"))
        twice = F.broadcast(twice) if measure(twice).fits() else twice
        postings = postings.join(twice, F.col("chunk_id").eqNullSafe(F.col("_id")), "left").withColumn("_longest", F.coalesce("_longest", "length")).drop("_id")
        kind = F.floor(F.log2(F.col("_longest") + 1) * 2).cast("int")
        deals = max(1, count // GROUP // 8)
        group = kind * deals + F.pmod(F.xxhash64("chunk_id"), F.lit(deals)).cast("int")
        rows = postings.withColumn("grp", group).drop("_longest")
        rows = rows.withColumns({"bucket": _bucket(self.buckets), "_salt": F.pmod(F.col("grp"), F.lit(32))})
        rows = rows.repartition(_tasks(rows, length), "bucket", "_salt")
        blocks = rows.groupBy("bucket", "_salt", "term", "grp").agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"),
            F.collect_list(F.struct("chunk_id", "tf", "length")).alias("entries"),
        )
        placed = blocks.drop("_salt").sortWithinPartitions("bucket", "term", "grp")
        placed.write.partitionBy("bucket").parquet(f"{self.folder}/blocks/segment={name}")
        return Segment(name, count, length)

    # --- reading ---

    def _blocks(self, segments: list[Segment]) -> DataFrame:
        return self._part("blocks", segments)

    def _part(self, kind: str, segments: list[Segment]) -> DataFrame:
        """The files of the given segments alone; their folder's name is a column."""
        base = f"{self.folder}/{kind}"
        return self.spark.read.option("basePath", base).parquet(*[f"{base}/segment={s.name}" for s in segments])

    def _removed(self, state: State) -> DataFrame | None:
        if not state.removed:
            return None
        return self.spark.read.parquet(*[f"{self.folder}/removed/{r.name}" for r in state.removed])

    def _alive(self, rows: DataFrame, state: State) -> DataFrame:
        removed = self._removed(state)
        return rows if removed is None else rows.join(removed.select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti")

    def _lengths(self, state: State) -> DataFrame:
        return self._alive(self._part("lengths", state.segments), state).select("chunk_id", "length", "segment")


@dataclass(frozen=True)
class Plan:
    """A batch laid against an index: what may be scored, and how much of it each group holds."""

    blocks: DataFrame  # segment, grp, term, entries of the batch's terms
    weights: DataFrame  # query_id, term, weight
    bounds: DataFrame  # query_id, segment, grp, bound, postings
    mean_length: float
    small: bool
    tasks: int  # that score a batch


def planned(index: SegmentedIndex, state: State, questions: DataFrame, extent: Extent) -> Plan:
    terms = materialise(question_terms(questions))
    small = extent.fits(per_row=16, copies=24)
    wanted = [r[0] for r in terms.select(_bucket(index.buckets)).distinct().collect()]  # as many as buckets at most
    blocks = index._blocks(state.segments).where(F.col("bucket").isin(wanted)).drop("bucket")
    blocks = spread_join(blocks, terms.select("term").distinct(), ["term"], small, ["grp"], how="left_semi")
    facts = materialise(blocks.select("segment", "grp", "term", "n", "most", "least"))
    total, mean_length = state.totals()
    found = facts.groupBy("term").agg(F.sum("n").alias("df"))
    if state.removed:
        held = blocks.selectExpr("segment", "term", "inline(entries)")
        gone = held.join(index._removed(state).select("segment", "chunk_id"), ["segment", "chunk_id"], "left_semi")
        found = found.join(gone.groupBy("term").agg(F.count(F.lit(1)).alias("_gone")), "term", "left")
        found = found.select("term", (F.col("df") - F.coalesce("_gone", F.lit(0))).alias("df"))
    weight = smoothed_idf(F.col("df"), total) * F.col("qtf")
    weights = materialise(spread_join(terms, found, ["term"], small, ["query_id"]).select("query_id", "term", weight.alias("weight")))
    top = F.col("weight") * saturation(F.col("most"), F.col("least"), mean_length)
    bounds = spread_join(facts, weights, ["term"], small, ["grp"]).groupBy("query_id", "segment", "grp").agg(
        F.sum(top).alias("bound"), F.sum("n").alias("postings")
    )
    return Plan(blocks.select("segment", "grp", "term", "entries"), weights, materialise(bounds), mean_length, small, _tasks(terms, total * extent.rows))


def _scored(plan: Plan, index: SegmentedIndex, state: State, pairs: DataFrame) -> DataFrame:
    """`query_id, chunk_id, score` of every chunk of the given groups that shares a term with the question.

    With few questions the groups asked for are broadcast with who asks for them, and the blocks of a group are brought
    together once: what is shuffled is the postings, and each pair of a question and a chunk is summed where it arises.
    """
    part: Column = F.col("weight") * saturation(F.col("tf"), F.col("length"), plan.mean_length)
    groups = materialise(pairs.groupBy("segment", "grp").agg(F.collect_set("query_id").alias("_asking"))) if plan.small else None
    if groups is not None and measure(groups).fits():
        blocks = plan.blocks.join(F.broadcast(groups), ["segment", "grp"]).repartition(plan.tasks, "segment", "grp")
        hits = blocks.join(F.broadcast(plan.weights), "term").where(F.array_contains("_asking", F.col("query_id")))
        hits = hits.selectExpr("segment", "grp", "query_id", "weight", "inline(entries)")
        sums = hits.groupBy("segment", "grp", "query_id", "chunk_id").agg(rounded(F.sum(part), SCORE_DIGITS).alias("score"))
        return index._alive(sums, state).select("query_id", "chunk_id", "score")
    asked = pairs.select("query_id", "segment", "grp").join(F.broadcast(plan.weights) if plan.small else plan.weights, "query_id")
    hits = plan.blocks.join(asked, ["segment", "grp", "term"]).selectExpr("query_id", "segment", "weight", "inline(entries)")
    hits = index._alive(hits, state)
    return hits.groupBy("query_id", "chunk_id").agg(rounded(F.sum(part), SCORE_DIGITS).alias("score"))


def _passes(index: SegmentedIndex, state: State, questions: DataFrame, limit: int, extent: Extent) -> tuple[Plan, DataFrame, DataFrame, DataFrame]:
    """The plan, the groups looked at first, their scores, and the other groups that may still hold one of the best."""
    plan = planned(index, state, questions, extent)
    first = materialise(top_ranked(plan.bounds, ["query_id"], [F.col("bound").desc(), F.col("segment"), F.col("grp")], FIRST, rank="_r"))
    scores = materialise(_scored(plan, index, state, first))
    best = top_ranked(scores, ["query_id"], [F.col("score").desc()], limit, rank="_r")
    level = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == limit, F.min("score")).alias("_level"))
    rest = plan.bounds.join(first.select("query_id", "segment", "grp"), ["query_id", "segment", "grp"], "left_anti")
    rest = rest.join(level, "query_id", "left").where(F.col("bound") + SLACK >= F.coalesce("_level", F.lit(0.0)))
    return plan, first, scores, rest


def search(index: SegmentedIndex, questions: DataFrame, limit: int = CANDIDATES, extent: Extent | None = None) -> DataFrame:
    """The best chunks of every question, as a search over one whole index would rank them."""
    state = index.state()
    extent = extent or measure(questions.select("query_id", "text"))
    if not state.segments:
        kinds = f"query_id {questions.schema['query_id'].dataType.simpleString()}, rank long, chunk_id long, score double"
        return questions.sparkSession.createDataFrame([], kinds)
    plan, _, scores, rest = _passes(index, state, questions, limit, extent)
    return top_chunks(scores.unionByName(_scored(plan, index, state, rest)), limit)


def pruning(index: SegmentedIndex, questions: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """One row: postings of the batch's terms counted per question, and how many of them a search scores."""
    state = index.state()
    plan, first, _, rest = _passes(index, state, questions, limit, measure(questions.select("query_id", "text")))
    scored = first.select("postings").unionByName(rest.select("postings")).agg(F.coalesce(F.sum("postings"), F.lit(0)).alias("scored"))
    return plan.bounds.agg(F.sum("postings").alias("postings")).crossJoin(scored)  # one row each
