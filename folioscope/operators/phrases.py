"""Full-text search with quoted phrases and exclusions over stored, positional postings.

A question is read as web searches are written: words, phrases in double quotes, and either with a minus before it. Any
operand may match. A phrase matches where its lexemes stand at the same distances as in the question; stop words of
a phrase count as distance only.

Ranking is by cover density. A cover is a shortest stretch of a chunk in which the question holds: one lexeme, or a
phrase. It counts a tenth, divided by one more than the words in it that no lexeme of the question accounts for. A
stretch that contains another one is no cover.

With operands joined by OR, a stretch also satisfies "not x" if x does not occur in it; so beside an exclusion every
lexeme of the question other than the excluded one is a cover of its own, and chunks with the excluded word still match.
That is what the rewritten query of the published service means. `strict` leaves such chunks out instead, and gives
exclusions no part in the rank. Chunks without any cover are not listed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.constants import CANDIDATES
from folioscope.functions.english import STOP_WORDS, stem, words
from folioscope.functions.sizing import Extent, measure, rounded, spread_join, top_ranked
from folioscope.functions.text import let
from folioscope.operators.fulltext import POSITION_WEIGHT, stems
from folioscope.session import materialise

#: An operand: a phrase, closed or not, or a run without blanks; either after a minus.
OPERAND = r'((?:-\s*)?"[^"]*"?|-\s+[^\s"]+|[^\s"]+)'
BUCKETS = 256


def _placed(buckets: int) -> Column:
    return F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int")


def _places(words: Column) -> Column:
    """`array<struct<lexeme, positions>>` of a word array, put together within the row."""

    def runs(ordered: Column) -> Column:
        def cut(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda at, i: F.struct(
                    F.get(ordered, at)["term"].alias("lexeme"),
                    F.transform(F.slice(ordered, at + 1, F.coalesce(F.get(starts, i + 1), F.size(ordered)) - at), lambda w: w["position"]).alias("positions"),
                ),
            )

        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i)["term"] != F.get(ordered, i - 1)["term"]))
        return let(starts, cut)

    nothing = F.expr("cast(array() as array<struct<lexeme:string,positions:array<int>>>)")
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("position"))))
    return let(placed, lambda p: F.when(F.size(p) == 0, nothing).otherwise(runs(p)))


def _named(chunks: DataFrame) -> DataFrame | None:
    """`_term, _lexeme` of the words that stand in most chunks: as many as may be broadcast."""
    vocabulary = chunks.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    counted = vocabulary.where(~F.col("term").isin(STOP_WORDS)).groupBy("term").agg(F.floor(F.log2(F.count(F.lit(1)))).alias("_size"))
    counted = materialise(counted)
    sizes = counted.groupBy("_size").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("term")).alias("payload")).collect()
    least, rows, payload = None, 0, 0
    for size in sorted(sizes, key=lambda r: -r["_size"]):  # a row per power of two
        rows, payload = rows + size["rows"], payload + size["payload"]
        if not Extent(rows, 2 * payload + 8 * rows).fits(per_row=48):
            break
        least = size["_size"]
    if least is None:
        return None
    named = stems(counted.where(F.col("_size") >= least).select("term"))
    return named.select(F.col("term").alias("_term"), F.col("lexeme").alias("_lexeme"))


@dataclass(frozen=True)
class LexemeIndex:
    """Postings with positions (`chunk_id, lexeme, positions`), stored once so that no search splits or stems a chunk.

    A chunk whose words share a lexeme, or an identifier that several rows have, may have a lexeme in several rows; a
    search puts them together."""

    postings: DataFrame
    english: bool = True  # stems and stop words; otherwise words as they are
    buckets: int | None = None  # lexeme partitions of a stored index

    @staticmethod
    def build(chunks: DataFrame, english: bool = True) -> LexemeIndex:
        """Every word is split off once; a row's postings are made within it and meet no others. Common words are
        stemmed once and looked up, the rest where they stand."""
        rows = chunks.select("chunk_id", F.explode(_places(words(F.col("text")))).alias("_place")).select("chunk_id", "_place.*")
        if english:
            rows = rows.where(~F.col("lexeme").isin(STOP_WORDS)).withColumnRenamed("lexeme", "term")
            named, lexeme = _named(chunks), stem("term")
            if named is not None:
                rows = rows.join(F.broadcast(named), F.col("term") == F.col("_term"), "left")
                lexeme = F.when(F.col("_lexeme").isNotNull(), F.col("_lexeme")).otherwise(lexeme)
            rows = rows.select("chunk_id", lexeme.alias("lexeme"), "positions")
        return LexemeIndex(rows, english)

    def save(self, folder: str, buckets: int = BUCKETS) -> None:
        """Places postings by a hash of the lexeme. Every task writes its own part of a bucket, so no posting is moved."""
        rows = self.postings.withColumn("bucket", _placed(buckets)).sortWithinPartitions("bucket", "lexeme")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)

    @staticmethod
    def load(spark: SparkSession, folder: str, english: bool = True, buckets: int = BUCKETS) -> LexemeIndex:
        return LexemeIndex(spark.read.parquet(folder), english, buckets)

    def needed(self, asked: DataFrame) -> DataFrame:
        """The postings in the partitions that a batch's lexemes fall into, given to the scan as literals."""
        if self.buckets is None:
            return self.postings
        wanted = [r[0] for r in asked.select(_placed(self.buckets)).distinct().collect()]  # `buckets` at most
        return self.postings.where(F.col("bucket").isin(wanted)).drop("bucket")


def operands(questions: DataFrame, english: bool = True, strict: bool = False) -> DataFrame:
    """One row per lexeme of an operand: query_id, operand, lexeme, offset from the operand's first lexeme, n (lexemes of
    the operand), last (largest offset), negative, and whether an occurrence of the lexeme is a cover of its own."""
    tokens = questions.select("query_id", F.posexplode(F.regexp_extract_all("text", F.lit(OPERAND), 1)).alias("_at", "_token"))
    negative = F.startswith("_token", F.lit("-"))
    rows = tokens.select(
        "query_id", "_at", negative.alias("negative"), (negative | F.contains("_token", F.lit('"'))).alias("_whole"),
        F.posexplode(words(F.col("_token"))).alias("_place", "term"),
    )
    rows = rows.where(~F.col("term").isin(STOP_WORDS)).withColumn("lexeme", stem("term")) if english else rows.withColumn("lexeme", F.col("term"))
    rows = rows.withColumn("operand", F.struct("_at", F.when(F.col("_whole"), 0).otherwise(F.col("_place")).alias("_place")))
    own, question = Window.partitionBy("query_id", "operand"), Window.partitionBy("query_id")
    rows = rows.withColumns({"offset": F.col("_place") - F.min("_place").over(own), "n": F.count(F.lit(1)).over(own).cast("int")})
    rows = rows.withColumn("last", F.max("offset").over(own))
    positive = ~F.col("negative") & (F.col("n") == 1)
    if strict:
        return rows.select("query_id", "operand", "lexeme", "offset", "n", "last", "negative", positive.alias("cover"))
    # What is excluded: a lexeme, or null for a phrase.
    excluded = F.collect_list(F.when(F.col("negative"), F.struct(F.when(F.col("n") == 1, F.col("lexeme")).alias("lexeme")))).over(question)
    freed = F.exists(excluded, lambda e: e["lexeme"].isNull() | (e["lexeme"] != F.col("lexeme")))
    return rows.select("query_id", "operand", "lexeme", "offset", "n", "last", "negative", (positive | freed).alias("cover"))


def _covers(hits: Column) -> Column:
    """Start, end and sign of every place where a phrase stands whole, from the hits of one question in one chunk."""

    def starts(first: Column) -> Column:
        def whole(members: Column) -> Column:
            found = F.filter(first["positions"], lambda p: F.forall(members, lambda m: F.array_contains(m["positions"], p + m["offset"])))
            return F.when(F.size(members) == first["n"], found).otherwise(F.array().cast("array<int>"))

        places = let(F.filter(hits, lambda m: m["operand"] == first["operand"]), whole)
        return F.transform(places, lambda p: F.struct(p.alias("start"), (p + first["last"]).alias("end"), first["negative"].alias("negative")))

    heads = F.filter(hits, lambda h: (h["n"] > 1) & (h["offset"] == 0))
    return F.array_distinct(F.flatten(F.transform(heads, starts)))


def scores(index: LexemeIndex, questions: DataFrame, extent: Extent | None = None, strict: bool = False) -> DataFrame:
    """`query_id, chunk_id, score` of every chunk with a cover. The postings that a batch asks for meet by chunk, each
    once; what questions make of them stays in the task where the batch may be broadcast. What meets in a group is one
    chunk's part of a question."""
    extent = extent or measure(questions.select("query_id", "text"))
    asked = operands(questions, index.english, strict)
    fits = extent.fits(per_row=64, copies=24)
    wanted = asked.select("lexeme").distinct()
    held = spread_join(index.needed(asked), wanted, ["lexeme"], fits=fits, spread=["chunk_id"], how="left_semi")
    held = held.repartition("chunk_id").groupBy("chunk_id", "lexeme")
    held = held.agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
    hits = spread_join(held, asked, ["lexeme"], fits=fits, spread=["chunk_id"])
    hit = F.struct("operand", "offset", "n", "last", "negative", "cover", "positions")
    rows = hits.groupBy("query_id", "chunk_id").agg(F.collect_list(hit).alias("hits"), (F.count_if(F.col("n") > 1) > 1).alias("_several"))
    covers = _covers(F.col("hits"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,negative:boolean>>)")
    single = F.array_distinct(F.flatten(F.transform(F.filter("hits", lambda h: h["cover"]), lambda h: h["positions"])))
    rows = rows.withColumns({"single": single, "phrases": F.when(F.col("_several"), covers).otherwise(none)})
    every = F.array_distinct(F.flatten(F.transform("hits", lambda h: h["positions"])))
    rows = rows.withColumn("every", F.when(F.size("phrases") > 0, every))
    if strict:
        banned = F.exists("hits", lambda h: h["negative"] & (h["n"] == 1)) | F.exists("phrases", lambda p: p["negative"])
        rows = rows.where(~banned)
    positive = F.filter("phrases", lambda p: ~p["negative"])
    shortest = F.filter(
        positive,
        lambda p: ~F.exists("single", lambda s: (s >= p["start"]) & (s <= p["end"]))
        & ~F.exists(positive, lambda o: (o["start"] >= p["start"]) & (o["end"] <= p["end"]) & ((o["start"] > p["start"]) | (o["end"] < p["end"]))),
    )
    rows = rows.withColumn("shortest", shortest)
    noise = lambda p: p["end"] - p["start"] + 1 - F.size(F.filter("every", lambda e: (e >= p["start"]) & (e <= p["end"])))
    phrases = F.aggregate("shortest", F.lit(0.0), lambda total, p: total + F.lit(1.0) / (noise(p) + 1))
    score = rounded((F.size("single") + phrases) * F.lit(POSITION_WEIGHT), 6)
    return rows.select("query_id", "chunk_id", score.alias("score")).where("score > 0")


def search(
    index: LexemeIndex, questions: DataFrame, limit: int = CANDIDATES, extent: Extent | None = None, strict: bool = False
) -> DataFrame:
    """Best chunks of every question: `query_id, rank, chunk_id, score`."""
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    best = top_ranked(scores(index, questions, extent, strict), ["query_id"], order, limit, spread="chunk_id")
    return best.select("query_id", "rank", "chunk_id", "score")
