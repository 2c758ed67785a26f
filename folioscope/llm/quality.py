"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

The sketch is a histogram over logarithmic buckets (relative error `ACCURACY`). Counts of buckets add up exactly, so
sketches merge in any order, the hot source is combined before the shuffle, and the cutoffs never depend on
partitioning. Groups with too few documents for a cutoff use the merged sketch of their language, then of everything.

A cutoff comes from its group's quantiles alone: the outer one, times the ratio of outer to middle, `WIDTH` times over.
A text is rejected if its share lies beyond the cutoff by `ERRORS` standard errors of its count, so a single repeated line
or symbol rejects nothing, however uniform the group, and many do in a group that has none.

* Null or empty text: no words, fails the fixed floor. Null language or source: a group of its own.
* Repeated rows are judged alike, each counted. An empty table gives an empty result. Other columns are kept in
  `filter_documents`; the names the operator adds win.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.sizing import BROADCAST_LIMIT
from folioscope.llm.common import BLANKS, extended, stored

#: What a text is measured by: what is counted, what it is counted among, and whether small values are as suspicious as
#: large ones. One is added to both counts, so that a text without any has the share its length lets one see.
METRICS = {
    "symbol_share": ("n_symbols", "word_chars", False),
    "dup_line_share": ("n_dup_lines", "n_lines", False),
    "repeat_share": ("n_repeat_words", "n_words", False),
    "word_length": ("word_chars", "n_words", True),
}
#: What one event adds to a count, if more than one: a repeat is two windows of three words at least.
UNITS = {"n_repeat_words": 6}
#: A cutoff lies beyond the outer quantile by the ratio of outer to middle one, so many times over.
WIDTH = 4
MIDDLE, OUTER = 0.5, 0.75
#: Standard errors of its count by which a text must lie beyond a cutoff.
ERRORS = 3
#: Documents a group needs for cutoffs of its own.
ENOUGH = 100
ACCURACY = 0.01
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOLS = "#*$%&|<>"
BLANK_CHARS = " \t\n\v\f\r"


def measured(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, BLANK_CHARS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(BLANK_CHARS)]
    repeated = 0
    if len(words) >= 3:
        runs = list(zip(words, words[1:], words[2:]))
        if len(found := set(runs)) < len(runs):
            often = {run for run, n in Counter(runs).items() if n > 1} if len(found) > 1 else found
            end = 0  # first position that is not counted yet
            for i, run in enumerate(runs):
                if run in often:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns and the counts of every text."""
    fields = [f for f in docs.schema.fields if f.name in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measured(text) for text in batch.column("_text").to_pylist()]
            counts = [pa.array([row[i] for row in rows], pa.int64()) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in fields), *counts], names=[*(f.name for f in fields), *COUNTS]
            )

    given = docs.select(*[F.col(f"`{f.name}`") for f in fields], F.col("text").alias("_text"))
    return given.mapInArrow(work, extended(given.drop("_text"), ", ".join(f"{name} long" for name in COUNTS)))


def with_metrics(counts: DataFrame) -> DataFrame:
    columns = {name: (F.col(count) + 1) / (F.col(among) + 1) for name, (count, among, _) in METRICS.items()}
    columns["base_failed"] = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumns(columns)


def bucket(value: Column) -> Column:
    """Number of the logarithmic bucket; zero has one below all others."""
    step = F.lit((1 + ACCURACY) / (1 - ACCURACY))
    return F.when(value <= 0, F.lit(-(1 << 30))).otherwise(F.ceil(F.round(F.ln(value) / F.ln(step), 9)).cast("int"))


def _value(number: Column) -> Column:
    step = (1 + ACCURACY) / (1 - ACCURACY)
    middle = F.pow(F.lit(step), number.cast("double")) * (2 / (1 + step))
    return F.when(number == -(1 << 30), 0.0).otherwise(F.round(middle, 9))


def sketches(metrics: DataFrame) -> DataFrame:
    """One row per language, source, metric and occupied bucket. Only documents that pass the fixed floor count."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in METRICS])
    rows = metrics.where(~F.col("base_failed")).select("lang", "source", F.inline(pairs))
    return rows.groupBy("lang", "source", "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    merged = merged.withColumns(
        {"_upto": F.sum("n").over(group.orderBy("bucket")), "_all": F.sum("n").over(group)}
    )

    def at(share: float) -> Column:
        return F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(share)), F.col("bucket")))

    return merged.groupBy(*keys, "metric").agg(
        F.max("_all").alias("_n"),
        _value(at(1 - OUTER)).alias("_low"),
        _value(at(MIDDLE)).alias("_middle"),
        _value(at(OUTER)).alias("_high"),
    )


def _beyond(outer: Column, middle: Column) -> Column:
    value = outer
    for _ in range(WIDTH):
        value = value * (outer / middle)
    return value


def _cutoffs(quantiles: DataFrame, keys: list[str], level: int) -> DataFrame:
    columns = []
    for metric, (_, _, both) in METRICS.items():
        mine = F.col("metric") == metric
        columns.append(F.max(F.when(mine, _beyond(F.col("_high"), F.col("_middle")))).alias(f"{metric}_max"))
        if both:
            columns.append(F.max(F.when(mine, _beyond(F.col("_low"), F.col("_middle")))).alias(f"{metric}_min"))
    wide = quantiles.groupBy(*keys).agg(F.max("_n").alias("_n"), *columns)
    names = [c for c in wide.columns if c.endswith(("_max", "_min"))]
    return wide.select(*keys, F.struct("_n", *names).alias(f"_cut{level}"))


def thresholds(metrics: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """One row per (lang, source): the cutoffs in force and the level (0 own group, 1 language, 2 all) they come from."""
    own = stored(sketches(metrics))
    groups = _cutoffs(_quantiles(own, ["lang", "source"]), ["lang", "source"], 0)
    languages = _cutoffs(_quantiles(own, ["lang"]), ["lang"], 1).withColumnRenamed("lang", "_lang")
    everything = _cutoffs(_quantiles(own, []), [], 2)
    every = metrics.select("lang", "source").distinct()
    every = every.withColumnsRenamed({"lang": "_l", "source": "_s"})
    rows = every.join(groups, F.col("_l").eqNullSafe(F.col("lang")) & F.col("_s").eqNullSafe(F.col("source")), "left")
    rows = rows.join(languages, F.col("_l").eqNullSafe(F.col("_lang")), "left")
    rows = rows.join(F.broadcast(everything), F.lit(True), "left")  # one row
    has = lambda level: F.coalesce(F.col(f"_cut{level}._n"), F.lit(0)) >= enough
    level = F.when(has(0), 0).when(has(1), 1).otherwise(2)
    chosen = F.when(has(0), F.col("_cut0")).when(has(1), F.col("_cut1")).otherwise(F.col("_cut2"))
    return rows.select("_l", "_s", level.alias("cutoff_level"), chosen.alias("_cut"))


def _outside() -> Column:
    tests = []
    for metric, (count, among, both) in METRICS.items():
        unit = UNITS.get(count, 1)
        error = F.lit(float(ERRORS)) * F.sqrt((unit * (F.col(count) + unit)).cast("double"))
        least = F.greatest(F.col(count) - error, F.lit(0.0)) + 1
        tests.append(least / (F.col(among) + 1) > F.col(f"_cut.{metric}_max"))
        if both:
            tests.append((F.col(count) + error + 1) / (F.col(among) + 1) < F.col(f"_cut.{metric}_min"))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def _decided(metrics: DataFrame, cutoffs: DataFrame) -> DataFrame:
    cutoffs = stored(cutoffs)
    groups = cutoffs.count()  # about 200 bytes each
    side = F.broadcast(cutoffs) if groups * 256 <= BROADCAST_LIMIT else cutoffs
    # Beyond the limit the shuffled join's hot keys are split by adaptive execution: the other side is unique.
    joined = metrics.join(side, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~_outside())


def judge(docs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """Counts, metrics and verdict per document: doc_id, lang, source, counts, metrics, base_failed, kept."""
    metrics = with_metrics(stored(with_counts(docs, ["doc_id", "lang", "source"])))
    return _decided(metrics, thresholds(metrics, enough)).drop("_l", "_s", "_cut")


def filter_documents(docs: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """The documents that are kept, whole and with all their columns.

    Texts are measured twice, once for the sketches and once where they are filtered, instead of being shuffled.
    """
    narrow = stored(with_counts(docs, ["lang", "source"]))
    cutoffs = thresholds(with_metrics(narrow), enough)
    clash = {c: f"_in_{c}" for c in docs.columns if c in {*COUNTS, *METRICS, "base_failed", "kept", "cutoff_level", "_text", "_cut", "_l", "_s"}}
    rows = docs.withColumnsRenamed(clash)
    metrics = with_metrics(with_counts(rows, rows.columns))
    kept = _decided(metrics, cutoffs).where("kept")
    back = {new: old for old, new in clash.items()}
    return kept.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in rows.columns])


def words_of(text: str) -> list[str]:
    """The words by the stated pattern; used by tests."""
    return re.findall(rf"[^{BLANKS}]+", text)
