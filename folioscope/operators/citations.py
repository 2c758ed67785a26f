"""Citations in answers: extraction, resolution against passages, grounding.

An answer and its passages are one row, so the whole check is a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.constants import MARKER_PATTERN, REFUSAL
from folioscope.functions.text import answer_sentences, strip_space


def is_refusal(answer: Column) -> Column:
    return strip_space(answer).startswith(REFUSAL)


def markers(text: Column) -> Column:
    """Cited numbers in order; one too long for an integer is null."""
    return F.transform(marker_texts(text), lambda d: d.try_cast("long"))


def marker_texts(text: Column) -> Column:
    """The digits of all markers, in order."""
    return F.regexp_extract_all(text, F.lit(MARKER_PATTERN), 1)


def check(answers: DataFrame) -> DataFrame:
    """Adds what an answer cites to rows of `answer, passages`.

    Columns: `refused`, `sentences`, `uncited`, `citations` (one entry per
    distinct valid number, ascending, with the passage's provenance), `invalid`
    (numbers naming no passage as text without leading zeros, in order, repeats
    kept, however many digits they have), `grounded`.
    A refusal has no sentences and its citations are not looked at.
    """
    none = F.expr("cast(array() as array<string>)")
    read = answers.withColumn("refused", is_refusal(F.col("answer"))).withColumn(
        "_sentences", F.when(F.col("refused"), none).otherwise(answer_sentences(F.col("answer")))
    )
    cited = read.withColumn("_numbers", F.transform("_sentences", marker_texts))
    names = F.coalesce(F.size("passages"), F.lit(0))

    def valid(digits: Column) -> Column:
        number = digits.try_cast("long")
        return F.coalesce((number >= 1) & (number <= names), F.lit(False))

    flat = cited.withColumn("_flat", F.flatten("_numbers"))
    resolved = F.transform(
        F.array_sort(F.array_distinct(F.transform(F.filter("_flat", valid), lambda d: d.cast("long")))),
        lambda n: F.struct(
            n.alias("number"),
            F.element_at("passages", n.cast("int"))["paper_id"].alias("paper_id"),
            F.element_at("passages", n.cast("int"))["section"].alias("section"),
            F.element_at("passages", n.cast("int"))["paragraph"].alias("paragraph"),
        ),
    )
    counted = flat.select(
        *answers.columns,
        "refused",
        F.size("_sentences").cast("long").alias("sentences"),
        F.size(F.filter("_numbers", lambda n: F.size(n) == 0)).cast("long").alias("uncited"),
        resolved.alias("citations"),
        F.transform(F.filter("_flat", lambda d: ~valid(d)), lambda d: F.regexp_replace(d, r"^0+(?=\d)", "")).alias("invalid"),
    )
    return counted.withColumn("grounded", grounded(F.col("refused"), F.col("sentences"), F.col("uncited")))


def grounded(refused: Column, sentences: Column, uncited: Column) -> Column:
    """Share of sentences with a citation; one for a refusal or an empty answer."""
    return F.when(refused | (sentences == 0), F.lit(1.0)).otherwise(1.0 - uncited / sentences)


def spans(text: Column, valid_numbers: Column) -> Column:
    """The answer cut into text, valid and invalid citation spans, in order.

    What stands between markers and the markers themselves are two arrays that
    take turns; the pattern has no repeated group, so no answer is too long.
    """
    between = F.split(text, r"\[\d+\]", -1)
    digits = F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1)

    def kind(number: Column) -> Column:
        known = F.array_contains(valid_numbers, number.try_cast("long"))
        return F.when(F.coalesce(known, F.lit(False)), F.lit("valid")).otherwise(F.lit("invalid"))

    def pair(piece: Column, number: Column) -> Column:
        words = F.struct(F.lit("text").alias("kind"), F.coalesce(piece, F.lit("")).alias("content"))
        mark = F.struct(kind(number).alias("kind"), F.coalesce(number, F.lit("")).alias("content"))
        return F.when(number.isNull(), F.array(words)).otherwise(F.array(words, mark))

    return F.filter(F.flatten(F.zip_with(between, digits, pair)), lambda s: s["content"] != "")


def without_version(paper_id: Column) -> Column:
    """A paper's identifier without its trailing version."""
    return F.regexp_replace(paper_id, r"v\d+$", "")
