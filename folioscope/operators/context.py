"""Numbered context and prompt text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.constants import REFUSAL

#: The three things an answer must keep to for the checks that follow: source, citation format, refusal sentence.
INSTRUCTIONS = f"""\
Source of the answer: the passages printed here. Citation format: [n], n being a passage's number, at the end of \
each sentence. If the passages do not answer the question, reply with this sentence only: {REFUSAL}.
"""


def passage_arrays(passages: DataFrame) -> DataFrame:
    """`query_id, passages`: the few numbered passages of a question in one row.

    The number of passages per question is capped before this, so no array grows
    with the data.
    """
    entry = F.struct("number", "paper_id", "section", "paragraph", "text")
    return passages.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("passages"))


def passage_text(passage: Column) -> Column:
    """One passage under its number, with what is needed to find it again."""
    return F.concat(
        F.lit("["),
        passage["number"].cast("string"),
        F.lit("] "),
        passage["paper_id"],
        F.lit(" · "),
        passage["section"],
        F.lit(" · paragraph "),
        passage["paragraph"].cast("string"),
        F.lit("\n"),
        passage["text"],
    )


def prompt(question: Column, passages: Column, instructions: str = INSTRUCTIONS) -> Column:
    return F.concat(
        F.lit(instructions + "\nPassages:\n\n"),
        F.array_join(F.transform(passages, passage_text), "\n\n"),
        F.lit("\n\nQuestion: "),
        question,
        F.lit("\n\nAnswer:"),
    )
