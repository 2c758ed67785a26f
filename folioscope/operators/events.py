"""Answers as event streams: rows, wire text, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import strip_space

WIRE_DATA = "array<string>"


def fragments(answer: Column) -> Column:
    """An answer in the pieces a model would send; together they are the answer."""
    return F.regexp_extract_all(answer, F.lit(r"(\S+\s*|^\s+)"), 1)


def event_rows(checked: DataFrame) -> DataFrame:
    """`query_id, seq, event, data`: the passages, the answer's tokens, the report.

    A cached answer is one token. Expects the columns of `citations.check` and
    `cached`.
    """
    # Invalid numbers are kept as digits, of which there may be too many for any number type.
    start, rest = F.to_json(F.struct("citations")), F.to_json(F.struct("grounded", "refused", "cached"))
    invalid = F.concat(F.lit(',"invalid":['), F.array_join("invalid", ","), F.lit("],"))
    report = F.concat(F.substring(start, F.lit(1), F.length(start) - 1), invalid, F.substring(rest, F.lit(2), F.length(rest)))
    tokens = F.when(F.col("cached"), F.array("answer")).otherwise(fragments(F.col("answer")))
    listed = F.concat(
        F.array(F.struct(F.lit("passages").alias("event"), F.to_json("passages").alias("data"))),
        F.transform(tokens, lambda t: F.struct(F.lit("token").alias("event"), _json_string(t).alias("data"))),
        F.array(F.struct(F.lit("citations").alias("event"), report.alias("data"))),
    )
    return (
        checked.select("query_id", F.posexplode(listed).alias("seq", "_e"))
        .select("query_id", F.col("seq").cast("long").alias("seq"), "_e.event", "_e.data")
    )


def _json_string(text: Column) -> Column:
    """A JSON string literal: the value part of a one-field object."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def wire(events: DataFrame) -> DataFrame:
    """Events as the text sent over the wire, one row per event."""
    return events.withColumn(
        "wire", F.concat(F.lit("event: "), "event", F.lit("\r\ndata: "), "data", F.lit("\r\n\r\n"))
    )


def split_events(buffer: Column) -> Column:
    """`struct<events, rest>` of a text buffer.

    Blocks end at a blank line with or without carriage returns; the last,
    unfinished one is `rest`. Several data lines are joined by newlines, an event
    without a name is a `message`, and a block without data is no event.
    """
    blocks = F.split(buffer, "\r?\n\r?\n")

    def field(lines: Column, name: str) -> Column:
        return F.transform(
            F.filter(lines, lambda line: line.startswith(name + ":")),
            lambda line: strip_space(F.substring(line, F.lit(len(name) + 2), F.length(line))),
        )

    def parse(block: Column) -> Column:
        lines = F.split(block, "\r?\n")
        return F.struct(
            F.coalesce(F.try_element_at(field(lines, "event"), F.lit(-1)), F.lit("message")).alias("event"),
            field(lines, "data").alias("lines"),
        )

    whole = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    events = F.transform(
        F.filter(F.transform(whole, parse), lambda e: F.size(e["lines"]) > 0),
        lambda e: F.struct(e["event"].alias("event"), F.array_join(e["lines"], "\n").alias("data")),
    )
    return F.struct(events.alias("events"), F.element_at(blocks, -1).alias("rest"))
