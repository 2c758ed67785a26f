"""Exact order statistics without bringing a group into one task.

A mergeable sketch brackets each wanted position; an exact count of what lies
below the bracket and a running count over the distinct values inside it then
give the value itself. Only the bracket, about a five-hundredth of the rows and
fewer after counting equal values together, is ever sorted per group. Where that
could be more than `SORTED_ROWS`, the bracket is first narrowed to the one of many
bins that holds the position, as often as it takes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.sizing import measure, spread_join
from folioscope.session import materialise

SKETCH_ACCURACY = 10_000
BRACKET = 0.001  # ten times the sketch's rank error
SORTED_ROWS = 1_000_000
BINS = 4096


@dataclass(frozen=True)
class Position:
    """A place in the sorted values: roughly `fraction`, exactly `index(n)` from zero."""

    name: str
    fraction: float
    index: Callable[[Column], Column]


def nearest_rank(name: str, fraction: float) -> Position:
    """The value at floor(n x fraction), or the last one."""
    return Position(name, fraction, lambda n: F.least(F.floor(n * F.lit(fraction)), n - 1))


LOWER_MIDDLE = Position("lower", 0.5, lambda n: F.floor((n - 1) / 2))
UPPER_MIDDLE = Position("upper", 0.5, lambda n: F.floor(n / 2))


def order_statistics(df: DataFrame, keys: list[str], value: str, positions: list[Position]) -> DataFrame:
    """`keys, position, n, value` with one row per group and position; nulls are ignored."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))

    def sketch(fraction: float) -> Column:
        return F.percentile_approx("_v", F.lit(min(1.0, max(0.0, fraction))), F.lit(SKETCH_ACCURACY))

    bounds = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[sketch(p.fraction - BRACKET).alias(f"_low_{i}") for i, p in enumerate(positions)],
        *[sketch(p.fraction + BRACKET).alias(f"_high_{i}") for i, p in enumerate(positions)],
    )
    positions_of = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("position"),
                F.col(f"_low_{i}").alias("low"),
                F.col(f"_high_{i}").alias("high"),
                p.index(F.col("n")).cast("long").alias("index"),
            )
            for i, p in enumerate(positions)
        ]
    )
    brackets = materialise(bounds.select(*keys, "n", positions_of.alias("_wanted")))
    fits = measure(brackets).fits(per_row=80 * len(positions))
    most = 4 * BRACKET * (brackets.agg(F.max("n")).first()[0] or 0)  # twice what the sketch promises
    while most > SORTED_ROWS:
        brackets, inside = _narrowed(rows, brackets, keys, fits)
        if inside >= most:  # equal values cannot be told apart further, and are counted as one
            break
        most = inside
    zones = (
        _below_the_end(rows, brackets, keys, fits)
        .groupBy(*keys, "n", "_w", F.when(F.col("_v") >= F.col("_w.low"), F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    running = Window.partitionBy(*keys, "_w").orderBy(F.col("_v").asc_nulls_first())
    counted = zones.withColumn("_upto", F.sum("_c").over(running))
    return counted.where(
        F.col("_v").isNotNull() & (F.col("_upto") > F.col("_w.index")) & (F.col("_upto") - F.col("_c") <= F.col("_w.index"))
    ).select(*keys, F.col("_w.position").alias("position"), "n", F.col("_v").alias("value"))


def _below_the_end(rows: DataFrame, brackets: DataFrame, keys: list[str], fits: bool) -> DataFrame:
    """Every value beside each of its group's brackets whose end it does not exceed."""
    placed = spread_join(rows, brackets, keys, fits, spread=["_v"])
    each = placed.select(*keys, "n", "_v", F.explode("_wanted").alias("_w"))
    return each.where(F.col("_v") <= F.col("_w.high"))


def _narrowed(rows: DataFrame, brackets: DataFrame, keys: list[str], fits: bool) -> tuple[DataFrame, int]:
    """Brackets cut down to the bin that holds their position, and the rows of the fullest one.

    A group has at most `BINS` bins per position and one for all that lies below, so the running count is short.
    """
    width = (F.col("_w.high") - F.col("_w.low")) / BINS
    number = F.least(F.floor((F.col("_v") - F.col("_w.low")) / width), F.lit(BINS - 1))
    number = F.when(F.col("_v") < F.col("_w.low"), -1).when(width > 0, number).otherwise(0)
    bins = _below_the_end(rows, brackets, keys, fits).groupBy(*keys, "n", "_w", number.alias("_bin"))
    bins = bins.agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    running = Window.partitionBy(*keys, "_w").orderBy("_bin")
    counted = bins.withColumn("_upto", F.sum("_c").over(running))
    index = F.col("_w.index")
    chosen = counted.where((F.col("_upto") > index) & (F.col("_upto") - F.col("_c") <= index))
    narrow = F.struct(F.col("_w.position").alias("position"), F.col("_from").alias("low"), F.col("_to").alias("high"), index.alias("index"))
    packed = chosen.groupBy(*keys, "n").agg(F.collect_list(narrow).alias("_wanted"), F.max("_c").alias("_most"))
    packed = materialise(packed)
    return packed.drop("_most"), int(packed.agg(F.max("_most")).first()[0] or 0)


def percentiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """One column per named fraction, by the nearest-rank rule."""
    found = order_statistics(df, keys, value, [nearest_rank(name, f) for name, f in fractions.items()])
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("position") == name, F.col("value"))).alias(name) for name in fractions]
    )


def median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Mean of the middle pair, or the middle value."""
    found = order_statistics(df, keys, value, [LOWER_MIDDLE, UPPER_MIDDLE])
    return found.groupBy(*keys).agg((F.sum("value") / 2).alias(name))
