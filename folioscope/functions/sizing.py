"""Measured sizes, and the joins that depend on them.

A side is broadcast only after its payload has been measured. Above the limit
the same join runs as a shuffle whose hot keys are spread over salts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_LIMIT = 64 * 1024 * 1024
SALTS = 32


@dataclass(frozen=True)
class Extent:
    """Rows and payload bytes of a table at the time it was measured."""

    rows: int
    payload: int

    def fits(self, per_row: int = 0, copies: int = 1, limit: int = BROADCAST_LIMIT) -> bool:
        """Whether something derived from the table stays below the limit.

        `per_row` is what each row may add, `copies` how often the payload may
        be repeated (a tokenised text holds each byte at most once).
        """
        return self.payload * copies + self.rows * per_row <= limit


def _width(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(field.dataType, T.ArrayType):
        element = 8 if not isinstance(field.dataType.elementType, T.FloatType) else 4
        return F.coalesce(F.size(column), F.lit(0)).cast("long") * element
    return F.lit(8).cast("long")


def measure(df: DataFrame) -> Extent:
    """One aggregate over a source table; only the two totals reach the driver."""
    payload = sum((_width(field) for field in df.schema.fields), F.lit(0).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(payload).alias("payload")).first()
    return Extent(int(row["rows"]), int(row["payload"] or 0))


def spread_join(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    fits: bool,
    spread: list[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Joins `large` to `small` on keys that may be hot on the large side.

    `spread` names the large-side columns whose hash picks the salt. Only
    inner, left and left_semi joins keep their meaning under salting, because
    every large row still meets exactly one copy of each small row.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type: {how}")
    if fits:
        return large.join(F.broadcast(small), on, how)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def rounded(value: Column, digits: int) -> Column:
    """A double on a decimal grid, exactly as tasks that score blocks put it there."""
    return F.rint(value * F.lit(10.0**digits)) / F.lit(10.0**digits) + F.lit(0.0)


def top_ranked(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str = "rank", spread: str | None = None
) -> DataFrame:
    """First `limit` rows of each group with their 1-based rank.

    The filter sits directly on `row_number`, so Spark prunes each partition to
    `limit` rows per group before the shuffle: a hot group never travels whole.
    Where tasks have pruned their rows already, that removes nothing, and what
    all tasks hold of a group would meet in one. `spread` names a column whose
    hash deals such a group over salts first, each cut to `limit`.
    """
    from pyspark.sql import Window

    if spread is not None:
        dealt = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = dealt.withColumn("_first", F.row_number().over(first)).where(F.col("_first") <= limit).drop("_salt", "_first")
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= limit)
    return ranked.withColumn(rank, F.col(rank).cast("long"))
