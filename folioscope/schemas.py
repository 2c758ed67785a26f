"""The two stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

PAPERS = T.StructType(
    [
        T.StructField("paper_id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("abstract", T.StringType(), False),
        T.StructField("authors", T.ArrayType(T.StringType()), False),
        T.StructField("categories", T.ArrayType(T.StringType()), False),
        T.StructField("published", T.StringType(), False),
        T.StructField("updated", T.StringType(), False),
        T.StructField("ingested_at", T.TimestampType(), False),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.LongType(), False),
        T.StructField("paper_id", T.StringType(), False),
        T.StructField("section", T.StringType(), False),
        T.StructField("paragraph", T.LongType(), False),
        T.StructField("chunk_index", T.LongType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType()), False),
    ]
)
