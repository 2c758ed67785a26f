"""Text to unit vectors. The hashing encoder needs no model and is exact in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import term_counts, tokens
from folioscope.session import small_batches

HASH_DIMENSIONS = 64


def bucket(term: Column, dimensions: int = HASH_DIMENSIONS) -> Column:
    """First 32 bits of the term's MD5, modulo the number of dimensions."""
    return F.pmod(F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dimensions)).cast(
        "int"
    )


def _fill(dimensions: int):
    """Turns the two bucket lists at the end of each row into a unit vector, a
    whole Arrow batch at a time; the other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, counts = batch.column("_buckets"), batch.column("_counts")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(buckets.offsets.to_numpy()))
            cells = rows * dimensions + buckets.flatten().to_numpy()
            sums = np.bincount(cells, counts.flatten().to_numpy(), batch.num_rows * dimensions)
            block = sums.reshape(batch.num_rows, dimensions)
            norms = np.sqrt((block * block).sum(axis=1, keepdims=True))
            block = np.divide(block, norms, out=np.zeros_like(block), where=norms > 0).astype(np.float32)
            offsets = np.arange(0, block.size + 1, dimensions, dtype=np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], vectors], names=[*batch.schema.names[:-2], "embedding"]
            )

    return run


def hashed(df: DataFrame, text: str, dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """Adds `embedding`: tokens counted per hash bucket, scaled to unit length.

    A text without tokens gets the zero vector.
    """
    small_batches(df.sparkSession)
    terms = df.select("*", term_counts(tokens(F.col(text))).alias("_terms")).select(
        *df.columns,
        F.transform("_terms", lambda t: bucket(t["term"], dimensions)).alias("_buckets"),
        F.transform("_terms", lambda t: t["tf"]).alias("_counts"),
    )
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return terms.mapInArrow(_fill(dimensions), schema)
