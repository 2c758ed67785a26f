"""What the operators share: intermediate tables, text constants, packed arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.sizing import BROADCAST_LIMIT
from folioscope.session import checkpoint_folder, small_batches  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word is a run of anything but these.
BLANKS = r"\x20\x09-\x0D"
WORD = rf"[^{BLANKS}]+"


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


#: Whether the files of a query's shuffles go when it ends (off by default: they wait for the driver's garbage collection).
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes a table once to the shared checkpoint folder and reads it back.

    Columnar, so later readers prune; a lost executor costs a re-read. The files go when the session's file system
    is closed, those of the shuffles that made the table as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=list(partition_by) or None)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing reads any more: what came of them has been stored."""
    for df in tables:
        files = df.inputFiles()
        if files:
            path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Lets the shuffle files go that made a table which is stored by now: executors delete them once the driver's JVM
    has collected the plans that named them, which it does late when its memory is large."""
    df.sparkSession.sparkContext._jvm.System.gc()


def extended(df: DataFrame, fields: str) -> T.StructType:
    """The schema of a table with more fields after its own, given as in a table definition."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def parts(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of so many rows, so that what is made of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of splitmix64)."""
    values = values.astype(np.uint64, copy=True)
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 64
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text with A-Z in lower case, in order."""
    return hashed_texts([text])[0]


def hashed_texts(texts: list[str | None]) -> list[np.ndarray]:
    """`word_hashes` of some texts, a megabyte at a time."""
    raws = [(text or "").encode("utf-8", "surrogatepass").lower() for text in texts]
    ends, found, first = np.cumsum([len(raw) + 1 for raw in raws]), [], 0
    while first < len(raws):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + (1 << 20))))
        starts, hashes = _words(b" ".join(raws[first:last]))
        found += np.split(hashes, np.searchsorted(starts, ends[first : last - 1] - before))
        first = last
    return found


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and their hashes: eight bytes of all its words at a time."""
    raw += bytes(8)
    held = np.frombuffer(raw, dtype=np.uint8)[:-8]
    inside = np.zeros(len(held) + 2, dtype=bool)
    inside[1:-1] = (held != 0x20) & (held - np.uint8(9) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(held) + 1, dtype="<u8", buffer=raw, strides=(1,))
    hashes = mix(sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashes = mix(hashes ^ (eights[starts] & _FIRST_BYTES[np.minimum(sizes, 8)]))
    for done in range(8, LONG_WORD, 8):
        left = np.flatnonzero((sizes > done) & (sizes <= LONG_WORD))
        if not len(left):
            break
        part = eights[starts[left] + done] & _FIRST_BYTES[np.minimum(sizes[left] - done, 8)]
        hashes[left] = mix(hashes[left] ^ part)
    for i in np.flatnonzero(sizes > LONG_WORD):
        import xxhash

        hashes[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]])
    return starts, hashes


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of `width` words, in order (none for shorter inputs)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total = mix(total + hashes[i : i + n] + np.uint64(i + 1))
    return total


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """Arrow list<int64> of unsigned or signed 64-bit arrays."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def small(df: DataFrame, bytes_per_row: int = 64, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """A stored table, marked for broadcast if its counted rows fit; beyond that the join shuffles and splits hot keys."""
    return F.broadcast(df) if df.count() * bytes_per_row <= limit else df
