"""Fill-in-middle transformation by words of eight bytes.

The texts of a batch lie behind each other in one buffer of UTF-8, which is read as unsigned 64-bit words. Arithmetic on
whole words marks the bytes at which a code point ends, `bitwise_count` counts the marks of each word, and running sums
over the words say where the k-th code point of any text ends: a binary search finds the word, and byte-wise prefix
sums of its marks find the byte within it. All cuts of a batch are found together; no text is decoded.

A document is cut at two places drawn from the hash of its id, and its pieces are put in the order prefix, suffix,
middle (`psm`) or suffix, prefix, middle (`spm`), each behind its marker. A text that is empty, holds a marker itself, or
is drawn to stay as it is, stays `plain`.

* Null text: as the empty text. A null id draws as the empty id. Repeated ids draw alike; repeated rows stay.
* Whole texts of any length are cut; the buffer is that of one Arrow batch. An empty table gives no rows.
* Other columns are kept by `transformed`; where they are named like a column the operator adds, the latter wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import extended, parts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"
#: Of a hundred documents so many are cut, and of these so many have their suffix first.
CUT, SUFFIX_FIRST = 90, 20
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


class Units:
    """Code points of a buffer of UTF-8: how many end before a byte, and where the k-th ends."""

    def __init__(self, data: np.ndarray):
        size = len(data)
        # What follows the buffer starts a code point, so that the last one ends.
        padded = np.zeros((size // 8 + 2) * 8, dtype=np.uint8)
        padded[:size] = data
        words = padded.view("<u8")
        # A byte 10xxxxxx goes on with a code point; every other byte starts one.
        starts = ~((words >> np.uint64(7)) & ~(words >> np.uint64(6))) & _ONES
        # A code point ends at a byte if the next byte starts one.
        self.ends = (starts[:-1] >> np.uint64(8)) | (starts[1:] << np.uint64(56))
        self.upto = np.zeros(len(self.ends) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.ends), out=self.upto[1:])

    def before(self, places: np.ndarray) -> np.ndarray:
        """Code points that end before the given bytes."""
        word, byte = places >> 3, (places & 7).astype(np.uint64)
        mask = (np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1)
        return self.upto[word] + np.bitwise_count(self.ends[word] & mask)

    def after(self, numbers: np.ndarray) -> np.ndarray:
        """The byte after the code point of each number, counted from 1 over the buffer."""
        word = np.minimum(np.searchsorted(self.upto, numbers, side="left"), len(self.ends)) - 1
        rest = (numbers - self.upto[word]).astype(np.uint64)
        # Byte i of the product is the number of marks in the bytes 0 to i, eight at most.
        sums = self.ends[word] * _ONES
        reached = ((sums | _TOPS) - rest * _ONES) & _TOPS
        return word * 8 + 9 - np.bitwise_count(reached)


def draws(key: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the hash of a document's key."""
    text = hashlib.sha256(key.encode()).hexdigest()
    return int(text[:8], 16), int(text[8:16], 16), int(text[16:24], 16), int(text[24:32], 16)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and, for each, where it starts (with the end of the last)."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(offsets) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def cut(texts: pa.Array, keys: list[str], percent: int = CUT, suffix_first: int = SUFFIX_FIRST) -> list[pa.Array]:
    """The added columns for the texts of one batch."""
    data, offsets = _buffer(texts)
    units = Units(data)
    ranks = units.before(offsets)
    counts = np.diff(ranks)
    drawn = np.array([draws(key) for key in keys], dtype=np.int64).reshape(-1, 4)
    ends = np.sort(drawn[:, :2] % (counts + 1)[:, None], axis=1)
    # Where a cut lies before the first code point, it is at the text's start.
    places = np.where(ends > 0, units.after(np.maximum(ranks[:-1, None] + ends, 1).ravel()).reshape(-1, 2), offsets[:-1, None])
    raw = data.tobytes()
    forms, outputs, heads, middles = [], [], [], []
    markers = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    rows = zip(offsets[:-1].tolist(), offsets[1:].tolist(), places.tolist(), ends.tolist(), drawn[:, 2:].tolist(), strict=True)
    for start, end, (first, second), (a, b), (keep, order) in rows:
        text = raw[start:end]
        if start == end or keep % 100 >= percent or any(m in text for m in markers):
            forms.append("plain")
            outputs.append(text)
            heads.append(None)
            middles.append(None)
            continue
        prefix, middle, suffix = markers[0] + raw[start:first], markers[2] + raw[first:second], markers[1] + raw[second:end]
        back = order % 100 < suffix_first
        forms.append("spm" if back else "psm")
        outputs.append(suffix + prefix + middle if back else prefix + suffix + middle)
        heads.append(a)
        middles.append(b - a)
    return [
        pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(heads, pa.int64()), pa.array(middles, pa.int64()),
        pa.array(outputs, pa.string()),
    ]


def transformed(docs: DataFrame, percent: int = CUT, suffix_first: int = SUFFIX_FIRST, key: str = "1:") -> DataFrame:
    """Documents with n (code points), form, prefix_chars, middle_chars and output. `key` stands before the id that is
    drawn from."""
    added = T.StructType.fromDDL(ADDED)
    clear = docs.drop(*added.names)
    mine = F.concat(F.lit(key), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    taken = {name.lower() for name in clear.columns}
    column = next(name for name in ("_drawn", *(f"_drawn{i}" for i in range(len(taken)))) if name not in taken)
    rows = clear.withColumn(column, mine)
    names = clear.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            new = cut(batch.column("text"), batch.column(column).to_pylist(), percent, suffix_first)
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), *new], names=[*names, *added.names])

    return rows.mapInArrow(work, extended(clear, ADDED))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. The pieces hold no marker, so the markers alone part them."""
    pieces = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    psm = F.concat(F.get(pieces, F.lit(1)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(2)))
    spm = F.concat(F.get(pieces, F.lit(2)), F.get(pieces, F.lit(3)), F.get(pieces, F.lit(1)))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and hashes of the output and of the text restored from it."""
    rows = transformed(docs.select("doc_id", "text")).drop("text")
    back = restored(F.col("output"), F.col("form"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )
