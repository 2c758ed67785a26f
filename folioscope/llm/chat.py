"""Chat formatting at the token level.

Every segment (a role, a text) is encoded by itself; reserved ids that no text can produce are spliced between:

    <s> ( [INST] role [/INST] text </s> )*

Inside roles and texts a backslash and the first character of every control string get a backslash in front, so the
template's marks occur in the formatted text only where the template put them, and a text can be read back. The loss
mask covers exactly the texts of the trained roles. Offsets of turns in a conversation are running sums, kept while
rows stream by in order; no conversation is held as a whole.

Null text or role: empty. Rows that repeat a turn stand in order of role and text. Null ids form a conversation of
their own. Empty input, empty output. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.bpe import Encoder, Vocabulary, shared
from folioscope.llm.common import extended

MARKS = ("<s>", "[INST]", "[/INST]", "</s>")
BEGIN, OPEN, CLOSE, END = range(4)


@dataclass(frozen=True)
class Template:
    """Reserved ids follow the vocabulary; `controls` are escaped inside texts besides the template's own marks."""

    first: int
    controls: tuple[str, ...]
    trained: frozenset[str] = frozenset({"assistant"})

    @classmethod
    def of(cls, vocabulary: Vocabulary, trained: tuple[str, ...] = ("assistant",)) -> Template:
        return cls(vocabulary.size, (*MARKS, *vocabulary.special), frozenset(trained))

    def escape(self, text: str) -> str:
        pattern = "|".join([r"\\", *map(re.escape, sorted(self.controls, key=len, reverse=True))])
        return re.sub(pattern, lambda m: m[0][:-1] + "\\" + m[0][-1] if len(m[0]) > 1 else "\\\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


TURNS = "turn_no long, token_start long, ids array<int>, loss array<boolean>, formatted string"
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_turns(conversations: DataFrame, path: str, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn_no (from 0), token_start (ids of the conversation before it), ids, loss and formatted text per turn.

    A conversation's tokens are its turns' ids in order of turn_no. Rows come partitioned by conversation, in order.
    """
    vocabulary = shared(conversations.sparkSession, path)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", text("role"), text("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*vocabulary.value))
        template = Template.of(Vocabulary(*vocabulary.value), trained)
        mark = [np.array([template.first + i], dtype="<i4") for i in range(len(MARKS))]
        current, number, start = object(), 0, 0
        for batch in batches:
            numbers, starts, ids, masks, shown = [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
            for conversation, role, content in zip(*columns, strict=True):
                if conversation != current:
                    current, number, start = conversation, 0, 0
                written = template.escape(role), template.escape(content)
                said, spoken = (np.frombuffer(encoder.encode(part), dtype="<i4") for part in written)
                segments = [mark[OPEN], said, mark[CLOSE], spoken, mark[END]]
                if number == 0:
                    segments.insert(0, mark[BEGIN])
                ends = np.cumsum([len(s) for s in segments])
                loss = np.zeros(ends[-1], dtype=bool)
                loss[ends[-3] : ends[-2]] = role in template.trained
                numbers.append(number)
                starts.append(start)
                ids.append(np.concatenate(segments))
                masks.append(loss)
                shown.append(MARKS[BEGIN] * (number == 0) + MARKS[OPEN] + written[0] + MARKS[CLOSE] + written[1] + MARKS[END])
                number, start = number + 1, start + int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())), pa.array(shown, pa.string()),
                ],
                names=["conv_id", "turn_no", "token_start", "ids", "loss", "formatted"],
            )

    return rows.mapInArrow(work, extended(rows.select("conv_id"), TURNS))


class _Digest:
    def __init__(self, conversation):
        self.conversation = conversation
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conversation, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(turns: DataFrame, path: str) -> DataFrame:
    """Digests of every conversation, taken from ids and masks of `format_turns` alone, whose order it relies on."""
    vocabulary = shared(turns.sparkSession, path)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*vocabulary.value))
        first = Template.of(Vocabulary(*vocabulary.value)).first
        labels = [*encoder.labels, *(m.encode() for m in MARKS)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current: _Digest | None = None
        for batch in batches:
            done = []
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn_no", "ids", "loss"))
            for conversation, number, ids, loss in zip(*columns, strict=True):
                if current is None or number == 0:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(conversation)
                opened, closed, ended = (ids.index(first + kind) for kind in (OPEN, CLOSE, END))
                role = unescape(encoder.decode(ids[opened + 1 : closed]))
                text = unescape(encoder.decode(ids[closed + 1 : ended]))
                trained = unescape(encoder.decode([i for i, on in zip(ids, loss, strict=True) if on]))
                current.turns += 1
                current.all.update(f"{role}\n{text}\n".encode())
                current.loss_chars += len(trained)
                current.loss.update(trained.encode())
                current.chars += len(b"".join(map(labels.__getitem__, ids)).decode())
            yield _batch(done, names, [batch.schema.field("conv_id").type, *kinds[1:]])
        if current is not None:
            yield _batch([current.row()], names, [batch.schema.field("conv_id").type, *kinds[1:]])

    return turns.select("conv_id", "turn_no", "ids", "loss").mapInArrow(work, extended(turns.select("conv_id"), DIGESTS))


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)
