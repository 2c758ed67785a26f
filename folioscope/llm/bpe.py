"""Byte-level BPE as an automaton over tokens.

Merges are compiled one after another. Each merge gadget turns every path `u v` into the arc of the merged token: it
takes the arc `v` away from the state that follows `u`, gives the merged token an arc wherever `u` has one, and lets
it lead to where `v` leads. Since all arcs of a token lead to one state, an automaton is three tables: when an arc is
cut (`cut`), which state a token's state was copied from and when (`tail`, `born`), and which arc a token's arc was
copied from (`head`). A word's tokens are the labels of its only accepted path; every prefix has exactly one, so one
left-to-right pass finds it. Decoding emits the labels.

The tokenizer file is read on the driver (its size is fixed) and broadcast; executors need not have it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import extended

_ALWAYS = 1 << 30
_NONE = -2
#: Texts in which white space is single spaces and line feeds between other characters split into these runs alone.
_RUN = re.compile(r"\n| ?[^ \n]+")
_ODD_SPACE = re.compile(r"\s(?:\s|(?<=[^ \n])|\Z)")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of every byte: visible Latin-1 characters stand for themselves, the rest follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    """What a byte-level BPE file holds."""

    ids: dict[str, int]
    merges: list[tuple[str, str]]
    special: dict[str, int]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"] is None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("not a byte-level BPE file")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        return cls(model["vocab"], merges, {t["content"]: t["id"] for t in spec["added_tokens"]})

    @property
    def size(self) -> int:
        return max([*self.ids.values(), *self.special.values()]) + 1


class Automaton:
    """The compiled merges. Ids are those of the vocabulary."""

    MEMO = 1_000_000
    WINDOW = 5
    DEEP = 64
    END = 8

    def __init__(self, vocabulary: Vocabulary):
        alphabet = byte_alphabet()
        #: Tokens and words are byte strings, held as Latin-1 text.
        raw = {token: "".join([chr(alphabet[c]) for c in token]) for token in vocabulary.ids}
        ids = vocabulary.ids
        self.cut: dict[int, int] = {}
        self.head: dict[int, int] = {}
        self.tail: dict[int, int] = {}
        self.born: dict[int, int] = {}
        unmade: set[int] = set()
        for time, (left, right) in enumerate(vocabulary.merges):
            u, v, merged = ids[left], ids[right], ids[left + right]
            if u in unmade or v in unmade or not self._arc(u, v):
                unmade.add(merged)  # no path holds this pair when its turn comes
                continue
            self.cut[u << 32 | v] = time
            self.head[merged], self.tail[merged], self.born[merged] = u, v, time
        #: Every prefix of a token: its id, or none yet.
        self.steps: dict[str, int] = {}
        for token in raw.values():
            for end in range(1, len(token)):
                self.steps.setdefault(token[:end], _NONE)
        self.steps.update({raw[token]: number for token, number in ids.items() if number not in unmade})
        self.known: dict[int, bool] = {}
        self.ends: dict[tuple[int, str], bytes | None] = {}
        self.packed = [number.to_bytes(4, "little") for number in range(vocabulary.size)]
        self.seen: dict[str, tuple[tuple[int, int], ...]] = {}
        self.begun: dict[str, tuple[tuple[int, int], ...]] = {}

    def arc(self, state: int, token: int) -> bool:
        """Whether the state after `state` has an arc for `token`; looked up once per pair."""
        key = state << 32 | token
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= self.MEMO:
                self.known.clear()
            found = self.known[key] = self._arc(state, token)
        return found

    def _arc(self, state: int, token: int) -> bool:
        copied = _ALWAYS  # the state holds the cuts made in `source` before this time
        source: int | None = state
        while source is not None:
            taken = _ALWAYS  # the arc stems from `arc` as it was at this time
            arc: int | None = token
            while arc is not None:
                time = self.cut.get(source << 32 | arc)
                # A gadget of two equal tokens cuts before it copies the arc.
                if time is not None and time < copied and time <= taken:
                    return False
                taken, arc = self.born.get(arc, -1), self.head.get(arc)
            copied, source = self.born.get(source, -1), self.tail.get(source)
        return True

    def word(self, word: str) -> bytes:
        """Token ids, four bytes each, of one pre-split word, its bytes as Latin-1 text."""
        if len(word) > self.DEEP:
            return b"".join([self.packed[token] for token in self._search(word)])
        return self._rest(-1, word)

    def _rest(self, state: int, rest: str) -> bytes | None:
        """Labels of the accepted path from a state through the rest of a word, None where there is none.

        Ends of words recur far more often than words, so their paths are remembered per state.
        """
        size = len(rest)
        kept = state >= 0 and size <= self.END
        if kept:
            key = state, rest
            path = self.ends.get(key, _NONE)
            if path is not _NONE:
                return path
        path, known = None, self.known
        matches = self.seen.get(rest[: self.WINDOW])
        if matches is None:
            matches = self._matches(rest, 0)
        for length, token in matches:
            allowed = state < 0 or known.get(state << 32 | token)
            if allowed or allowed is None and self.arc(state, token):
                if length == size:
                    path = self.packed[token]
                    break
                further = self._rest(token, rest[length:])
                if further is not None:
                    path = self.packed[token] + further
                    break
        if kept:
            if len(self.ends) >= self.MEMO // 2:
                self.ends.clear()
            self.ends[key] = path
        return path

    def _search(self, word: str) -> list[int]:
        """The accepted path of a long word. A state that led nowhere is not entered again, so the work stays within word length times
        token length."""
        size = len(word)
        path: list[int] = []
        at = [0]
        options = [iter(self._matches(word, 0))]
        dead: set[tuple[int, int]] = set()
        while at[-1] < size:
            for length, token in options[-1]:
                end = at[-1] + length
                if (end, token) not in dead and (not path or self.arc(path[-1], token)):
                    path.append(token)
                    at.append(end)
                    options.append(iter(self._matches(word, end)))
                    break
            else:
                options.pop()
                dead.add((at.pop(), path.pop()))
        return path

    def _matches(self, word: str, start: int) -> tuple[tuple[int, int], ...]:
        """Lengths and ids of the tokens that begin at a position, longest first."""
        key = word[start : start + self.WINDOW]
        found = self.seen.get(key)
        if found is None:
            # What the window alone decides is looked up once.
            steps, ended = self.steps, len(key) < self.WINDOW
            begun = self.begun.get(key)
            matches = [] if begun is None else [*begun]
            for end in range(start + 1 if begun is None else start + self.WINDOW + 1, len(word) + 1):
                token = steps.get(word[start:end])
                if token is None:
                    ended = ended or end - start <= self.WINDOW
                    break
                if token != _NONE:
                    matches.append((end - start, token))
                if end - start == self.WINDOW:
                    if len(self.begun) >= self.MEMO // 4:
                        self.begun.clear()
                    self.begun[key] = tuple(matches)
            found = tuple(matches[::-1])
            if ended:  # nothing beyond the window decided this
                if len(self.seen) >= self.MEMO // 4:
                    self.seen.clear()
                self.seen[key] = found
        return found


class _Words(dict):
    """Packed ids of pre-split words, up to a number of them."""

    def __init__(self, automaton: Automaton, limit: int):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: str) -> bytes:
        packed = self.automaton.word(word)
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = packed
        return packed


class Encoder(dict):
    """Texts to ids and back. As a dictionary it remembers runs of text, up to `LIMIT` of them; results never depend on it."""

    LIMIT = 600_000

    def __init__(self, vocabulary: Vocabulary):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.automaton = Automaton(vocabulary)
        self.words = _Words(self.automaton, self.LIMIT // 3)
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.special = dict(vocabulary.special)
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, marks)) + ")") if marks else None
        alphabet = byte_alphabet()
        self.raw = str.maketrans({char: chr(byte) for char, byte in alphabet.items()})
        self.labels = [b""] * vocabulary.size
        for token, number in vocabulary.ids.items():
            self.labels[number] = bytes(map(alphabet.__getitem__, token))
        for token, number in self.special.items():
            self.labels[number] = token.encode()

    def __missing__(self, run: str) -> bytes:
        end = len(run) - (run[-1] in ",.")
        letters = run[run[0] == " " : end]
        # Latin letters, perhaps with a comma or full stop after them, need no pre-tokenizer: two words.
        if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250"):
            packed = self.automaton.word(run[:end].encode().decode("latin-1"))
            if end < len(run):
                packed += self.words[run[end]]
        else:
            packed = b"".join([self.words[word] for word in self.presplit(run)])
        if len(self) >= self.LIMIT:
            self.clear()
        if len(run) <= 64:
            self[run] = packed
        return packed

    def presplit(self, text: str) -> list[str]:
        return [word.translate(self.raw) for word, _ in self.split(text)]

    def plain(self, text: str) -> bytes:
        """Ids, four bytes each, of a text without special tokens."""
        if not text:
            return b""
        if text[0].isspace() or _ODD_SPACE.search(text):
            return b"".join(map(self.words.__getitem__, self.presplit(text)))
        return b"".join(map(self.__getitem__, _RUN.findall(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        parts = self.marks.split(text)
        return b"".join(
            np.array([self.special[p]], dtype="<u4").tobytes() if i % 2 else self.plain(p) for i, p in enumerate(parts)
        )

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def shared(spark: SparkSession, path: str):
    """The fields of a tokenizer file's vocabulary as a broadcast value (a few MB, whatever the data)."""
    read = Vocabulary.load(path)
    return spark.sparkContext.broadcast((read.ids, read.merges, read.special))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; null counts as empty, repeated rows stay."""
    vocabulary = shared(docs.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*vocabulary.value))
        decimal = [str(number) for number in range(Vocabulary(*vocabulary.value).size)]
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_hex.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    given = docs.select("doc_id", "text")
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return given.mapInArrow(work, extended(given.select("doc_id"), fields))


def encoded(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """The rows with the ids of their `text` as one more column of integers (it wins over one of that name)."""
    vocabulary = shared(docs.sparkSession, path)
    rows = docs.drop(column)
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*vocabulary.value))
        for batch in batches:
            packed = [encoder.encode(text) for text in batch.column("text").to_pylist()]
            offsets = np.zeros(len(packed) + 1, dtype=np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            flat = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*names, column])

    return rows.mapInArrow(work, extended(rows, f"`{column}` array<int>"))


def decoded(rows: DataFrame, path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """The rows with the text of their ids as one more column; null ids decode to an empty text."""
    vocabulary = shared(rows.sparkSession, path)
    rows = rows.drop(into)
    names = rows.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(*vocabulary.value))
        for batch in batches:
            texts = [encoder.decode(ids or []) for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, into])

    return rows.mapInArrow(work, extended(rows, f"`{into}` string"))
