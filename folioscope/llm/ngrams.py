"""Language-model scoring with a sharded n-gram trie.

The corpus is cut into blocks of documents, which hold their texts as word numbers. Level by level, every block sends
its distinct n-grams, with how often its training documents hold them, to shards; a shard sums the counts, builds a
trie of what training holds (`trie.Trie`) and answers each block. A block sends an n-gram once however often it
occurs, so no key is hot for its documents; n-grams of a context that is more common than `HOT` are spread over shards
by their last word. Shards and blocks are bounded in size, their number grows with the corpus, and no part of the
model is cut off.

The model interpolates: p_n(w | h) = (c(h w) + m_n p_(n-1)(w | h')) / (c(h) + m_n), down to add-one unigrams. Leaves
hold the first term, c(h w) / (c(h) + m_n), quantised to 16 bits. Words are 64-bit hashes (two of a billion words meet
with a probability of 0.03); contexts at the start of a text are filled with a mark of their own.

Null and empty texts are their end alone. Rows that repeat an id are scored each; null ids never are held out. With no
training documents, probabilities are uniform over one word. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.llm.common import discard, extended, hashed_texts, mix, stored
from folioscope.llm.trie import Trie, restored

#: Hashes that stand for the end of a text and for what is before its start (fixed, away from any word by chance only).
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCK_TOKENS, SHARD_GRAMS, HOT = 1_200_000, 1_000_000, 200_000
#: Weight of the shorter context, by length of the n-gram.
WEIGHT = {2: 100.0, 3: 10.0, 4: 5.0}

BLOCKS = "block long, first int, ids binary, sizes binary, held binary, tokens binary, words binary, counts binary"
REQUESTS = "shard long, block long, grams binary, contexts binary, counts binary"
ANSWERS = "block long, shard long, numbers binary, counts binary, codes binary"
TOTALS = ", known long, total long, size long"


def _pack(values: np.ndarray) -> bytes:
    """Numbers, compressed byte plane by byte plane."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.compress(planes.tobytes(), 3)


def _open(packed: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_grams(grams: np.ndarray) -> bytes:
    """Sorted n-grams: first words as steps, last words as steps within a context."""
    own = grams.copy()
    own[1:, 0] -= grams[:-1, 0]
    same = (grams[1:, :-1] == grams[:-1, :-1]).all(axis=1)
    own[1:, -1] -= np.where(same, grams[:-1, -1], 0)
    return _pack(own.T.ravel())


def _open_grams(packed: bytes, order: int) -> np.ndarray:
    own = _open(packed, np.int64).reshape(order, -1).T.copy()
    own[:, 0] = np.cumsum(own[:, 0])
    start = np.ones(len(own), dtype=bool)
    start[1:] = (own[1:, :-1] != own[:-1, :-1]).any(axis=1)
    run = np.cumsum(own[:, -1])
    before = (run - own[:, -1])[np.flatnonzero(start)]
    own[:, -1] = run - before[np.cumsum(start) - 1]
    return own


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in fields.split(", ")), strict=True)
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    arrays = [pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(names))


def blocks(docs: DataFrame, held_out: Column, order: int) -> DataFrame:
    """Documents as word numbers, some hundred thousand tokens a row."""
    given = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bool] = []
        texts: list[np.ndarray] = []
        size = 0

        def flush() -> tuple:
            lead = np.full(order - 1, BEGIN)
            flat = np.concatenate([part for text in texts for part in (lead, text, [END])])
            words, tokens = np.unique(flat, return_inverse=True)
            sizes = np.array([len(text) + 1 for text in texts], dtype=np.int32)
            training = np.repeat(~np.array(held), sizes + order - 1)
            counts = np.bincount(tokens[training], minlength=len(words))
            packed = (sizes, np.array(held), tokens.astype(np.int32), words, counts)
            return (task << 32 | made, order - 1, zstandard.compress(pickle.dumps(ids), 3), *map(_pack, packed))

        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "held"))
            for row, is_held, text in zip(*columns, hashed_texts(batch.column("text").to_pylist()), strict=True):
                ids.append(row)
                held.append(bool(is_held))
                texts.append(text)
                size += len(texts[-1]) + 1
                if size >= BLOCK_TOKENS:
                    out.append(flush())
                    made, size = made + 1, 0
                    ids, held, texts = [], [], []
            yield _batch(out, BLOCKS)
        if texts:
            yield _batch([flush()], BLOCKS)

    return stored(given.mapInArrow(work, BLOCKS))


class _Block:
    """A block's arrays, and its distinct n-grams level by level."""

    def __init__(self, row: dict):
        self.number, self.lead = row["block"], row["first"]
        self.ids = pickle.loads(zstandard.decompress(row["ids"]))
        kinds = (("sizes", np.int32), ("held", np.bool_), ("tokens", np.int32))
        self.sizes, self.held, self.tokens = (_open(row[name], kind) for name, kind in kinds)
        padded = self.sizes.astype(np.int64) + self.lead
        self.starts = np.concatenate(([0], np.cumsum(padded)[:-1]))
        self.training = np.repeat(~self.held, padded)
        #: How far each place is from the start of its document.
        self.depth = np.arange(len(self.tokens)) - np.repeat(self.starts, padded)
        self.row = row

    def grams(self, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per level from 1: number of the n-gram that ends at each place (-1 where none does), and for each n-gram the
        number of its context and of its last word."""
        words = int(self.tokens.max()) + 1
        levels = [(self.tokens.astype(np.int64), np.zeros(words, dtype=np.int64), np.arange(words))]
        for n in range(2, order + 1):
            before = levels[-1][0]
            ends = np.flatnonzero(self.depth >= n - 1)
            keys, number = np.unique(before[ends - 1] * words + self.tokens[ends], return_inverse=True)
            at = np.full(len(self.tokens), -1, dtype=np.int64)
            at[ends] = number
            levels.append((at, keys // words, keys % words))
        return levels


def _send(block: _Block, keys: np.ndarray, route: np.ndarray, contexts: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    """Rows for the shards: their n-grams in order, each context's total, each count. What it was sent, a block can
    work out again (`_order`), so answers carry no keys."""
    out = []
    for shard, chosen in _order(keys, route, shards):
        out.append((shard, block.number, _pack_grams(keys[chosen]), _pack(contexts[chosen]), _pack(counts[chosen])))
    return out


def _few(columns: list[np.ndarray], bounds: list[int]) -> list[np.ndarray]:
    """The same order in fewer columns: neighbours, each from 0 to below its bound, become one where that fits a long."""
    out, room = [columns[0]], bounds[0]
    for column, bound in zip(columns[1:], bounds[1:], strict=True):
        if room * bound < 1 << 63:
            out[-1], room = out[-1] * bound + column, room * bound
        else:
            out.append(column)
            room = bound
    return out


def _order(keys: np.ndarray, route: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    shard = (mix(route) % np.uint64(shards)).astype(np.int64)
    columns = [shard, *keys.T]
    if len(columns) > 2 and len(keys):
        columns = _few(columns, [shards, *[int(keys.max()) + 1] * keys.shape[1]])
    order = np.lexsort(columns[::-1])
    bounds = np.flatnonzero(np.diff(shard[order])) + 1
    return [(int(shard[part[0]]), part) for part in np.split(order, bounds) if len(part)]


def _words_asked(tables: DataFrame, shards: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = _open(row["words"], np.uint64), _open(row["counts"], np.int64)
                rows = []
                for shard, chosen in _order(words.view(np.int64)[:, None], words, shards):
                    rows.append((shard, row["block"], _pack(words[chosen]), b"", _pack(counts[chosen])))
                yield _batch(rows, REQUESTS)

    return tables.select("block", "words", "counts").mapInArrow(work, REQUESTS)


def _words_answered(asked: DataFrame, shards: int) -> DataFrame:
    """Global number and training count of every word a block asked for; one row more per shard with its totals."""

    def answer(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        lists = [_open(x.as_py(), np.uint64) for x in table.column("grams")]
        counts = np.concatenate([_open(x.as_py(), np.int64) for x in table.column("counts")])
        words, number = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(number, weights=counts, minlength=len(words)).astype(np.int64)
        rows, start = [], 0
        for block, own in zip(table.column("block").to_pylist(), lists, strict=True):
            mine = number[start : start + len(own)]
            start += len(own)
            rows.append((block, shard, _pack(mine.astype(np.int64) * shards + shard), _pack(total[mine]), b"", 0, 0, 0))
        real = words != BEGIN
        rows.append((-1, shard, b"", b"", b"", int((total[real] > 0).sum()), int(total[real].sum()), len(words)))
        return pa.Table.from_batches([_batch(rows, ANSWERS + TOTALS)])

    return stored(asked.groupBy("shard").applyInArrow(answer, ANSWERS + TOTALS))


def _numbered(tables: DataFrame, answers: DataFrame, shards: int) -> DataFrame:
    """Blocks with global numbers for words, and their training counts."""

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        words = _open(row["words"], np.uint64)
        numbers, counts = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        given = {r["shard"]: r for r in right.to_pylist()}
        for shard, chosen in _order(words.view(np.int64)[:, None], words, shards):
            numbers[chosen] = _open(given[shard]["numbers"], np.int64)
            counts[chosen] = _open(given[shard]["counts"], np.int64)
        row["words"], row["counts"] = _pack(numbers), _pack(counts)
        return pa.Table.from_pylist([row], schema=left.schema)

    answers = answers.where("block >= 0")
    return stored(tables.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(merge, BLOCKS))


def _routes(keys: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """What decides the shard: the context, and the last word too where the context is common."""
    route = np.zeros(len(keys), dtype=np.uint64)
    for column in keys.T[:-1]:
        route = mix(route + column.astype(np.uint64) + np.uint64(1))
    return np.where(contexts > HOT, mix(route + keys[:, -1].astype(np.uint64) + np.uint64(1)), route)


def _level(block: _Block, order: int, known: list[np.ndarray]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Levels, keys, context totals and own training counts of a block's n-grams of an order. `known`: counts of the
    levels below, as far as they have been answered."""
    levels = block.grams(order)
    numbers = _open(block.row["words"], np.int64)
    paths = numbers[:, None]
    for _, context, last in levels[1:]:
        paths = np.concatenate([paths[context], numbers[last][:, None]], axis=1)
    at, context, _ = levels[-1]
    placed = (at >= 0) & block.training
    own = np.bincount(at[placed], minlength=len(context))
    return levels, paths, known[order - 2][context], own


def _asked(tables: DataFrame, order: int, shards: int) -> DataFrame:
    """Requests for the n-grams of an order from blocks that hold the counts of all shorter ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                known = [_open(x, np.int64) for x in [row["counts"], *(row.get("more") or [])]]
                _, paths, contexts, own = _level(block, order, known)
                yield _batch(_send(block, paths, _routes(paths, contexts), contexts, own, shards), REQUESTS)

    return tables.mapInArrow(work, REQUESTS)


def _answered(asked: DataFrame, order: int, words: int, with_counts: bool) -> DataFrame:
    """Counts and quantised probabilities from each shard's trie."""

    def answer(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        lists = [_open_grams(packed.as_py(), order) for packed in table.column("grams")]
        counts = np.concatenate([_open(x.as_py(), np.int64) for x in table.column("counts")])
        totals = np.concatenate([_open(x.as_py(), np.int64) for x in table.column("contexts")])
        grams = np.concatenate(lists)
        columns = _few(list(grams.T), [words] * order)
        sorting = np.lexsort(columns[::-1])
        new = np.zeros(len(grams), dtype=bool)
        new[:1] = True
        for column in columns:
            column = column[sorting]
            new[1:] |= column[1:] != column[:-1]
        first = np.flatnonzero(new)
        ordered = grams[sorting[first]]
        summed = np.add.reduceat(counts[sorting], first)
        seen = summed > 0
        share = summed[seen] / (totals[sorting[first[seen]]] + WEIGHT[order])
        trie = Trie(ordered[seen], words, share, summed[seen])
        # Blocks ask for the same n-grams; each is searched for once.
        number = np.empty(len(grams), dtype=np.int64)
        number[sorting] = np.cumsum(new) - 1
        codes, found = trie.values(trie.find(ordered))
        rows, start = [], 0
        for block, own in zip(table.column("block").to_pylist(), lists, strict=True):
            mine = number[start : start + len(own)]
            start += len(own)
            rows.append((block, shard, b"", _pack(found[mine]) if with_counts else b"", _pack(codes[mine])))
        return pa.Table.from_batches([_batch(rows, ANSWERS)])

    return asked.groupBy("shard").applyInArrow(answer, ANSWERS)


def _taken(block: _Block, paths: np.ndarray, contexts: np.ndarray, right: list[dict], shards: int) -> tuple[np.ndarray, np.ndarray]:
    counts, codes = np.zeros(len(paths), dtype=np.int64), np.zeros(len(paths), dtype=np.uint16)
    given = {r["shard"]: r for r in right}
    for shard, chosen in _order(paths, _routes(paths, contexts), shards):
        if given[shard]["counts"]:
            counts[chosen] = _open(given[shard]["counts"], np.int64)
        codes[chosen] = _open(given[shard]["codes"], np.uint16)
    return counts, codes


SCORES = "held_out boolean, n_tokens long, n_known long, base_score double, score double"
GROWN = BLOCKS + ", more array<binary>, codes array<binary>"


def _merged(tables: DataFrame, answers: DataFrame, order: int, shards: int) -> DataFrame:
    """Blocks that also hold the counts and codes of an order."""

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = _Block(row)
        known = [_open(x, np.int64) for x in [row["counts"], *(row.get("more") or [])]]
        _, paths, contexts, _ = _level(block, order, known)
        counts, codes = _taken(block, paths, contexts, right.to_pylist(), shards)
        row["more"] = [*(row.get("more") or []), _pack(counts)]
        row["codes"] = [*(row.get("codes") or []), _pack(codes)]
        schema = left.schema if "more" in left.schema.names else left.schema.append(pa.field("more", pa.list_(pa.binary()))).append(pa.field("codes", pa.list_(pa.binary())))
        return pa.Table.from_pylist([row], schema=schema)

    return stored(tables.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(merge, GROWN))


def _scored(tables: DataFrame, answers: DataFrame, ids: DataFrame, order: int, shards: int, tokens: int, words: int) -> DataFrame:
    """Scores of every document, from blocks and the answers for the longest n-grams."""

    kind = to_arrow_type(ids.schema["doc_id"].dataType)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = _Block(row)
        known = [_open(x, np.int64) for x in [row["counts"], *(row.get("more") or [])]]
        codes = [_open(x, np.uint16) for x in row.get("codes") or []]
        levels, paths, contexts, _ = _level(block, order, known)
        codes.append(_taken(block, paths, contexts, right.to_pylist(), shards)[1])
        real = block.depth >= block.lead
        unigram = (known[0] + 1) / (tokens + words + 1)
        base = np.log10(unigram)
        chance = unigram[block.tokens[real]]
        for n in range(2, order + 1):
            at, context, _ = levels[n - 1]
            total = known[n - 2][context][at[real]]
            chance = restored(codes[n - 2])[at[real]] + WEIGHT[n] / (total + WEIGHT[n]) * chance
        which = np.repeat(np.arange(len(block.ids)), block.sizes)
        summed = lambda values: np.bincount(which, weights=values, minlength=len(block.ids))
        here = block.tokens[real]
        rows = zip(
            block.held.tolist(), block.sizes.tolist(), summed(known[0][here] > 0).astype(np.int64).tolist(),
            summed(base[here]).tolist(), summed(np.log10(chance)).tolist(), strict=True,
        )
        scores = _batch(list(rows), SCORES)
        return pa.Table.from_arrays([pa.array(block.ids, kind), *scores.columns], names=["doc_id", *scores.schema.names])

    return tables.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, extended(ids, SCORES))


def score(docs: DataFrame, held_out: Column, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score (the model's log10
    probability) of every text; the model learns from the documents that are not held out.

    Words are split at white space and compared with A-Z in lower case; the end of a text is a token like any other.
    """
    if order < 2:
        raise ValueError("the shortest n-grams are pairs")
    tables = blocks(docs, held_out, order)
    shards = max(16, -(-tables.count() * BLOCK_TOKENS // SHARD_GRAMS))
    words = _words_answered(_words_asked(tables, shards), shards)
    row = words.agg(F.sum("known"), F.sum("total"), F.max("size")).first()
    known, total, size = (int(value or 0) for value in row)
    first, tables = tables, _numbered(tables, words, shards)
    discard(first)
    discard(words)
    for n in range(2, order):
        answers = stored(_answered(_asked(tables, n, shards), n, size * shards, True))
        first, tables = tables, _merged(tables, answers, n, shards)
        discard(first, answers)
    # Stored, the answers outlive what was asked, whose shuffle is the largest.
    answers = stored(_answered(_asked(tables, order, shards), order, size * shards, False))
    scores = _scored(tables, answers, docs.select("doc_id"), order, shards, total, known)
    return scores.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"
    )
