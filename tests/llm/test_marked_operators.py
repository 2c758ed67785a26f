"""Fill-in-middle, decontamination and the prefix trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import UPPER
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.llm import decontamination, infill, turns
from folioscope.llm.fmindex import Bits, Index, Wavelet, suffix_order

ODD = [None, "", " \n", "a", "é", "漢字", "\U0001f600" * 5, "x<P>y", "a <S", "<M", "S>", "tail <", "word " * 30_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- op11


def plain_infill(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), max_size=12), st.integers(0, 3))
def test_ends_of_code_points(texts, skipped):
    array = pa.array(texts, pa.string()).slice(min(skipped, len(texts)))
    data, offsets = infill._buffer(array)
    units = infill.Units(data)
    ranks = units.before(offsets)
    texts = texts[min(skipped, len(texts)) :]
    assert np.diff(ranks).tolist() == [len(t) for t in texts]
    for i, text in enumerate(texts):
        want = [len(text[: k + 1].encode()) for k in range(len(text))]
        got = units.after(ranks[i] + 1 + np.arange(len(text))) - offsets[i] if text else np.empty(0)
        assert got.tolist() == want


def test_documents_are_cut_and_restored(documents, corpus):
    rows = [*enumerate(ODD), (None, "no id at all"), (3, "a repeated id"), (3, "a repeated id")]
    rows += [(100 + i, "".join(chr(random.Random(i).choice([97, 233, 0x6F22, 0x1F600])) * 3 for _ in range(i))) for i in range(150)]
    docs = documents(rows).withColumns({"_drawn": F.lit("mine"), "form": F.lit("mine")})
    cut = infill.transformed(docs)
    assert cut.columns == [*[c for c in docs.columns if c != "form"], "n", "form", "prefix_chars", "middle_chars", "output"]
    got = cut.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, t, *plain_infill(i, t)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr) == want
    assert all(r["back"] == (r["text"] or "") and r["_drawn"] == "mine" for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    whole = {r["doc_id"]: r for r in infill.digests(corpus).collect()}
    for doc_id, text in corpus.select("doc_id", "text").collect():
        n, form, head, middle, output = plain_infill(doc_id, text)
        assert tuple(whole[doc_id]) == (doc_id, n, form, head, middle, sha(output), sha(text or ""))


def test_nothing_to_cut(documents):
    assert infill.digests(documents([])).count() == 0
    assert [tuple(r)[1:4] for r in infill.digests(documents([None, ""])).collect()] == [(0, "plain", None)] * 2


# ---- op12


def test_suffixes_in_order():
    chance = np.random.default_rng(5)
    for size, n in ((2, 1), (2, 40), (3, 500), (50, 700), (4, 3000)):
        symbols = chance.integers(0, size, n).astype(np.int64)
        if n == 3000:
            symbols = np.tile(symbols[:300] + 1, 10)  # a repeat of one text without breaks
        symbols = np.append(symbols, 0)
        unique = np.cumsum(symbols == 0) - 1
        keys = [[(1, s) if s else (0, unique[i + k]) for k, s in enumerate(symbols[i:].tolist())] for i in range(len(symbols))]
        assert suffix_order(symbols).tolist() == sorted(range(len(symbols)), key=keys.__getitem__)


def test_ranks_and_symbols_of_a_wavelet_matrix():
    chance = np.random.default_rng(6)
    bits = chance.random(1000) < 0.3
    packed = Bits(bits)
    assert packed.ones(np.arange(1001)).tolist() == [0, *np.cumsum(bits).tolist()]
    assert (packed.at(np.arange(1000)) == bits).all()
    symbols = chance.integers(0, 37, 1000)
    tree = Wavelet(symbols, 6)
    assert (tree.read(np.arange(1000))[0] == symbols).all()
    asked, places = chance.integers(0, 37, 200), chance.integers(0, 1001, 200)
    ranks = tree.down(asked, places) - tree.down(asked, np.zeros(200, dtype=np.int64))
    assert ranks.tolist() == [int((symbols[:p] == s).sum()) for s, p in zip(asked, places, strict=True)]


def test_every_occurrence_is_located():
    chance = np.random.default_rng(7)
    symbols = np.append(chance.integers(0, 5, 2000), 0)
    index = Index(symbols, 5)
    text = symbols.tolist()
    for length in (1, 2, 3, 5):
        phrase = chance.integers(1, 5, length)
        low, high = index.search(phrase[None, ::-1], np.array([length]))
        want = [i for i in range(len(text)) if text[i : i + length] == phrase.tolist()]
        assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == want


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER))


def plain_hits(text, items, width=10):
    words, hit, found = plain_words(text), set(), set()
    for item, passage in items:
        own = plain_words(passage)
        size = min(width, len(own))
        held = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in held:
                hit.update(range(i, i + size))
                if item is not None:
                    found.add(item)
    return len(words), hit, sorted(map(str, found))


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 1 << 24), (50, 300)])
def test_benchmark_windows_are_found(spark, documents, shard, block):
    chance = random.Random(8)
    text = lambda n: " ".join(chance.choice(("ab", "Cd", "éF", "x1", "漢", "zz")) for _ in range(n))
    items = [(i, text(chance.choice((3, 9, 10, 11, 14, 25)))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "--"), (None, "An item without any id, of just twelve words in a row"), (3, text(12)), (7, items[9][1])]
    texts = [*ODD[:8], *(text(chance.randrange(120)) for _ in range(40)), "one two an ITEM without any id of just twelve words in a row"]
    for k in range(30):
        texts.append(f"{text(k)}; {items[k][1].upper()}... {text(5)}, {items[(k * 3) % 40][1]}")
    texts += [texts[-1], texts[-1], "unknown words only here", "z-" * 5000]
    docs = documents(texts).withColumns({"spans": F.lit("mine"), "length": F.lit(1)})
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontamination.searched(docs, benchmark, shard=shard, block=block)
    assert got.columns == [*[c for c in docs.columns if c not in ("n_words", "spans")], "n_words", "spans", "items"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert len(rows) == len(texts)
    for i, own in enumerate(texts):
        n, hit, found = plain_hits(own, items)
        row = rows[i]
        assert (row["n_words"], sorted(map(str, row["items"])), row["text"]) == (n, found, own)
        assert [w for s in row["spans"] for w in range(s["from"], s["to"])] == sorted(hit)
        assert all(a["to"] < b["from"] for a, b in zip(row["spans"], row["spans"][1:]))
    digest = {r["doc_id"]: r for r in decontamination.digests(docs, benchmark).collect()}
    for i, own in enumerate(texts):
        n, hit, found = plain_hits(own, items)
        assert tuple(digest[i]) == (i, n, len(hit), len(found), sha(",".join(found)), bool(hit))


def test_benchmark_words_are_cut_out(spark, documents):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")]
    texts = [f"before, {items[0][1].title()}! After it.", items[0][1], "nothing of it", None, "", "alpha beta gamma", f"x {items[0][1]}"]
    docs, benchmark = documents(texts), spark.createDataFrame(items, "item_id long, text string")
    kept = decontamination.cleaned(docs, benchmark)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert {i: r["text"] for i, r in rows.items()} == {0: "before, After it.", 2: texts[2], 3: None, 4: "", 5: texts[5], 6: "x "}
    assert rows[0]["n_chars"] == 17 and rows[0]["n_words"] == "x"


def test_decontamination_of_and_by_nothing(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.searched(documents([]), none).count() == 0
    rows = decontamination.digests(documents(["some words", None]), none).collect()
    assert sorted(tuple(r)[1:] for r in rows) == [(0, 0, 0, sha(""), False), (2, 0, 0, sha(""), False)]


# ---- op13


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
        ends[tuple(paths[c])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) or 1
        weight = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        saved[node] = weight + sum(saved[k] for k in children[node])
    return {
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(",".join(map(str, ends[n]))))
        for n, m in members.items()
    }


def conversation_rows(n, seed):
    chance, rows = random.Random(seed), []
    for c in range(n):
        for turn in range(chance.randrange(12) if c % 7 else 9):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", "hi" if c % 3 else chance.choice(("é", "yes", "no", ""))))
    rows += [(c, t, "user", "hi") for c in range(1000, 1100) for t in range(4)]  # one very common conversation
    rows += [(2000, t, "user", f"long {t}") for t in range(300)]
    rows += [(7, None, "user", "first"), (8, 1, None, None), (8, 1, None, None), (None, 1, "user", "no id"), (9, 2, "a", "tie"), (9, 2, "b", "tie")]
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{}, {"shard": 5, "queue": 3, "piece": 2}])
def test_trie_of_conversations(spark, sizes):
    rows = conversation_rows(200, 9)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    table = table.selectExpr("*", "'x' AS depth", "'x' AS level", "'x' AS k1", "'x' AS shard")
    got = [tuple(r) for r in turns.shared_heads(table, **sizes).collect()]
    want = plain_trie(rows)
    assert len(got) == len(want) and set(got) == want


def test_trie_of_no_conversations(spark):
    assert turns.shared_heads(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    # Conversation 1 has no conversation 0 to start from, and its own turn may lie before its head.
    rows = [(1, 0, "user", "only")]
    got = turns.shared_heads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {tuple(r) for r in got} == plain_trie(rows)


def test_queue_spills_and_keeps_its_order():
    chance = random.Random(10)
    queue, put = turns.SpillingQueue(limit=50), []
    for i in range(1000):
        put.append((0, chance.randrange(40), chance.randrange(3), 1, i, 0))
        queue.put(put[-1])
    assert queue.files
    taken = [m for d in range(40) for c in range(3) for m in queue.take((0, d, c))]
    assert [m[:3] for m in taken] == sorted(m[:3] for m in put) and sorted(taken) == sorted(put)
    assert not len(queue) and not queue.files
