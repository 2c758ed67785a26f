"""Packing, tokenization, chat formatting, vectors, urls and the pipeline."""

import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from brute import smallest_reachable
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from folioscope.llm import bpe, catalogue, chat, packing, urls, vectors

ALPHABET = "aaaabcdefghinost  \n\t' éüß漢字🙂\r.,!?0123456789_-=<|>\x1c\x85"


def odd_texts(n=600):
    chance = random.Random(1)
    texts = ["".join(chance.choices(ALPHABET, k=chance.randint(0, 60))) for _ in range(n)]
    return [
        *texts, None, "", " ", "a" * 5000, "aa" * 33, "<|endoftext|>x <|endoftext|>", "the" * 100, "-" * 160, "!" * 63, " " * 300 + "x",
        "\n" * 7 + "y", "'s't're've'm'll'd it's they'LL", "Ünïcode façade", "word, word. word", " lead", "trail ", "two  spaces",
    ]


@pytest.fixture(scope="session")
def tokenizer(tokenizer_path):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_path)


def encoded(tokenizer, texts):
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


# ---- op6


def test_automaton_encodes_as_the_library(tokenizer, tokenizer_path, corpus):
    texts = odd_texts() + [r["text"] for r in corpus.collect()]
    encoder = bpe.Encoder(bpe.Vocabulary.load(tokenizer_path))
    mine = [np.frombuffer(encoder.encode(t), dtype="<u4").tolist() for t in texts]
    assert mine == encoded(tokenizer, texts)
    assert [encoder.decode(ids) for ids in mine] == [tokenizer.decode(ids, skip_special_tokens=False) for ids in mine]
    assert encoder.decode([220, 122, 50256]) == tokenizer.decode([220, 122, 50256], skip_special_tokens=False)


def test_automaton_takes_small_memories(tokenizer, tokenizer_path, monkeypatch):
    for kind, name in ((bpe.Encoder, "LIMIT"), (bpe.Automaton, "MEMO")):
        monkeypatch.setattr(kind, name, 9)
    encoder = bpe.Encoder(bpe.Vocabulary.load(tokenizer_path))
    texts = odd_texts(80)
    assert [np.frombuffer(encoder.encode(t), dtype="<u4").tolist() for t in texts] == encoded(tokenizer, texts)


def test_automaton_of_few_merges_follows_merge_order():
    ids = {c: i for i, c in enumerate("abc")} | {"ab": 3, "bc": 4, "aa": 5, "abc": 6}
    machine = bpe.Automaton(bpe.Vocabulary(ids, [("b", "c"), ("a", "b"), ("a", "a"), ("ab", "c")], {}))
    spell = {i: t for t, i in ids.items()}
    split = lambda word: [spell[i] for i in np.frombuffer(machine.word(word), dtype="<u4")]
    assert split("abc") == ["a", "bc"] and split("aab") == ["a", "ab"] and split("aaaa") == ["aa", "aa"] and split("aaa") == ["aa", "a"]


def test_beginnings_shared_by_words_are_looked_up_once(tokenizer, tokenizer_path):
    encoder = bpe.Encoder(bpe.Vocabulary.load(tokenizer_path))
    looked_up = []

    class Counted(dict):
        def get(self, key):
            looked_up.append(key)
            return dict.get(self, key)

    encoder.automaton.steps = Counted(encoder.automaton.steps)
    texts = [f"international{end}" for end in ("", "e", "ize", "xq", "ly", "zzz", "s")]
    assert [np.frombuffer(encoder.encode(t), dtype="<u4").tolist() for t in texts] == encoded(tokenizer, texts)
    assert looked_up.count("inter") == 1


def test_odd_white_space_is_split_as_the_tokenizer_does(tokenizer, tokenizer_path):
    encoder = bpe.Encoder(bpe.Vocabulary.load(tokenizer_path))
    chance = random.Random(27)
    texts = ["".join(chance.choice(" \n\t\x0b\x1c\x85\xa0\u3000\u200bab.,'") for _ in range(chance.randint(1, 9))) for _ in range(3000)]
    assert [np.frombuffer(encoder.encode(t), dtype="<u4").tolist() for t in texts] == encoded(tokenizer, texts)


def test_ids_and_texts_as_columns(documents, tokenizer, tokenizer_path):
    texts = odd_texts(40)
    docs = documents(texts)
    rows = bpe.decoded(bpe.encoded(docs, tokenizer_path, "made"), tokenizer_path, "made", "again").collect()
    want = encoded(tokenizer, texts)
    assert {r["doc_id"]: r["made"] for r in rows} == dict(enumerate(want))
    assert all(r["again"] == (texts[r["doc_id"]] or "") and r["ids"] == "x" for r in rows)
    assert bpe.digests(documents([]), tokenizer_path).count() == 0


def test_digests(documents, tokenizer, tokenizer_path):
    texts = odd_texts(60)
    for row in bpe.digests(documents(texts), tokenizer_path).collect():
        ids = encoded(tokenizer, [texts[row["doc_id"]]])[0]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((texts[row["doc_id"]] or "").encode()).hexdigest()


# ---- op4


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing_places_every_token_once(documents, tokenizer, tokenizer_path, capacity, corpus):
    texts = odd_texts(200) + [r["text"] for r in corpus.limit(60).collect()]
    pairs = [*enumerate(texts), (None, "no id"), (5, "a repeated id")]
    rows = packing.pack(documents(pairs), tokenizer_path, capacity, with_ids=True).collect()
    want = sorted((i if i is not None else -1, tuple(ids + [0])) for (i, _), ids in zip(pairs, encoded(tokenizer, [t for _, t in pairs]), strict=True))
    by_document, sequences = {}, {}
    for r in rows:
        assert r["length"] == len(r["ids"]) <= capacity and (r["length"] == capacity or r["piece"] == 0)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        if r["doc_id"] not in (5,):
            by_document.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, ids in want:
        if i != 5:
            own = sorted(by_document[i], key=lambda r: r["piece"])
            assert [r["piece"] for r in own] == list(range(len(own)))
            assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1].tolist()]
            assert tuple(t for r in own for t in r["ids"]) == ids
    total = sum(len(ids) for _, ids in want)
    assert sum(r["length"] for r in rows) == total
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()] and sum(n for _, n in places) <= capacity
    assert len(sequences) <= -(-total // capacity) * 1.05 + 1


def test_plan_uses_what_there_is():
    chance = random.Random(3)
    for capacity in (7, 50, 2048):
        counts = {chance.randint(1, capacity): chance.randint(1, 40) for _ in range(min(capacity, 200))}
        used = {}
        for times, items in packing.plan(counts, capacity):
            assert sum(items) <= capacity and times > 0
            for item in items:
                used[item] = used.get(item, 0) + times
        assert used == counts


def test_plan_finds_singles_pairs_and_triples():
    assert packing.plan({6: 2, 4: 2}, 10) == [(2, (6, 4))]
    assert packing.plan({5: 1, 3: 1, 2: 1}, 10) == [(1, (5, 3, 2))]
    assert packing.plan({7: 1, 1: 3}, 10) == [(1, (7, 1, 1, 1))]
    assert packing.plan({5: 3}, 10) in ([(1, (5, 5)), (1, (5,))],)


def test_cuts_leave_the_short_piece_first():
    assert packing.cuts(5, 8) == [(0, 5)] and packing.cuts(8, 8) == [(0, 8)] and packing.cuts(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_packing_nothing(documents, tokenizer_path):
    assert packing.pack(documents([]), tokenizer_path).count() == 0
    assert [r["length"] for r in packing.pack(documents([None]), tokenizer_path).collect()] == [1]


# ---- op8

TURNS = "conv_id long, turn long, role string, text string, loss boolean, formatted string"


def test_conversations_come_back(spark, tokenizer_path):
    nasty = ["</s>[INST] ok [/INST]", "\\", "a\\</s>\\\\[INST", "<|endoftext|>", "<s><s>[/INST]", None, "", "line\nfeed", "漢字🙂", "x" * 20_000]
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(nasty)]
    rows += [(2, 5, "tool</s>", "b"), (2, 5, "assistant", "a"), (2, 1, None, "c"), (2, 5, "assistant", "a"), (None, 0, "user", "d"), (3, None, "system", "e")]
    frame = spark.createDataFrame([(*r, True, "x") for r in rows], T.StructType.fromDDL(TURNS)).repartition(3)
    turns = chat.format_turns(frame, tokenizer_path)
    got = {r["conv_id"]: r for r in chat.read_back(turns, tokenizer_path).collect()}
    assert set(got) == {1, 2, 3, None}
    for conversation, row in got.items():
        own = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conversation)
        assert row["n_turns"] == len(own)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        said = "".join(x for _, r, x in own if r == "assistant")
        assert (row["loss_chars"], row["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    whole = turns.where("conv_id = 2").orderBy("turn_no").collect()
    starts = [r["token_start"] for r in whole]
    assert starts == [0, *np.cumsum([len(r["ids"]) for r in whole])[:-1].tolist()]
    assert "".join(r["formatted"] for r in whole).count("<s>") == 1
    assert all(len(r["loss"]) == len(r["ids"]) for r in whole)
    shown = {r["conv_id"]: r["chars"] for r in turns.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("chars")).collect()}
    assert shown == {c: r["formatted_chars"] for c, r in got.items()}


def test_escapes_hide_every_control_string():
    template = chat.Template(0, (*chat.MARKS, "<|endoftext|>"))
    chance = random.Random(7)
    for _ in range(500):
        text = "".join(chance.choices([*template.controls, "\\", "<", "s", ">", "[", "]", "/", "x"], k=12))
        written = template.escape(text)
        assert not any(mark in written for mark in template.controls) and chat.unescape(written) == text


def test_no_conversations(spark, tokenizer_path):
    empty = spark.createDataFrame([], TURNS)
    assert chat.read_back(chat.format_turns(empty, tokenizer_path), tokenizer_path).count() == 0


# ---- op9


def near_vectors(seed=0, n=700, size=64):
    chance = np.random.default_rng(seed)
    base = chance.normal(size=(n, size))
    near = base[: n // 3] + chance.normal(size=(n // 3, size)) * chance.uniform(0.05, 0.4, (n // 3, 1))
    return np.concatenate([base, near, base[:50], 3 * base[50:60]])


@pytest.mark.parametrize("deviations", [4.0, None])
def test_near_vectors_are_linked(spark, deviations, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBERS", 40)
    monkeypatch.setattr(vectors, "QUERIES", 60)
    values = near_vectors()
    odd = [None, [], [0.0] * 64, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0], [1e-300] * 64]
    rows = [(i, v.tolist()) for i, v in enumerate(values)] + [(5000 + i, v) for i, v in enumerate(odd)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, _cell string").repartition(4)
    got = {r["vec_id"]: r for r in vectors.near_duplicates(frame, "vec_id", "embedding", per_cell=60, deviations=deviations).collect()}
    unit = values / np.linalg.norm(values, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)]
    group = smallest_reachable(range(len(values)), links)
    found = sum(got[i]["n_links"] for i in range(len(values)))
    if deviations is None:
        assert {i: got[i]["n_links"] for i in range(len(values))} == dict(enumerate(near.sum(axis=1).tolist()))
        assert {i: got[i]["component_id"] for i in range(len(values))} == group
    assert 0.999 * len(links) <= found <= len(links)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    # The two short vectors link with each other, the other odd ones with nothing.
    assert [got[5000 + i]["n_links"] for i in range(9)] == [0, 0, 0, 0, 0, 0, 1, 1, 0]
    assert got[5007]["component_id"] == 5006 and len(got) == len(rows)


def test_lengths_that_the_sample_misses_are_compared(spark):
    chance = np.random.default_rng(23)
    made = [v.tolist() for v in chance.normal(size=(300, 24))]
    for size in range(3, 11):
        own = chance.normal(size=size)
        made += [own.tolist(), (own * 2 + 1e-3).tolist(), (-own).tolist()]
    table = spark.createDataFrame([*enumerate(made)], "id long, v array<double>")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicates(table, "id", "v", sample=16).collect()}
    assert len(got) == 324
    for first in range(300, 324, 3):
        assert [got[first + k] for k in range(3)] == [(1, first), (1, first), (0, first + 2)]


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.near_duplicates(empty, "vec_id", "embedding").count() == 0
    nameless = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    got = vectors.near_duplicates(nameless, "vec_id", "embedding").collect()
    assert sorted(map(repr, map(tuple, got))) == ["(1, 1, 1, True)", "(2, 1, 1, False)", "(None, 0, None, True)", "(None, 0, None, True)"]
    none = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(r["component_id"] for r in vectors.near_duplicates(none, "vec_id", "embedding").collect()) == [1, 2]


# ---- op10


def pages(spark, given):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(given)], "page_id long, url string, rule string, _label string")


def test_hosts_paths_and_rules(spark):
    given = [
        "http://A.Example.ORG/en/12?q#f", "https://example.org/es/", "https://x.example.org/en/2", "https://notexample.org/es/", "http://example.org",
        "http://a.com/fr/1", "http://com/de/", "http://acom/de/", "http://b.com?x=/fr/", "no scheme/fr/", None, "", "://h/p", "a://b://c/d", "http://É.org/Ä",
    ]
    rows = [tuple(r) for r in urls.judge(pages(spark, given), catalogue.URL_RULES).orderBy("page_id").select("host", "path", "rule").collect()]
    assert rows == [
        ("a.example.org", "/en/12", "example.org/en/1"), ("example.org", "/es/", "example.org/es/"), ("x.example.org", "/en/2", "org/"),
        ("notexample.org", "/es/", "org/"), ("example.org", "", None), ("a.com", "/fr/1", "com/fr/"), ("com", "/de/", "com/de/"), ("acom", "/de/", None),
        ("b.com", "", None), ("", "", None), ("", "", None), ("", "", None), ("h", "/p", None), ("b:", "//c/d", None), ("É.org", "/Ä", "org/"),
    ]


def test_trees_learn_lexical_signs(spark):
    chance = random.Random(4)
    good = [f"https://{chance.choice(['news', 'docs', 'blog'])}.site{i}.net/read/{i}" for i in range(400)]
    bad = [f"http://win-{i}-free-{chance.randrange(10**6)}.net/{'a9' * 9}/x?id={i}&ref=1&q=2" for i in range(400)]
    given = [u for pair in zip(good, bad, strict=True) for u in pair]
    frame = pages(spark, given).withColumn("known", F.when(F.col("page_id") < 500, F.col("page_id") % 2).cast("double"))
    rows = urls.judge(frame, [], labelled=F.col("known")).where("page_id >= 500").collect()
    right = sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in rows)
    assert len(rows) == 300 and right >= 290
    seen = urls.held_out(frame, [], labelled=F.col("known")).first()
    assert seen["labelled"] == 500 and 80 < seen["held_out"] < 170 and seen["auc"] > 0.98 and seen["precision"] >= 0.9


def test_labels_without_signs_block_nothing(spark):
    """Labels drawn at random say nothing about other urls, so only the rules block; copies of one url do not either."""
    chance = random.Random(5)
    given = [f"https://h{chance.randrange(10**6)}.site{chance.randrange(10**6)}.net/p/{chance.randrange(10**6)}" for _ in range(900)]
    given = [*given, *[given[0]] * 400]
    rules = [urls.Rule("block", "net", "/q/"), urls.Rule("allow", "net", "/ok/")]
    frame = pages(spark, [*given, "http://a.net/q/1", "http://a.net/ok/1"])
    mark = F.pmod(F.xxhash64("url", F.lit(77)), F.lit(2)).cast("double")
    frame = frame.withColumn("known", F.when(F.pmod(F.xxhash64("url", F.lit(78)), F.lit(3)) > 0, mark))
    seen = urls.held_out(frame, rules, labelled=F.col("known")).first()
    assert seen["labelled"] < 900 and 0.3 < seen["auc"] < 0.7 and seen["cutoff"] is None
    got = urls.judge(frame, rules, labelled=F.col("known")).collect()
    assert [r["url"] for r in got if r["verdict"] == "block"] == ["http://a.net/q/1"] and len(got) == 1302


def test_the_trees_are_fitted_on_every_labelled_url(spark, monkeypatch):
    """More urls of a class than one task of the fit has, and one class that is rare; copies count once."""
    host = F.concat(F.when(F.col("id") % 30 == 0, "win-").otherwise("docs"), "id", F.lit(".net/p"))
    frame = spark.range(24_000).select(F.concat(F.lit("http://"), host).alias("url"), (F.col("id") % 30 == 0).cast("double").alias("known"))
    seen = urls.held_out(frame.union(frame.limit(500)), [], labelled=F.col("known")).first()
    assert seen["labelled"] == 24_000 and 5_500 < seen["held_out"] < 6_500 and seen["auc"] > 0.99
    few = frame.limit(1_500)
    monkeypatch.setattr(urls, "TOGETHER", 100)
    got = urls.judge(few, [], labelled=F.col("known")).collect()
    assert len(got) == 1_500 and all((r["verdict"] == "block") == bool(r["known"]) for r in got)


def test_the_cutoff_is_that_of_plain_running_sums(spark):
    chance = random.Random(6)
    for least in (0.7, 0.9, 1.0):
        made = [(round(chance.random(), 4), float(chance.random() < 0.5)) for _ in range(300)]
        made += [(round(0.8 + chance.random() / 500, 9), float(chance.random() < 0.95)) for _ in range(200)]
        want = (None, None, None)
        for p in sorted({p for p, _ in made if p >= 0.5}, reverse=True):
            above = [label for q, label in made if q >= p]
            if len(above) >= urls.SUPPORT and sum(above) >= least * len(above):
                want = p, sum(above) / len(above), sum(above) / sum(label for _, label in made)
        assert urls._cutoff(spark.createDataFrame(made, "block_probability double, label double"), least) == want


def test_a_label_is_not_described_by_itself(spark):
    """Every labelled url has a suffix of its own, so its suffix says nothing once its own label is left out."""
    given = [f"http://s{i}.net/a" for i in range(40)]
    rows = pages(spark, given).withColumn("known", (F.col("page_id") % 2).cast("double"))
    _, narrow, by_suffix = urls._prepared(rows, [], F.col("known"))
    own = urls._described(narrow, by_suffix, labelled=True).select("f_suffix_blocked").distinct().collect()
    assert [r[0] for r in own] == [0.5]
    every = {r[0] for r in urls._described(narrow, by_suffix, labelled=False).select("f_suffix_blocked").collect()}
    assert every == {1 / 3, 2 / 3}


def test_columns_named_like_the_operators_own_stay(spark):
    frame = spark.createDataFrame([(f"http://{'a' if i % 2 else 'b'}{i}.net/{i}", f"own {i}", i, i % 2) for i in range(60)], "url string, _bad string, f_labels int, _label int")
    got = urls.judge(frame, [urls.Rule("block", "a1.net", "/")], labelled=F.col("_label")).collect()
    assert [list(r.asDict()) for r in got[:1]] == [["url", "_bad", "f_labels", "_label", *urls.ADDED]]
    assert sorted((r["_bad"], r["f_labels"], r["_label"]) for r in got) == sorted((f"own {i}", i, i % 2) for i in range(60))


def test_urls_without_labels_and_no_urls(spark):
    rows = urls.judge(pages(spark, ["http://x.net/a", None]), []).collect()
    assert [(r["rule"], r["verdict"]) for r in rows] == [(None, "allow")] * 2
    assert urls.judge(pages(spark, []).limit(0), catalogue.URL_RULES).count() == 0


def test_host_and_path_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    mine = catalogue.op10_url_filter(spark, folder).select("page_id", "host", "path").collect()
    sql = r"""SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)), regexp_extract(url, '://[^/?#]*([^?#]*)', 1)
              FROM '%s/pages.parquet'"""
    assert sorted(map(tuple, mine)) == sorted(duckdb.sql(sql % folder).fetchall())


# ---- the pipeline


def test_every_stage_takes_what_the_one_before_kept(spark, documents):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, seen = docs.columns, [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2] and seen[-1]
    whole = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in whole} == seen[-1]
    assert sum(r["length"] for r in whole) == docs.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("given", [[], [None, "", " \n ", "short"]])
def test_pipeline_of_little(spark, documents, given):
    docs = documents(given)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() == 0


@pytest.mark.parametrize("name", [n for n in catalogue.SQL])
def test_queries_equal_their_sql(spark, name):
    from compare import connect, difference

    folder = "/root/testdata/sf0.001"
    assert difference(catalogue.QUERIES[name](spark, folder), connect(folder), catalogue.SQL[name]) is None


def test_shared_folder_is_used(spark, documents):
    from folioscope.llm.common import discard, stored
    from folioscope.session import checkpoint_folder

    made = stored(documents(["a"]))
    assert made.inputFiles()[0].removeprefix("file:").lstrip("/").startswith(checkpoint_folder(spark).removeprefix("file:").lstrip("/"))
    discard(made)
    assert not Path(made.inputFiles()[0].removeprefix("file:")).exists()
