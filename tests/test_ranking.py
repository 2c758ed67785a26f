"""Retrieval operators against brute force, on both of their physical paths."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions.sizing import Extent, measure, spread_join, top_ranked
from folioscope.functions.text import question_terms
from folioscope.functions.vectors import hashed
from folioscope.operators import dense, fulltext, lexical
from folioscope.operators.fusion import fuse
from folioscope.operators.rerank import rerank
from folioscope.plans import retrieval
from folioscope.plugins import OverlapScorer

HUGE = Extent(10**12, 10**15)
random.seed(7)
VOCABULARY = ["the", "the", "the", "key", "rate", "photon", "bell", "decoy", "state", "x1"]
TEXTS = {i: " ".join(random.choices(VOCABULARY, k=random.randint(0, 25))) for i in range(60)}
ASKED = {100: "the KEY rate, key!", 101: "photon bell", 102: "unknown words only", 103: "the", 104: ""}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(list(TEXTS.items()), "chunk_id long, text string").persist()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(ASKED.items()), "query_id long, text string").persist()


def expected(limit, library=False):
    docs = {i: t.split() for i, t in TEXTS.items()}
    df = Counter(w for words in docs.values() for w in set(words))
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    if library:
        plain = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
        floor = 0.25 * sum(plain.values()) / len(plain)
        idf = {w: floor if v < 0 else v for w, v in plain.items()}
    rows = []
    for q, text in ASKED.items():
        asked = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        scores = {
            i: round(sum(idf.get(w, 0) * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / mean)) for w in asked if w in words), 6)
            for i, words in docs.items()
        }
        ranked = sorted((i for i in scores if scores[i] > 0), key=lambda i: (-scores[i], i))[:limit]
        rows += [(q, r, i, scores[i]) for r, i in enumerate(ranked, 1)]
    return sorted(rows)


def found(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("library", [False, True])
def test_bm25_paths_agree_with_brute_force(spark, chunks, questions, library, tmp_path):
    wanted = expected(10, library)
    assert found(lexical.search(chunks, questions, 10, library=library)) == wanted
    assert found(lexical.search(chunks, questions, 10, extent=HUGE, library=library)) == wanted
    lexical.build_index(chunks).save(str(tmp_path))
    stored = lexical.TermIndex.load(spark, str(tmp_path))
    assert found(lexical.search(chunks, questions, 10, index=stored, library=library)) == wanted


def test_weights_are_positive_and_rare_terms_weigh_more(chunks):
    idf = {r["term"]: r["idf"] for r in lexical.term_stats(lexical.build_index(chunks)).collect()}
    assert min(idf.values()) > 0 and idf["bell"] > idf["the"]


def test_an_empty_corpus_ranks_nothing(spark, questions):
    nothing = spark.createDataFrame([], "chunk_id long, text string")
    assert found(lexical.search(nothing, questions, 5)) == []
    assert found(lexical.search(nothing, questions, 5, extent=HUGE)) == []


def test_zero_scored_chunks_fill_the_list_in_id_order(chunks, questions):
    ranking = lexical.search(chunks, questions, 20)
    full = lexical.keep_zero(ranking, chunks, questions, 20)
    rows = found(full)
    assert all([r[1] for r in rows if r[0] == q] == list(range(1, 21)) for q in ASKED)
    assert [r[2] for r in rows if r[0] == 102] == list(range(20))
    assert [r for r in rows if r[3] > 0] == found(ranking)


def test_full_text_paths_agree(chunks, questions):
    few = found(fulltext.search(chunks, questions, 10))
    assert few and few == found(fulltext.search(chunks, questions, 10, extent=HUGE))
    by_hand = Counter({i: t.split().count("photon") + t.split().count("bell") for i, t in TEXTS.items()})
    top = sorted((i for i in by_hand if by_hand[i]), key=lambda i: (-by_hand[i], i))[:10]
    assert [(r[2], r[3]) for r in few if r[0] == 101] == [(i, round(by_hand[i] * 0.1, 6)) for i in top]
    assert not [r for r in few if r[0] == 103]


def test_nearest_neighbours_by_broadcast_and_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    raw = rng.normal(size=(300, 8))
    raw[10] = raw[20] = raw[30]
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(unit)], "chunk_id long, embedding array<float>")
    asked = rows.withColumnRenamed("chunk_id", "query_id")
    single = unit.astype(np.float32).astype(float)
    similarity = np.round(single @ single.T, 6) + 0.0
    wanted = sorted(
        (q, r, i, similarity[q, i])
        for q in range(300)
        for r, i in enumerate(sorted(range(300), key=lambda i: (-similarity[q, i], i))[:7], 1)
    )
    assert found(dense.search(rows, asked, 7)) == wanted
    monkeypatch.setattr(dense, "QUERY_BLOCK", 90)
    monkeypatch.setattr(dense, "CORPUS_BLOCK", 70)
    monkeypatch.setattr(dense, "QUERY_PIECE", 40)
    monkeypatch.setattr(dense, "CHUNK_PIECE", 13)
    assert found(dense.search(rows, asked, 7, by_blocks=True)) == wanted
    assert found(dense.search(rows, asked, 7)) == wanted


def test_spread_join_keeps_every_row_of_a_hot_key(spark):
    large = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    small = large.select("k").distinct().withColumn("v", F.col("k") * 2)
    for how in ("inner", "left", "left_semi"):
        joined = [sorted(map(tuple, spread_join(large, small.where("k < 500"), ["k"], fits, ["id"], how).collect())) for fits in (True, False)]
        assert joined[0] == joined[1] and len(joined[0]) == (1000 if how == "left" else len(joined[0]))


def test_measure_counts_rows_and_bytes(spark):
    df = spark.createDataFrame([("ab", [1.0, 2.0]), (None, None)], "t string, v array<float>")
    assert measure(df) == Extent(2, 10)


def ranking(spark, *chunk_ids):
    return spark.createDataFrame([(1, r, c, 0.0) for r, c in enumerate(chunk_ids, 1)], "query_id long, rank long, chunk_id long, score double")


def order(df):
    return [r["chunk_id"] for r in df.orderBy("rank").collect()]


def test_a_chunk_in_both_lists_wins(spark):
    assert order(fuse([ranking(spark, 1, 2, 3), ranking(spark, 3, 4)]))[0] == 3


def test_a_tie_goes_to_the_chunk_seen_first(spark):
    assert order(fuse([ranking(spark, 9, 5), ranking(spark, 1, 2)])) == [9, 1, 5, 2]


def test_a_small_k_favours_the_top(spark):
    lists = [ranking(spark, 1, 2, 3), ranking(spark, 4, 2, 5)]
    assert order(fuse(lists, k=60))[0] == 2 and order(fuse(lists, k=0))[0] in (1, 2)
    [first] = fuse(lists).where("rank = 1").collect()
    assert first["score"] == round(2 / 62, 9)


def test_rerank_rescored_head_goes_before_the_untouched_tail(spark):
    chunks = spark.createDataFrame([(1, "nothing"), (2, "key"), (3, "key rate"), (4, "key rate bell")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "key rate bell")], "query_id long, text string")
    base = ranking(spark, 1, 2, 3, 4).withColumn("score", F.col("chunk_id") / 1000)
    for extent in (measure(asked), HUGE):
        done = rerank(base, asked, chunks, OverlapScorer(), extent, depth=3)
        assert order(done) == [3, 2, 1, 4]
        assert [r["score"] for r in done.orderBy("rank").collect()] == [0.666667, 0.333333, 0.0, 0.004]


def test_search_is_the_composition(chunks, questions):
    corpus = retrieval.Corpus(chunks)
    top = retrieval.passages(corpus, questions, top_k=3).collect()
    assert {r["query_id"] for r in top} == {100, 101, 102, 103}
    assert sorted({r["number"] for r in top}) == [1, 2, 3] and all(TEXTS[r["chunk_id"]] == r["text"] for r in top)
    with pytest.raises(ValueError):
        retrieval.passages(corpus, questions, top_k=21)


def test_question_terms_count_repeats(questions):
    counted = {(r["query_id"], r["term"]): r["qtf"] for r in question_terms(questions).collect()}
    assert counted[(100, "key")] == 2 and (104, "") not in counted


@pytest.mark.parametrize("kind", ["string", "hash"])
def test_identifiers_of_any_type_rank_alike_on_every_path(spark, tmp_path, kind):
    name = (lambda i: f"doc-{i:04d}") if kind == "string" else (lambda i: i * 1_152_921_504_606_846 - (1 << 62))
    texts = ["heat moves through metal", "metal bends when heat is high", "water boils", "heat and water", "metal heat metal", "nothing here"]
    plain = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    type_of = "string" if kind == "string" else "long"
    named = spark.createDataFrame([(name(i), t) for i, t in enumerate(texts)], f"chunk_id {type_of}, text string")
    asked = spark.createDataFrame([(name(k), q) for k, q in enumerate(["heat in metal", "boiling water and heat"])], f"query_id {type_of}, text string")
    want = [(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in lexical.search(plain, asked, 4).collect()]
    want = sorted((q, r, name(c), s) for q, r, c, s in want)
    lexical.build_index(named).save(str(tmp_path / "index"), buckets=4)
    stored = lexical.TermIndex.load(spark, str(tmp_path / "index"), buckets=4)
    huge = Extent(10**9, 10**12)
    for found in (lexical.search(named, asked, 4), lexical.search(named, asked, 4, extent=huge), lexical.search(named, asked, 4, index=stored)):
        assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in found.collect()) == want
    vectors = hashed(named, "text").select("chunk_id", "embedding")
    queries = hashed(asked, "text").select("query_id", "embedding")
    paths = [dense.search(vectors, queries, 3, by_blocks=way).collect() for way in (False, True)]
    assert sorted(paths[0]) == sorted(paths[1]) and {r["query_id"] for r in paths[0]} == {name(0), name(1)}


def test_planned_queries_keep_questions_apart_whatever_their_identifiers(spark):
    from folioscope.plans import answering
    from folioscope.plans.retrieval import Corpus

    texts = ["heat moves through metal slowly", "water boils at high heat", "metal bends when it is hot", "ice melts in water"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    ids = [(1 << 62) + 5, -(1 << 61)]
    asked = spark.createDataFrame([(ids[0], "Compare how heat moves in metal and how water boils at heat"), (ids[1], "when does ice melt in water")], "query_id long, text string")
    got = answering.gather(Corpus(chunks), asked, reranked=False).collect()
    assert {r["query_id"] for r in got} == set(ids)
    for i in ids:
        assert sorted(r["number"] for r in got if r["query_id"] == i) == list(range(1, 1 + sum(r["query_id"] == i for r in got)))


def test_what_many_tasks_kept_is_cut_in_two_steps(spark):
    rows = spark.range(5000).selectExpr("id % 2 AS g", "id AS chunk_id", "pmod(id * 37, 101) * 1.0 AS score").repartition(16)
    order = [F.col("score").desc(), F.col("chunk_id").asc()]
    once, twice = (top_ranked(rows, ["g"], order, 7, spread=s) for s in (None, "chunk_id"))
    assert sorted(once.collect()) == sorted(twice.collect())


def test_best_looks_at_what_reaches_the_kth_best_alone(monkeypatch):
    chance = np.random.default_rng(3)
    similarity = np.round(chance.normal(size=(30, 900)), 2)
    similarity[:5] = 0.0  # equal scores: the lowest identifiers
    similarity[5, 100:] = -0.0000001
    ids = chance.permutation(900)
    sorted_in = []
    take = dense.Best._take
    monkeypatch.setattr(dense.Best, "_take", lambda self, s, c, at: sorted_in.append(int(np.isfinite(s).sum())) or take(self, s, c, at))
    best = dense.Best(np.arange(30), 10)
    for start in range(0, 900, 60):
        for rows in (slice(0, 17), slice(17, 30)):
            best.add(similarity[rows, start : start + 60], ids[start : start + 60], rows)
    got = best.rows().to_pydict()
    want = []
    for q, row in enumerate(similarity):
        order = sorted(range(900), key=lambda i: (-(round(row[i], 6) + 0.0), ids[i]))[:10]
        want += [(q, int(ids[i]), round(row[i], 6) + 0.0) for i in order]
    assert list(zip(got["query_id"], got["chunk_id"], got["score"], strict=True)) == want
    assert sum(sorted_in) < 30 * 900 / 4
