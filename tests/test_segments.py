"""Index segments: incremental ingestion, removal, merging, conflicts, and pruned ranking."""

import random
from pathlib import Path

import pytest

from folioscope.functions.sizing import Extent
from folioscope.operators import lexical, segments
from folioscope.sources.commits import Conflict


@pytest.fixture(scope="module")
def corpus(spark):
    chance = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(chance.choices(words, range(60, 0, -1), k=int(chance.lognormvariate(3, 1)) + 1)) for _ in range(400)]
    return spark.createDataFrame([*enumerate([*texts, "", None])], "chunk_id long, text string")


@pytest.fixture(scope="module")
def questions(spark):
    chance = random.Random(13)
    texts = [" ".join(f"w{chance.randrange(60)}" for _ in range(chance.randrange(1, 6))) for _ in range(15)]
    return spark.createDataFrame([*enumerate([*texts, "w1 w1 w50", "", "unknown", None])], "query_id long, text string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_rank_like_one_index(spark, corpus, questions, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "GROUP", 4)
    index = segments.SegmentedIndex(spark, str(tmp_path), buckets=8)
    index.add(corpus.where("chunk_id < 250"))
    files = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("*.parquet")}
    index.add(corpus.where("chunk_id >= 250"))
    assert len(index.state().segments) == 2 and all(p.stat().st_mtime_ns == t for p, t in files.items())
    want = rows(lexical.search(corpus, questions, 5))
    assert rows(segments.search(index, questions, 5)) == want
    assert rows(segments.search(index, questions, 5, extent=Extent(10**9, 10**12))) == want
    counts = segments.pruning(index, questions, 5).first()
    assert 0 < counts["scored"] < counts["postings"]


def test_removed_chunks_and_merged_segments(spark, corpus, questions, tmp_path):
    index = segments.SegmentedIndex(spark, str(tmp_path), buckets=8)
    for part in ("chunk_id < 200", "chunk_id BETWEEN 200 AND 299", "chunk_id >= 300"):
        index.add(corpus.where(part))
    index.remove(corpus.where("chunk_id % 3 = 0"))
    left = corpus.where("chunk_id % 3 <> 0")
    want = rows(lexical.search(left, questions, 8))
    assert rows(segments.search(index, questions, 8)) == want
    index.merge(below=150)
    assert [s.chunks for s in index.state().segments] == [200, 135]
    assert rows(segments.search(index, questions, 8)) == want
    # What was removed may come back, and is then found again.
    index.add(corpus.where("chunk_id % 3 = 0"))
    assert rows(segments.search(index, questions, 8)) == rows(lexical.search(corpus, questions, 8))


def test_two_writers_do_not_undo_each_other(spark, corpus, tmp_path, monkeypatch):
    index = segments.SegmentedIndex(spark, str(tmp_path), buckets=2)
    before = index.state()
    index.add(corpus.where("chunk_id < 5"))
    monkeypatch.setattr(index, "state", lambda: before)
    with pytest.raises(Conflict):
        index.add(corpus.where("chunk_id BETWEEN 5 AND 9"))
    monkeypatch.undo()
    assert [s.chunks for s in index.state().segments] == [5]
    # A commit that was begun and not finished is passed over by readers.
    (tmp_path / "commits" / f"{2:012d}").touch()
    assert index.state().number == 1


def test_an_index_without_segments(spark, questions, tmp_path):
    assert segments.search(segments.SegmentedIndex(spark, str(tmp_path)), questions).count() == 0


def test_scores_are_summed_within_groups_whatever_identifiers_repeat(spark, tmp_path):
    from pyspark.sql import functions as F

    from folioscope.functions.sizing import measure
    from folioscope.operators import lexical, segments

    texts = ["heat moves", "heat moves through metal and water and air and stone for a long while " * 3, "water boils", "cold metal", "heat in water"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[1]), (0, texts[2])]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "heat in metal"), (2, "boiling water"), (None, "heat")], "query_id long, text string").where("query_id is not null")
    index = segments.SegmentedIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(chunks)
    assert sorted(segments.search(index, asked, 3).collect()) == sorted(lexical.search(chunks, asked, 3, index=lexical.build_index(chunks)).collect())
    state = index.state()
    plan = segments.planned(index, state, asked, measure(asked))
    scored = segments._scored(plan, index, state, plan.bounds)
    shuffles = scored._jdf.queryExecution().executedPlan().toString()
    assert shuffles.count("Exchange hashpartitioning(segment") == 1 and "Exchange hashpartitioning(query_id" not in shuffles
    assert scored.agg(F.count("*")).first()[0] == scored.select("query_id", "chunk_id").distinct().count()
