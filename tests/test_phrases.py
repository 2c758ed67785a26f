"""Phrases, exclusions and cover density against what the published ranking gives, worked out by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.functions.sizing import Extent
from folioscope.operators import phrases

CHUNKS = [
    (1, "alpha beta gamma"),
    (2, "beta alpha gamma alpha beta"),
    (3, "alpha x beta and gamma delta"),
    (4, "the running dogs of the house"),
    (5, "A dog runs through its houses; the dog of a house."),
    (6, ""),
    (7, None),
    (8, "alpha alpha alpha"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, text string")


def ranked(spark, index, text, **options):
    questions = spark.createDataFrame([(1, text)], "query_id long, text string")
    return {r["chunk_id"]: r["score"] for r in phrases.search(index, questions, 10, **options).collect()}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('"alpha beta"', {1: 0.1, 2: 0.1}),
        ('"alpha beta', {1: 0.1, 2: 0.1}),  # a quote that is not closed
        ("alpha beta", {1: 0.2, 2: 0.4, 3: 0.2, 8: 0.3}),
        ('"alpha beta" alpha', {1: 0.1, 2: 0.2, 3: 0.1, 8: 0.3}),  # the word alone is the shorter cover
        ('"alpha beta" gamma', {1: 0.2, 2: 0.2, 3: 0.1}),
        ('"alpha alpha"', {8: 0.2}),
        ('"nothing here" -alpha', {}),
        # Beside an exclusion, other lexemes are covers of their own.
        ('"alpha beta" -gamma', {1: 0.2, 2: 0.4, 3: 0.2, 8: 0.3}),
        ("gamma -alpha", {1: 0.1, 2: 0.1, 3: 0.1}),
        ("", {}),
        ("- -- \"\" '", {}),
    ],
)
def test_covers_of_words_as_they_are(spark, chunks, text, want):
    index = phrases.LexemeIndex.build(chunks, english=False)
    assert ranked(spark, index, text) == want


def test_strict_exclusions_leave_chunks_out(spark, chunks):
    index = phrases.LexemeIndex.build(chunks, english=False)
    assert ranked(spark, index, 'alpha -"alpha beta"', strict=True) == {3: 0.1, 8: 0.3}
    assert ranked(spark, index, "alpha - gamma", strict=True) == {8: 0.3}
    assert ranked(spark, index, "alpha well-known -delta-beta", strict=True) == {1: 0.1, 2: 0.2, 3: 0.1, 8: 0.3}


def test_stems_and_stop_words_in_phrases(spark, chunks):
    index = phrases.LexemeIndex.build(chunks)
    assert ranked(spark, index, '"runs dog"') == {4: 0.1}
    # One word without a lexeme of the question lies in the cover.
    assert ranked(spark, index, '"dog of house"') == {}
    assert ranked(spark, index, '"dogs of the house"') == {4: pytest.approx(0.1 / 3, abs=1e-6), 5: pytest.approx(0.1 / 3, abs=1e-6)}
    assert ranked(spark, index, '"the of" and') == {}


def test_stored_and_shuffled_postings_give_the_same(spark, chunks, tmp_path):
    phrases.LexemeIndex.build(chunks).save(str(tmp_path / "lexemes"), buckets=4)
    stored = phrases.LexemeIndex.load(spark, str(tmp_path / "lexemes"), buckets=4)
    built = phrases.LexemeIndex.build(chunks)
    text = '"alpha beta" dogs -gamma house'
    want = ranked(spark, built, text)
    assert want and ranked(spark, stored, text) == want
    assert ranked(spark, stored, text, extent=Extent(10**9, 10**12)) == want
    plan = phrases.scores(stored, spark.createDataFrame([(1, "alpha")], "query_id long, text string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan


def test_covers_against_a_plain_version(spark):
    chance = random.Random(3)
    texts = {i: " ".join(chance.choice("abcd") for _ in range(chance.randrange(25))) for i in range(40)}
    asked = {q: " ".join(chance.choice(['"a b"', "c", '"b c d"', "-d", '-"a a"', '"a a"', "e"]) for _ in range(3)) for q in range(30)}
    index = phrases.LexemeIndex.build(spark.createDataFrame([*texts.items()], "chunk_id long, text string"), english=False)
    questions = spark.createDataFrame([*asked.items()], "query_id long, text string")
    got = {(r[0], r[1]): r[2] for r in phrases.scores(index, questions).select("query_id", "chunk_id", F.round("score", 6)).collect()}
    want = {}
    for q, question in asked.items():
        tokens = re.findall(r'-?"[^"]*"|\S+', question)
        positive = [t.strip('"').split() for t in tokens if t[0] != "-"]
        negative = [t[1:].strip('"').split() for t in tokens if t[0] == "-"]
        known = {w for words in positive + negative for w in words}
        for i, text in texts.items():
            words = text.split()
            held = lambda own, part: any(part[k : k + len(own)] == own for k in range(len(part) - len(own) + 1))
            true = lambda part: any(held(p, part) for p in positive) or any(not held(n, part) for n in negative)
            spans = [(a, b) for a in range(len(words)) for b in range(a, min(len(words), a + 3)) if words[a] in known and words[b] in known and true(words[a : b + 1])]
            spans = [s for s in spans if all(w in known for w in words[s[0] : s[1] + 1])]
            least = [s for s in spans if not any(o != s and o[0] >= s[0] and o[1] <= s[1] for o in spans)]
            if least:
                want[q, i] = round(0.1 * len(least), 6)
    assert got == want
