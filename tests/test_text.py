"""Tokens, sentences and packing against plain-Python statements of the rules."""

import re

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.functions.english import STOP_WORDS, stem


def run(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, text string")
    return [r[0] for r in rows.select(expression(F.col("text")).alias("x"), "i").orderBy("i").select("x").collect()]


def test_tokens_are_ascii_runs_of_lower_case(spark):
    assert run(spark, ["BB84, a QKD-protocol!", "été 2x", ""], T.tokens) == [
        ["bb84", "a", "qkd", "protocol"],
        ["t", "2x"],
        [],
    ]


def test_term_counts_count_every_occurrence(spark):
    [counted] = run(spark, ["b a b c b"], lambda t: T.term_counts(T.tokens(t)))
    assert {(r["term"], r["tf"]) for r in counted} == {("a", 1), ("b", 3), ("c", 1)}


def test_passage_sentences_need_a_capital(spark):
    assert run(spark, ["See Eq. 4 for it. Then (a) holds. (b) too? Yes"], T.passage_sentences) == [
        ["See Eq. 4 for it.", "Then (a) holds.", "(b) too?", "Yes"]
    ]


def test_answer_sentences_leave_a_trailing_marker_to_the_next_one(spark):
    assert run(spark, [" Claim. [1] Next [2]. "], T.answer_sentences) == [["Claim.", "[1] Next [2]."]]


def spec(text: str, limit: int, overlap: int) -> list[str]:
    """Packing restated with explicit lists."""
    if len(text) <= limit:
        return [text]
    groups, open_group = [], []
    for sentence in [s for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", text) if s.strip()]:
        if open_group and sum(map(len, open_group)) + len(open_group) + len(sentence) > limit:
            groups.append(" ".join(open_group))
            open_group = open_group[-overlap:] if overlap else []
        open_group = [*open_group, sentence]
    groups += [" ".join(open_group)] if open_group else []
    pieces = []
    for group in groups:
        if len(group) <= limit:
            pieces.append(group)
            continue
        line = []
        for word in group.split():
            if line and len(" ".join(line)) + 1 + len(word) > limit:
                pieces.append(" ".join(line))
                line = []
            line.append(word)
        pieces += [" ".join(line)] if line else []
    return pieces


def test_packing_examples(spark):
    sentence = lambda n: "A" + "b" * (n - 2) + "."
    overflow = " ".join([sentence(702), sentence(302), sentence(1002)])
    results = run(spark, ["short", "", "word " * 1000, "x" * 1300, overflow], T.pack)
    assert results[0] == ["short"] and results[1] == [""]
    assert [len(p) for p in results[2]] == [1199] * 4 + [199]
    assert [len(p) for p in results[3]] == [1300]
    assert results[4] == spec(overflow, 1200, 1)


words = st.sampled_from(["Aa", "bb.", "C", "ddd!", "(e)", "é😀?", "longerword", "F."])


@settings(max_examples=8, deadline=None, phases=[Phase.generate])
@given(
    st.lists(st.lists(words, max_size=40).map(" ".join), min_size=1, max_size=12),
    st.integers(8, 40),
    st.integers(0, 3),
)
def test_packing_follows_the_rules(spark, texts, limit, overlap):
    assert run(spark, texts, lambda t: T.pack(t, limit, overlap)) == [spec(t, limit, overlap) for t in texts]


def test_shouted_titles_are_recased_after_every_non_letter(spark):
    titles = ["BELL-TEST OF 2D", "Quantum KEY", "DON'T", "1.2"]
    assert run(spark, titles, T.title_case_if_shouted) == ["Bell-Test Of 2D", "Quantum KEY", "Don'T", "1.2"]


STEMS = {
    "consignment": "consign", "consistency": "consist", "consolatory": "consolatori", "conspicuous": "conspicu",
    "knightly": "knight", "knaves": "knave", "generously": "generous", "generate": "generat", "communication": "communic",
    "happy": "happi", "dying": "die", "skies": "sky", "cries": "cri", "ties": "tie", "gas": "gas", "kiwis": "kiwi",
    "hopping": "hop", "hoping": "hope", "falling": "fall", "agreed": "agre", "feed": "feed", "relational": "relat",
    "rationally": "ration", "by": "by", "say": "say", "enjoy": "enjoy", "keys": "key", "distribution": "distribut",
    "exceeding": "exceed", "nationally": "nation", "goodness": "good", "formative": "format", "electricity": "electr",
    "adoption": "adopt", "replacement": "replac", "rolling": "roll", "cease": "ceas", "rate": "rate", "boyish": "boyish",
}


def test_stems_match_the_published_vocabulary(spark):
    rows = spark.createDataFrame(list(STEMS.items()), "word string, wanted string")
    assert {r["word"]: r["s"] for r in rows.withColumn("s", stem("word")).collect()} == STEMS


def test_stop_words_are_whole():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 127


@pytest.mark.parametrize("space", [" ", " ", "\x1c", "\x0b", "\n"])
def test_every_unicode_space_collapses(spark, space):
    assert run(spark, [f"{space}a{space}{space}b "], T.collapse) == ["a b"]
