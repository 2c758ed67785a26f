"""Metrics, order statistics and reports against plain Python."""

import math
import random
import statistics

import pytest
from pyspark.errors import PySparkException

from folioscope.functions.sizing import Extent
from folioscope.operators import metrics, quantiles
from folioscope.plans import evaluation


def scores(spark, ranked, judged, k, questions=(1,)):
    ranking = spark.createDataFrame([(1, r, d) for r, d in enumerate(ranked, 1)], "query_id long, rank long, doc_id string")
    qrels = spark.createDataFrame([(1, d, g) for d, g in judged.items()], "query_id long, doc_id string, grade int")
    asked = spark.createDataFrame([(q,) for q in questions], "query_id long")
    return {r["query_id"]: r for r in metrics.per_question(ranking, qrels, asked, k).collect()}


def test_metrics_of_one_question(spark):
    row = scores(spark, ["x", "b", "a", "c"], {"a": 2, "b": 1, "c": 1, "d": 3, "e": 0}, 3)[1]
    gain = 1 / math.log2(3) + 2 / math.log2(4)
    ideal = 3 / math.log2(2) + 2 / math.log2(3) + 1 / math.log2(4)
    assert row["recall"] == pytest.approx(2 / 4) and row["mrr"] == 0.5 and row["ndcg"] == pytest.approx(gain / ideal)


def test_questions_without_relevant_documents_count_as_zero(spark):
    rows = scores(spark, ["a"], {"a": 0}, 3, questions=(1, 2))
    assert all((r["recall"], r["mrr"], r["ndcg"]) == (0.0, 0.0, 0.0) for r in rows.values()) and len(rows) == 2
    summary = metrics.means(spark.createDataFrame([(1.0, 0.5, 0.0), (0.0, 0.5, 1.0)], "ndcg double, recall double, mrr double"), [])
    assert summary.first()["ndcg"] == 0.5


def test_averaging_nothing_is_an_error(spark):
    nothing = spark.createDataFrame([], "ndcg double, recall double, mrr double")
    with pytest.raises(PySparkException):
        metrics.means(nothing, []).collect()


def test_anchored_hits(spark):
    hits = spark.createDataFrame(
        [("a", 1, 1, "p", 0), ("a", 1, 2, "q", 3), ("a", 2, 1, "r", 9), ("b", 1, 1, "q", 3)],
        "retriever string, query_id long, rank long, paper_id string, paragraph long",
    )
    asked = spark.createDataFrame([(1, "q", 3), (2, "r", None), (3, "s", 1)], "query_id long, paper_id string, paragraph long")
    rows = {r["retriever"]: r for r in metrics.anchored_hits(hits, asked, ["a", "b", "none"]).collect()}
    assert rows["a"]["paper"] == pytest.approx(2 / 3, abs=1e-6) and rows["a"]["passage"] == 0.5 and rows["a"]["mrr"] == 0.5
    assert rows["b"]["passage"] == 0.5 and rows["none"]["paper"] == 0.0
    unanchored = metrics.anchored_hits(hits, asked.where("paragraph is null"), ["a"]).first()
    assert math.isnan(unanchored["passage"])


@pytest.mark.parametrize("narrow", [False, True])
def test_order_statistics_are_exact(spark, monkeypatch, narrow):
    random.seed(11)
    values = {
        "hot": [random.lognormvariate(0, 3) for _ in range(20_000)],
        "same": [4.0] * 500,
        "few": [5.0, 1.0, 3.0, 2.0],
        "one": [7.5],
        "twenty": [float(i) for i in range(20)],
    }
    if narrow:
        monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 2000)
        monkeypatch.setattr(quantiles, "measure", lambda df: Extent(10**12, 10**15))
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("few", None)], "k string, v double").repartition(4)
    fractions = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = {r["k"]: r for r in quantiles.percentiles(df, ["k"], "v", fractions).collect()}
    middle = {r["k"]: r["median"] for r in quantiles.median(df, ["k"], "v").collect()}
    for k, vs in values.items():
        ordered = sorted(vs)
        assert middle[k] == pytest.approx(statistics.median(vs), rel=1e-15)
        for name, f in fractions.items():
            assert found[k][name] == ordered[min(int(len(vs) * f), len(vs) - 1)], (k, name)


def test_reports(spark):
    checked = spark.createDataFrame([(0, 2, 1.0, False), (3, 1, 0.5, False), (0, 0, 1.0, True)], "invalid long, citations long, grounded double, refused boolean")
    row = evaluation.grounding_report(checked).first()
    assert (row["fabricated"], row["invalid_citations"], row["mean_citations"], row["declined"], row["answered"]) == (1, 3, 1.0, 1, 2)
    table = spark.createDataFrame([("dense", 0.5), ("bm25", 0.25)], "retriever string, mrr double")
    lines = evaluation.markdown_rows(table, "retriever", {"mrr": ("MRR", 3)}, ["bm25", "dense"]).orderBy("line").collect()
    assert [r["text"] for r in lines] == ["| Retriever | MRR |", "|---|---:|", "| `bm25` | 0.250 |", "| `dense` | 0.500 |"]


def test_wide_brackets_are_narrowed_before_anything_is_sorted(spark, monkeypatch):
    rng = random.Random(6)
    values = {"even": [rng.random() for _ in range(4000)], "steep": [math.exp(rng.gauss(0, 8)) for _ in range(4001)], "flat": [2.5] * 3000 + [7.0]}
    rows = spark.createDataFrame([(g, v) for g, own in values.items() for v in own], "g string, v double").repartition(5)
    monkeypatch.setattr(quantiles, "SORTED_ROWS", 3)
    monkeypatch.setattr(quantiles, "BINS", 8)
    got = {r["g"]: r for r in quantiles.percentiles(rows, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p95": 0.95}).collect()}
    for g, own in values.items():
        own = sorted(own)
        assert [got[g][p] for p in ("p10", "p50", "p95")] == [own[min(int(len(own) * f), len(own) - 1)] for f in (0.1, 0.5, 0.95)]
