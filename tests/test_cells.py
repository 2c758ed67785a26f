"""Cells of vectors against exact search."""

import numpy as np
import pytest

from folioscope.operators import cells, dense


@pytest.fixture(scope="module")
def vectors(spark):
    chance = np.random.default_rng(5)
    centres = chance.normal(size=(12, 16))
    made = np.concatenate([centres[i % 12] + 0.5 * chance.normal(size=(1, 16)) for i in range(600)] + [centres[:1]] * 5)
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    rows = [(f"v{i}", v.tolist()) for i, v in enumerate(made)]
    return spark.createDataFrame([*rows, ("none", None)], "chunk_id string, embedding array<double>")


def ranking(df):
    return sorted(tuple(r) for r in df.collect())


def test_all_cells_give_the_exact_ranking(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "PART", 20)
    monkeypatch.setattr(cells, "QUERIES", 15)
    index = cells.CellIndex.save(vectors, str(tmp_path / "index"), cells=9)
    queries = vectors.withColumnRenamed("chunk_id", "query_id").limit(40)
    corpus = vectors.where("embedding IS NOT NULL")
    want = ranking(dense.search(corpus, queries.where("embedding IS NOT NULL"), 7))
    again = cells.CellIndex.load(spark, str(tmp_path / "index"))
    assert max(again.parts) > 1 and ranking(cells.search(again, queries, 7, probes=9)) == want


def test_a_quarter_of_the_cells_finds_nearly_all_in_clusters(spark, vectors, tmp_path):
    index = cells.CellIndex.save(vectors, str(tmp_path / "index"))
    queries = vectors.withColumnRenamed("chunk_id", "query_id").where("embedding IS NOT NULL")
    found = {r[:1] + r[2:3] for r in ranking(cells.search(index, queries, 10))}
    want = {r[:1] + r[2:3] for r in ranking(dense.search(vectors.where("embedding IS NOT NULL"), queries, 10))}
    assert len(found & want) >= 0.95 * len(want)


def test_one_vector_and_none(spark, vectors, tmp_path):
    one = vectors.limit(1)
    index = cells.CellIndex.save(one, str(tmp_path / "one"))
    assert [r[2] for r in ranking(cells.search(index, one.withColumnRenamed("chunk_id", "query_id"), 3))] == ["v0"]


@pytest.mark.parametrize("probes", [9, 5])
def test_a_query_travels_once_to_a_shelf_and_leaves_it_with_its_best(spark, vectors, tmp_path, monkeypatch, probes):
    monkeypatch.setattr(cells, "PART", 20)
    monkeypatch.setattr(cells, "SHELF", 250)
    index = cells.CellIndex.save(vectors, str(tmp_path / "index"), cells=9)
    queries = vectors.where("embedding IS NOT NULL").withColumnRenamed("chunk_id", "query_id").limit(40)
    kept = []
    monkeypatch.setattr(cells, "materialise", lambda df: kept.append(cells_materialise(df)) or kept[-1])
    ranked = ranking(cells.search(index, queries, 7, probes=probes))
    shelves = max(own[-1] for own in index.shelves()) + 1
    assert max(index.parts) > 1 and 1 < shelves <= 4
    sent = cells._probed(index, queries, probes)
    assert sent.groupBy("query_id", "shelf").count().where("count > 1").count() == 0
    near = {q: set(c[:probes]) for q, c in _cell_order(index, queries)}
    cell_of = {r[0]: r[1] for r in spark.read.parquet(f"{index.folder}/codes").select("chunk_id", "cell").collect()}
    want = {}
    held = {r[0]: np.array(r[1]) for r in vectors.where("embedding IS NOT NULL").collect()}
    for q, chosen in near.items():
        scores = [(-round(float(held[q] @ v), 6), c) for c, v in held.items() if cell_of[c] in chosen]
        want[q] = [c for _, c in sorted(scores)[:7]]
    got = {}
    for q, _, c, _ in sorted(ranked, key=lambda r: (r[0], r[1])):
        got.setdefault(q, []).append(c)
    assert got == want
    assert kept[-1].count() < 40 * 7 * 2 * shelves


cells_materialise = cells.materialise


def _cell_order(index, queries):
    for r in queries.collect():
        yield r["query_id"], np.argsort(-(index.centroids @ np.array(r["embedding"])), kind="stable").tolist()
