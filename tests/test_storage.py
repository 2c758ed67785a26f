"""Stored tables: batches, resumption, visibility, re-embedding, streaming."""

import io
import tarfile

import pytest

from folioscope.operators.chunks import duplicate_locations, orphans
from folioscope.plans.ingestion import ingest
from folioscope.plugins import HashingEncoder
from folioscope.schemas import PAPERS
from folioscope.sources.commits import Conflict
from folioscope.sources.store import Store
from folioscope.streaming import ingest as streaming_ingest

LONG = "This sentence is long enough to count once it has been repeated a few times over. " * 4
PAPER = "paper_id string, title string, abstract string, authors array<string>, categories array<string>, published string, updated string, content binary"


def archive(body):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, text in {"main.tex": r"\begin{document}\section{One}\input{b}\end{document}", "b.tex": body}.items():
            entry = tarfile.TarInfo(name)
            entry.size = len(text.encode())
            tar.addfile(entry, io.BytesIO(text.encode()))
    return bytearray(buffer.getvalue())


def arrivals(spark, *bodies):
    rows = [(i, f"title {i}", "", ["A"], ["c"], "2024", "", archive(b)) for i, b in bodies]
    return spark.createDataFrame(rows, PAPER)


def take(store, rows, batch):
    return ingest(store, rows.drop("content"), rows.select("paper_id", "content"), batch).first()


def test_ingestion_resumes_and_skips(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.papers().count() == 0 and store.chunks().count() == 0
    first = take(store, arrivals(spark, ("1v1", LONG), ("2v1", "short"), ("1v1", LONG)), 0)
    assert (first["stored"], first["skipped"], first["chunks"]) == (1, 1, 1)
    second = take(store, arrivals(spark, ("1v1", LONG), ("3v2", f"{LONG}\\par {LONG}")), 1)
    assert (second["stored"], second["skipped"], second["chunks"]) == (1, 0, 2)
    again = take(store, arrivals(spark, ("1v1", LONG), ("3v2", LONG)), 2)
    assert (again["stored"], again["chunks"]) == (0, 0)
    chunks = store.chunks()
    assert sorted((r["paper_id"], r["section"], r["paragraph"]) for r in chunks.collect()) == [("1v1", "One", 0), ("3v2", "One", 0), ("3v2", "One", 1)]
    assert duplicate_locations(chunks, "paper_id").count() == 0 and orphans(chunks, store.papers(), "paper_id").count() == 0
    assert all(len(r["embedding"]) == 64 for r in chunks.collect())


def test_an_unfinished_batch_is_invisible_and_can_be_repeated(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    take(store, arrivals(spark, ("1v1", LONG)), 0)
    done = spark.read.parquet(f"{store.folder}/chunks/batch=0").drop("attempt")
    done.write.parquet(f"{store.folder}/chunks/batch=1/attempt=a0")
    assert store.chunks().count() == 1
    take(store, arrivals(spark, ("2v1", LONG)), 1)
    assert sorted(r["paper_id"] for r in store.chunks().collect()) == ["1v1", "2v1"]


def test_copies_deletions_and_new_vectors(spark, tmp_path):
    class Constant(HashingEncoder):
        def passages(self, df, text="text"):
            return df.selectExpr("*", "array(cast(1 as float)) as embedding")

    store = Store(spark, str(tmp_path / "s"))
    take(store, arrivals(spark, ("1v1", LONG), ("2v1", LONG)), 0)
    assert store.copy_to(str(tmp_path / "c")).chunks().count() == 2
    assert {tuple(r["embedding"]) for r in store.reembedded(Constant(), str(tmp_path / "r")).chunks().collect()} == {(1.0,)}
    take(store, arrivals(spark, ("3v1", LONG)), 1)
    untouched = sorted(p.name for p in (tmp_path / "s" / "chunks" / "batch=1").iterdir())
    store.remove(store.papers().where("paper_id = '1v1'"))
    assert sorted(r["paper_id"] for r in store.chunks().collect()) == ["2v1", "3v1"] and store.papers().count() == 2
    assert sorted(p.name for p in (tmp_path / "s" / "chunks" / "batch=1").iterdir()) == untouched
    store.remove(store.papers().where("paper_id = '2v1'"))
    assert [r["paper_id"] for r in store.papers().collect()] == ["3v1"]


def test_a_finished_batch_can_be_repeated(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    offered = arrivals(spark, ("1v1", LONG), ("2v1", f"{LONG}\\par {LONG}"))

    def contents():
        return sorted((r["paper_id"], r["paragraph"], r["text"], r["batch"]) for r in store.chunks().collect())

    first = take(store, offered, 0)
    once = contents()
    again = take(store, offered, 0)
    assert first == again and contents() == once and store.papers().count() == 2
    take(store, arrivals(spark, ("1v1", LONG), ("3v1", LONG)), 1)
    take(store, offered, 0)
    assert [row for row in contents() if row[3] == 0] == once and store.papers().count() == 3


def test_of_several_archives_the_longest_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    take(store, arrivals(spark, ("1v1", "short"), ("1v1", f"{LONG}\\par {LONG} and then some")), 0)
    assert store.chunks().count() == 2


def test_only_a_missing_folder_is_an_empty_store(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "papers").write_text("not a table")
    with pytest.raises(Exception):  # noqa: B017
        Store(spark, str(tmp_path / "s")).papers().count() or Store(spark, str(tmp_path / "s"))._read("papers", PAPERS).count()


def test_a_stream_of_archives_is_ingested_once(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "s"))
    for rows in (arrivals(spark, ("1v1", LONG), ("2v1", LONG)), arrivals(spark, ("2v1", LONG), ("3v1", LONG))):
        rows.coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(PAPER).option("maxFilesPerTrigger", 1).parquet(source)
        streaming_ingest.start(stream, store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["paper_id"] for r in store.chunks().collect()) == ["1v1", "2v1", "3v1"]


def test_batches_keep_their_number(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    take(store, arrivals(spark, ("1v1", LONG)), 4)
    assert [r["batch"] for r in store.papers().collect()] == [4]


class Marking(HashingEncoder):
    """One vector component; writes down what it encodes."""

    def __init__(self, mark, log=None):
        self.mark, self.log = mark, log

    def passages(self, df, text="text"):
        if self.log is not None:
            self.log.extend(sorted(r["chunk_id"] for r in df.select("chunk_id").collect()))
        return df.selectExpr("*", f"array(cast({self.mark} as float)) as embedding")


def test_overlapping_writers_of_a_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    take(store, arrivals(spark, ("1v1", LONG), ("2v1", LONG)), 0)
    take(store, arrivals(spark, ("3v1", LONG)), 1)
    class Overtaken(Store):
        """Another writer commits between what this one reads and its own commit."""

        def _write_all(self, papers, chunks, batches, folder, since):
            done = super()._write_all
            other(Store(self.spark, self.folder))
            return done(papers, chunks, batches, folder, since)

    def other(plain):
        take(plain, arrivals(spark, ("1v1", LONG), ("2v1", LONG), ("4v1", LONG)), 0)

    with pytest.raises(Conflict, match="batches \\[0\\]"):
        Overtaken(spark, store.folder).remove(store.papers().where("paper_id = '1v1'"))
    ids = lambda: sorted(r["paper_id"] for r in store.papers().collect())
    assert ids() == ["1v1", "2v1", "3v1", "4v1"] == sorted(r["paper_id"] for r in store.chunks().collect())

    def other(plain):  # noqa: F811
        take(plain, arrivals(spark, ("5v1", LONG)), 2)

    Overtaken(spark, store.folder).remove(store.papers().where("paper_id = '1v1'"))
    assert ids() == ["2v1", "3v1", "4v1", "5v1"]


def test_a_writer_with_an_old_view_fails(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    take(store, arrivals(spark, ("1v1", LONG)), 0)
    seen, papers, chunks = store.version(), store.papers(), store.chunks()
    take(store, arrivals(spark, ("1v1", LONG)), 0)
    with pytest.raises(Conflict):
        store.write(papers, chunks, 0, since=seen)
    store.write(papers, chunks, 3, since=seen)
    assert store.version() == 3 and store.papers().count() == 2


def test_vectors_are_replaced_slice_by_slice(spark, tmp_path):
    store, log = Store(spark, str(tmp_path / "s")), []
    take(store, arrivals(spark, *[(f"{i}v1", LONG) for i in range(12)]), 0)
    take(store, arrivals(spark, ("20v1", LONG)), 1)
    base = {p: p.stat().st_mtime_ns for p in (tmp_path / "s" / "chunks").rglob("*.parquet")}
    marks = lambda: sorted(r["embedding"][0] for r in store.chunks().collect() if len(r["embedding"]) == 1)
    assert store.reembed(Marking(2, log), "two", slices=4, most=2) == 2
    done = len(log)
    assert 0 < done < 13 and marks() == [2.0] * done and store.chunks().count() == 13
    store.reembed(Marking(2, log), "two", slices=5)
    assert len(log) == len(set(log)) == 13 and marks() == [2.0] * 13
    assert store.reembed(Marking(2, log), "two") == 0
    # A slice that was written but not committed is not seen.
    part = next((tmp_path / "s" / "patches" / "space=two").glob("slice=*"))
    spark.read.parquet(str(part)).selectExpr("chunk_id", "attempt", "array(cast(9 as float)) as embedding").write.parquet(f"{part}lost")
    assert marks() == [2.0] * 13
    # A batch that is written again, or added, is encoded anew; the others are not.
    take(store, arrivals(spark, ("20v1", LONG), ("21v1", LONG)), 1)
    assert marks() == [2.0] * 12
    store.reembed(Marking(2, log), "two")
    assert len(log) == 15 and marks() == [2.0] * 14
    store.remove(store.papers().where("paper_id = '0v1'"))
    assert marks() == [2.0] * 13
    store.reembed(Marking(3), "three", slices=2)
    assert marks() == [3.0] * 13
    assert all(p.stat().st_mtime_ns == t for p, t in base.items())


def test_an_empty_store_has_no_vectors_to_replace(spark, tmp_path):
    assert Store(spark, str(tmp_path / "s")).reembed(Marking(1), "one") == 0
