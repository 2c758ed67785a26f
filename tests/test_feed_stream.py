"""Feeds and archives that are asked for once, whatever is lost in between."""

import os

import pytest

from folioscope.sources import archives, feed
from folioscope.streaming import feed as feed_stream

ENTRY = "<entry><id>http://host/abs/p{n}</id><title>t</title></entry>"


def host(log, total, short=(), broken_at=None):
    """A host with so many entries that writes down what it is asked, and may fail at one place until told otherwise."""
    short = dict(short)

    def fetch(url):
        asked = dict(part.split("=") for part in url.split("?")[1].split("&"))
        start, size = int(asked["start"]), int(asked["max_results"])
        if start == broken_at and not os.path.exists(f"{log}-mended"):
            raise OSError("no answer")
        with open(log, "a") as file:
            file.write(f"{start}\n")
        numbers = range(start, min(total, start + min(size, short.get(start, size))))
        return "<feed>" + "".join(ENTRY.format(n=n) for n in numbers) + "</feed>"

    return fetch


def asked(log):
    return [int(line) for line in open(log)] if os.path.exists(log) else []


def run(spark, folder, fetch, out, checkpoint, limit=1000, write=None):
    stream = feed_stream.pages(spark, "u", "q", f"{folder}/pages", fetch, limit, 10, 0, 2, sleep=lambda s: None)

    def keep(rows, batch):
        if write:
            write(batch)
        feed.papers(feed.entries(rows)).select("paper_id").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return sorted(int(r["paper_id"][1:]) for r in spark.read.parquet(out).collect())


def test_a_feed_is_asked_for_every_page_once(spark, tmp_path):
    log, base = str(tmp_path / "log"), str(tmp_path)
    fetch = host(log, 57, {10: 4, 34: 1})
    assert run(spark, base, fetch, f"{base}/out", f"{base}/cp") == list(range(57))
    before = asked(log)
    assert before[:8] == [0, 10, 14, 24, 34, 35, 45, 55] and len(set(before)) == len(before)
    # A new stream, with a new checkpoint, asks only at the end whether there is more.
    assert run(spark, base, fetch, f"{base}/out2", f"{base}/cp2") == list(range(57))
    assert set(asked(log)[len(before):]) <= {57}


def test_a_limit_ends_a_feed(spark, tmp_path):
    log, base = str(tmp_path / "log"), str(tmp_path)
    assert run(spark, base, host(log, 500), f"{base}/out", f"{base}/cp", limit=25) == list(range(25))
    assert asked(log) == [0, 10, 20]


def test_a_reader_lost_between_pages_repeats_no_request(spark, tmp_path):
    log, base = str(tmp_path / "log"), str(tmp_path)
    fetch = host(log, 60, broken_at=30)
    with pytest.raises(Exception, match="no answer"):
        run(spark, base, fetch, f"{base}/out", f"{base}/cp")
    assert asked(log) == [0, 10, 20]
    open(f"{log}-mended", "w").close()
    assert run(spark, base, fetch, f"{base}/out", f"{base}/cp") == list(range(60))
    assert asked(log) == [0, 10, 20, 30, 40, 50, 60]


def test_a_replayed_batch_reads_the_pages_it_read(spark, tmp_path):
    log, base = str(tmp_path / "log"), str(tmp_path)
    fetch, failed = host(log, 60), []

    def once(batch):
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(spark, base, fetch, f"{base}/out", f"{base}/cp", write=once)
    assert run(spark, base, fetch, f"{base}/out", f"{base}/cp", write=once) == list(range(60))
    numbers = [n for n in asked(log) if n < 60]
    assert numbers == sorted(set(numbers))


def test_a_lost_download_asks_only_for_what_had_not_come(spark, tmp_path):
    log, folder = str(tmp_path / "log"), str(tmp_path / "cache")
    papers = spark.createDataFrame([(f"p/{i}",) for i in range(6)], "paper_id string")

    def fetch(paper_id):
        if paper_id == "p/3" and not os.path.exists(f"{log}-mended"):
            os._exit(1)
        with open(log, "a") as file:
            file.write(f"{paper_id[2:]}\n")
        return paper_id.encode()

    with pytest.raises(Exception):  # noqa: B017
        archives.fetched(papers, folder, fetch, sleep=lambda s: None)
    open(f"{log}-mended", "w").close()
    got = archives.fetched(papers, folder, fetch, sleep=lambda s: None).collect()
    assert sorted((r["paper_id"], bytes(r["content"])) for r in got) == [(f"p/{i}", f"p/{i}".encode()) for i in range(6)]
    assert asked(log) == list(range(6))
