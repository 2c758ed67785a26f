"""Archives, markup, paragraphs, feeds and judged collections on hand-made input."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators.paragraphs import paragraphs
from folioscope.sources import archives, feed, judged
from folioscope.sources.markup import document_body, latex_text

LONG = "This sentence is long enough to count once it has been repeated a few times over. " * 4


def flat(spark, members):
    rows = spark.createDataFrame([([{"name": n, "text": t} for n, t in members],)], f"m {archives.MEMBERS}")
    return rows.select(archives.flatten(F.col("m"))).first()[0]


def test_the_shallowest_then_shortest_document_is_the_entry(spark):
    document = r"\begin {document}%s\end{document}"
    assert "main" in flat(spark, [("a/x", document % "deep"), ("paper", document % "long"), ("main", document % "main")])
    assert "first" in flat(spark, [("aaa", document % "first"), ("bbb", document % "second")])


def test_includes_are_resolved_in_place(spark):
    main = r"\begin{document}\input{ part.tex }|\include{part}|\input{absent}|\end{document}"
    assert flat(spark, [("part", "P"), ("main", main)]) == r"\begin{document}P|P||\end{document}"


def test_a_file_may_be_included_along_two_paths_but_not_into_itself(spark):
    members = [("main", r"\begin{document}\input{a}\input{b}"), ("a", r"A\input{c}"), ("b", r"B\input{c}"), ("c", r"C\input{a}")]
    assert flat(spark, members) == r"\begin{document}ACBCA"


def test_nothing_opens_a_document(spark):
    assert flat(spark, [("notes", "macros only")]) == ""


def tarred(files):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as tar:
        for name, content in files.items():
            entry = tarfile.TarInfo(name)
            entry.size = len(content)
            tar.addfile(entry, io.BytesIO(content))
    return buffer.getvalue()


def test_members_of_every_kind_of_archive(spark):
    contents = [
        tarred({"main.tex": b"caf\xe9", "fig.png": b"x", "s/a.tex": b"A"}),
        gzip.compress(b"alone"),
        b"not an archive",
        gzip.compress(b"cut off in the middle of it")[:-12],
        b"",
    ]
    rows = spark.createDataFrame(list(enumerate(map(bytearray, contents))), "i int, content binary")
    found = rows.select("i", archives.member_array(F.col("content")).alias("m")).orderBy("i").collect()
    assert [[(m["name"], m["text"]) for m in r["m"]] for r in found] == [
        [("main", "caf�"), ("s/a", "A")],
        [("main", "alone")],
        [],
        [],
        [("main", "")],
    ]


def test_only_missing_archives_are_downloaded_and_failures_are_left_out(spark):
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    stored = spark.createDataFrame([("a", bytearray(b"x"))], "paper_id string, content binary")

    def fetch(paper_id):
        if paper_id == "c":
            raise OSError("gone")
        return b"content of " + paper_id.encode()

    got = archives.download(archives.missing(papers, stored), fetch, sleep=lambda s: None).collect()
    assert [(r["paper_id"], bytes(r["content"])) for r in got] == [("b", b"content of b")]


def test_downloaded_archives_are_kept(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def fetch(paper_id):
        calls.add(1)
        return paper_id.encode()

    folder = str(tmp_path / "kept")
    ask = lambda *ids: archives.fetched(spark.createDataFrame([(i,) for i in ids], "paper_id string"), folder, fetch, sleep=lambda s: None)
    assert archives.cached(spark, folder).count() == 0
    assert sorted(r["paper_id"] for r in ask("a", "b", "a").collect()) == ["a", "b"] and calls.value == 2
    assert sorted(r["paper_id"] for r in ask("b", "c").collect()) == ["b", "c"] and calls.value == 3


def read(spark, latex):
    rows = spark.createDataFrame([(1, latex)], "id long, latex string")
    found = paragraphs(rows.select("id", latex_text(F.col("latex")).alias("text")), "id").orderBy("paragraph").collect()
    return [(r["paragraph"], r["section"], r["text"]) for r in found]


def document(body):
    return r"\documentclass{article}\newcommand{\x}{y}\begin{document}" + body + r"\end{document} tail"


def test_body_falls_back_to_everything(spark):
    rows = spark.createDataFrame([("no environment",), (r"\begin{document}open \par end",)], "latex string")
    assert [r[0] for r in rows.select(document_body(F.col("latex"))).collect()] == ["no environment", "open \n\n end"]


def test_sections_carry_forward_and_number_from_zero(spark):
    found = read(spark, document(rf"{LONG}\section{{INTRO-PART}}{LONG}\par {LONG}\subsection{{Sampling}} short \par {LONG}"))
    assert [(p, s) for p, s, _ in found] == [(0, "Abstract"), (1, "Intro-Part"), (2, "Intro-Part"), (3, "Sampling")]
    assert found[0][2] == LONG.strip()


def test_everything_behind_a_stop_section_is_dropped(spark):
    for title in ("References", "ACKNOWLEDGEMENTS", "Bibliography and notes"):
        found = read(spark, document(rf"\section{{A}}{LONG}\section*{{{title}}}{LONG}\section{{Appendix}}{LONG}"))
        assert [s for _, s, _ in found] == ["A"]


def test_a_heading_is_recognised_by_its_block(spark):
    rows = spark.createDataFrame([(1, f"§\nTitle on its own\n\n{LONG}\n  §.§   Sub  title\n{LONG}\n\n§ \n\n{LONG}")], "id long, text string")
    assert [r["section"] for r in paragraphs(rows, "id").orderBy("paragraph").collect()] == [
        "Title on its own", "Sub title", "Sub title"
    ]


def test_unreadable_source_yields_nothing(spark):
    assert read(spark, r"\begin{document}\begin{") == []


def test_markup_is_rendered_as_text(spark):
    rows = spark.createDataFrame(
        [(r"rate 5\% of $\alpha\beta x$~\cite{a,b}, see \ref{f} % note" + "\n" + r"\textbf{bold} \alphabet{x} \_ -- end",)],
        "latex string",
    )
    assert rows.select(latex_text(F.col("latex"))).first()[0].split() == (
        "rate 5% of αβ x <cit.>, see <ref> bold x _ – end".split()
    )


ENTRY = """<entry><id>http://host/abs/2401.{n:05d}v2</id><title>Title
  {n}</title><summary> Sum  mary </summary><author><name>A  B</name></author><category term="x.y"/>
  <link href="abs" rel="alternate"/><link title="pdf" href="pdf/{n}"/><published>2024-01-01</published></entry>"""


def page(numbers):
    return '<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(ENTRY.format(n=n) for n in numbers) + "</feed>"


def test_a_request_names_its_place():
    assert feed.page_url("http://host/query", 'cat:x AND "a b"', 200, 50) == (
        "http://host/query?search_query=cat%3Ax+AND+%22a+b%22&sortBy=submittedDate&sortOrder=descending&start=200&max_results=50"
    )


def served(total, short):
    """A feed of so many entries whose pages are cut to the given sizes, call by call."""

    head, rest = page([]).split("</feed>")[0], "</feed>" + page([]).split("</feed>")[1]
    every = [ENTRY.format(n=n) for n in range(total)]

    def fetch(url):
        asked = dict(part.split("=") for part in url.split("?")[1].split("&"))
        start, size = int(asked["start"]), int(asked["max_results"])
        return head + "".join(every[start : start + min(size, short.get(start, size))]) + rest

    return fetch


@pytest.mark.parametrize(("total", "short", "limit"), [(500, {}, 250), (160, {}, 250), (500, {0: 60, 60: 1}, 200), (0, {}, 10), (5, {0: 5}, 0)])
def test_download_goes_on_from_what_has_arrived(spark, total, short, limit):
    got = feed.download(spark, "u", "q", served(total, short), limit, 100, sleep=lambda s: None)
    papers = feed.papers(feed.entries(got))
    assert sorted(int(r["title"].split()[-1]) for r in papers.collect()) == list(range(min(total, limit)))


def test_entries_become_papers(spark):
    bodies = spark.createDataFrame([(page([7]) ,), ("<feed><entry><id>x</id></entry></feed>",)], "body string")
    papers = {r["paper_id"]: r.asDict() for r in feed.papers(feed.entries(bodies)).collect()}
    assert papers["2401.00007v2"] == {
        "paper_id": "2401.00007v2", "title": "Title 7", "abstract": "Sum mary", "authors": ["A B"],
        "categories": ["x.y"], "published": "2024-01-01", "updated": "", "pdf_url": "pdf/7",
    }
    assert papers["x"]["title"] == "" and papers["x"]["authors"] == [] and papers["x"]["pdf_url"] == ""


def test_feed_files_are_read_entry_by_entry(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(page([1, 2, 3]))
    assert feed.papers(feed.read_files(spark, str(tmp_path / "feed.xml"))).count() == 3


def test_judged_collection_from_files(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text(
        "\n".join(json.dumps(r) for r in [{"_id": "1", "title": " T ", "text": " body "}, {"_id": "2", "text": "alone"}])
    )
    (tmp_path / "queries.jsonl").write_text("\n".join(json.dumps({"_id": i, "text": f"q{i}"}) for i in "ab"))
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\na\t1\t1\na\t1\t2\na\t2\t0\n")
    corpus, queries, qrels = judged.benchmark(spark, str(tmp_path))
    assert dict(corpus.collect()) == {"1": "T body", "2": "alone"}
    assert dict(queries.collect()) == {"a": "qa"}
    assert sorted(map(tuple, qrels.collect())) == [("a", "1", 2), ("a", "2", 0)]


def test_question_files(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps([{"question": "a?", "arxiv_id": "1v1", "paragraph": None}, {"question": "b?", "arxiv_id": "2v1", "paragraph": 3}]))
    (tmp_path / "u.json").write_text(json.dumps(["x?", "y?"]))
    assert sorted(map(tuple, judged.question_file(spark, str(tmp_path / "q.json")).collect())) == [("a?", "1v1", None), ("b?", "2v1", 3)]
    assert sorted(r[0] for r in judged.plain_questions(spark, str(tmp_path / "u.json")).collect()) == ["x?", "y?"]
