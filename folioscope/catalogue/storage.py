"""Sources, stored tables and resumption."""

from __future__ import annotations

import gzip
import io
import tarfile
import uuid

import pandas as pd
from pyspark.sql import functions as F

from folioscope.catalogue import query
from folioscope.catalogue.preparation import PAGE_BLOCKS, collapse, packed
from folioscope.operators import chunks as chunking
from folioscope.operators.paragraphs import paragraphs
from folioscope.plugins import HashingEncoder
from folioscope.schemas import CHUNKS
from folioscope.session import checkpoint_folder, table
from folioscope.sources import archives, feed, judged
from folioscope.sources.markup import html_text, page_title
from folioscope.sources.store import Store, unseen


def _escaped(text):
    for character, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


@query(
    f"""SELECT source || '.' || doc_id || 'v2' AS paper_id, {collapse("string_split(text, chr(10))[1]")} AS title,
    md5({collapse("text")}) AS abstract_md5, lang || ' Author|Second Author' AS authors, 'cat.' || source AS categories,
    '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS published, '' AS updated,
    CASE WHEN doc_id % 2 = 0 THEN 'pdf/' || doc_id ELSE '' END AS pdf_url FROM documents"""
)
def feed_parse(spark, folder):
    """Documents written as Atom pages of up to a hundred entries and parsed."""
    rows = table(spark, folder, "documents", "doc_id")
    ident = F.col("doc_id").cast("string")
    entry = F.concat(
        F.lit("<entry><id>http://host/abs/"), "source", F.lit("."), ident, F.lit("v2</id><title>\n "),
        _escaped(F.get(F.split("text", "\n"), F.lit(0))), F.lit(" </title><summary>"), _escaped(F.col("text")),
        F.lit("</summary><author><name>"), "lang", F.lit("  Author</name></author><author><name>Second\nAuthor</name></author>"),
        F.lit('<category term="cat.'), "source", F.lit('"/><published>2024-01-'),
        F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"),
        F.lit('</published><link href="abs/'), ident, F.lit('"/>'),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<link title="pdf" href="pdf/'), ident, F.lit('"/>'))).otherwise(F.lit("")),
        F.lit("</entry>"),
    )
    pages = rows.groupBy(F.floor(F.col("doc_id") / 100).alias("page")).agg(F.collect_list(entry).alias("_e"))
    body = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>'),
        F.array_join("_e", "\n"),
        F.lit("</feed>"),
    )
    papers = feed.papers(feed.entries(pages.select(body.alias("body"))))
    return papers.select(
        "paper_id", "title", F.md5("abstract").alias("abstract_md5"), F.array_join("authors", "|").alias("authors"),
        F.array_join("categories", "|").alias("categories"), "published", "updated", "pdf_url",
    )


@query(
    f"""SELECT doc_id::VARCHAR AS doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN '' ELSE source || ' ' END ||
      regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM documents"""
)
def judged_corpus(spark, folder):
    """Documents as JSON lines, some without a title, read as a judged corpus."""
    rows = table(spark, folder, "documents", "doc_id")
    title = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit(" "), "source", F.lit(" ")))
    record = F.struct(F.col("doc_id").cast("string").alias("_id"), title.alias("title"), "text")
    lines = rows.select(F.to_json(record).alias("value"), F.lit(0).alias("position"))
    return judged.corpus(lines).select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "SELECT (doc_id % 7)::VARCHAR AS query_id, doc_id::VARCHAR AS doc_id, (quality + 1)::BIGINT AS grade FROM labels"
)
def qrels_scan(spark, folder):
    """Labels as tab-separated lines, each written twice: the later grade counts."""
    rows = table(spark, folder, "labels")

    def written(grade, position):
        line = F.concat_ws("\t", (F.col("doc_id") % 7).cast("string"), F.col("doc_id").cast("string"), grade.cast("string"))
        return rows.select(line.alias("value"), position.alias("position"))

    header = rows.groupBy().agg(F.lit("query-id\tcorpus-id\tscore").alias("value"), F.lit(-1).cast("long").alias("position"))
    lines = (
        written(F.col("toxic"), F.col("doc_id") * 2)
        .unionByName(written(F.col("quality") + 1, F.col("doc_id") * 2 + 1))
        .unionByName(header)
    )
    return judged.qrels(lines)


@query(
    """SELECT doc_id::VARCHAR AS query_id, md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"""
)
def qrels_semi_join(spark, folder):
    """Of all documents taken as queries, those with a judgement."""
    record = F.struct(F.col("doc_id").cast("string").alias("_id"), "text")
    lines = table(spark, folder, "documents", "doc_id").select(F.to_json(record).alias("value"), F.lit(0).alias("position"))
    judgements = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("query_id"))
    return judged.queries(lines, judgements).select("query_id", F.md5("text").alias("text_md5"))


@query(
    """SELECT text AS question, 'p' || item_id AS paper_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id END AS paragraph
    FROM benchmark UNION ALL SELECT 'again', 'p' || item_id, item_id FROM benchmark"""
)
def question_set_scan(spark, folder):
    rows = table(spark, folder, "benchmark")
    paper = F.concat(F.lit("p"), F.col("item_id"))
    first = F.struct(F.col("text").alias("question"), paper.alias("arxiv_id"), F.when(F.col("item_id") % 3 != 0, F.col("item_id")).alias("paragraph"))
    second = F.struct(F.lit("again").alias("question"), paper.alias("arxiv_id"), F.col("item_id").alias("paragraph"))
    return judged.question_rows(rows.select(F.to_json(F.array(first, second)).alias("value")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, folder):
    """Documents left to ingest when the labelled ones are stored; each arrives
    twice and is taken once."""
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("paper_id"), "lang")
    stored = table(spark, folder, "labels").select(F.col("doc_id").alias("paper_id"))
    return unseen(rows.unionByName(rows), stored).select(F.col("paper_id").alias("doc_id"), "lang")


def stored_pages(spark, folder) -> Store:
    """Pages stored in two batches, and a third whose papers never arrived."""
    pages = table(spark, folder, "pages", "page_id")
    named = pages.withColumn("paper_id", F.concat(F.lit("page"), "page_id"))
    text = named.select("paper_id", html_text(F.col("html")).alias("text"))
    chunks = chunking.with_ids(chunking.chunk(paragraphs(text, "paper_id"), "paper_id"), "paper_id")
    ready = HashingEncoder().passages(chunks)
    none = F.expr("cast(array() as array<string>)")
    papers = named.select(
        "paper_id", page_title(F.col("html")).alias("title"), F.lit("").alias("abstract"), none.alias("authors"),
        none.alias("categories"), F.lit("").alias("published"), F.lit("").alias("updated"),
    )
    store = Store(spark, f"{checkpoint_folder(spark)}/store-{uuid.uuid4().hex}")
    odd = F.pmod(F.substring("paper_id", 5, 20).cast("long"), F.lit(2)) == 1
    store.write(papers.where(odd), ready.where(odd), 0)
    store.write(papers.where(~odd), ready.where(~odd), 1)
    store.write(papers.where(~odd), ready.where(~odd), 1)
    names = [field.name for field in CHUNKS.fields]
    ready.select(*names).write.parquet(f"{store.folder}/chunks/batch=2/attempt=unfinished")
    return store


STORED = f"""
{PAGE_BLOCKS}, {packed("paras", "page_id, paragraph")},
loc AS (SELECT c.page_id, c.paragraph, c.chunk_index, p.section, c.text
        FROM chunks c JOIN paras p ON p.page_id = c.page_id AND p.paragraph = c.paragraph)
"""


@query(
    f"""WITH RECURSIVE {STORED} SELECT 'page' || page_id AS paper_id, paragraph, chunk_index, section, md5(text) AS text_md5,
    CASE WHEN page_id % 2 = 1 THEN 0 ELSE 1 END::BIGINT AS batch FROM loc"""
)
def store_roundtrip(spark, folder):
    """Papers and chunks written in batches, one of them twice, and read back."""
    chunks = stored_pages(spark, folder).chunks()
    return chunks.select("paper_id", "paragraph", "chunk_index", "section", F.md5("text").alias("text_md5"), "batch")


@query(
    f"""WITH RECURSIVE {STORED}, per AS (SELECT page_id, count(*) AS n FROM loc GROUP BY page_id)
    SELECT count(*)::BIGINT AS papers, sum(n)::BIGINT AS chunks, 0::BIGINT AS orphans FROM per WHERE page_id % 5 <> 0"""
)
def cascade_delete(spark, folder):
    """Removing papers removes their chunks; none is left without its paper."""
    store = stored_pages(spark, folder)
    removed = store.papers().where(F.pmod(F.substring("paper_id", 5, 20).cast("long"), F.lit(5)) == 0)
    left = store.copy_to(f"{store.folder}-kept")
    left.remove(removed)
    orphans = chunking.orphans(left.chunks(), left.papers(), "paper_id").agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    papers = left.papers().agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return left.chunks().agg(F.count(F.lit(1)).alias("chunks")).select(papers.alias("papers"), "chunks", orphans.alias("orphans"))


@query(
    f"""WITH RECURSIVE {STORED} SELECT 'page' || page_id AS paper_id, paragraph, chunk_index, md5(text) AS text_md5,
    CASE WHEN page_id % 2 = 1 THEN 0 ELSE 1 END::BIGINT AS batch FROM loc WHERE page_id % 5 <> 0"""
)
def store_restored(spark, folder):
    """A store exported to another folder, some papers removed there, exported again and opened."""
    store = stored_pages(spark, folder)
    exported = store.copy_to(f"{store.folder}-exported")
    exported.remove(exported.papers().where(F.pmod(F.substring("paper_id", 5, 20).cast("long"), F.lit(5)) == 0))
    restored = exported.copy_to(f"{store.folder}-restored")
    return restored.chunks().select("paper_id", "paragraph", "chunk_index", F.md5("text").alias("text_md5"), "batch")


class TextMeasures(HashingEncoder):
    """Vectors that SQL can recompute: characters and blanks of a text."""

    def passages(self, df, text="text"):
        blanks = F.length(text) - F.length(F.replace(F.col(text), F.lit(" "), F.lit("")))
        return df.withColumn("embedding", F.array(F.length(text).cast("float"), blanks.cast("float")))


@query(
    f"""WITH RECURSIVE {STORED} SELECT 'page' || page_id AS paper_id, paragraph, chunk_index,
    length(text)::BIGINT AS characters, (length(text) - length(replace(text, ' ', '')))::BIGINT AS blanks FROM loc"""
)
def reembed_resumed(spark, folder):
    """Vectors of a store replaced in slices by two runs: the second goes on where the first one ended."""
    store = stored_pages(spark, folder)
    store.reembed(TextMeasures(), "measures", slices=8, most=3)
    store.reembed(TextMeasures(), "measures", slices=8)
    component = lambda at: F.col("embedding")[at].cast("long")
    return store.chunks().select(
        "paper_id", "paragraph", "chunk_index", component(0).alias("characters"), component(1).alias("blanks")
    )


def _archive(files):
    """An archive of each row's `main` and `part` texts; a lone compressed file where there is no part."""

    def pack(batches):
        for batch in batches:
            packed = []
            for main, part in zip(batch["main"], batch["part"], strict=True):
                if part is None:
                    packed.append(gzip.compress(main.encode(), 1))
                    continue
                buffer = io.BytesIO()
                with tarfile.open(fileobj=buffer, mode="w:gz", compresslevel=1) as tar:
                    for name, text in (("main.tex", main), ("notes.txt", "none"), ("parts/part.tex", part)):
                        entry = tarfile.TarInfo(name)
                        entry.size = len(text.encode())
                        tar.addfile(entry, io.BytesIO(text.encode()))
                packed.append(buffer.getvalue())
            yield pd.DataFrame({"paper_id": batch["paper_id"], "content": packed})

    return files.mapInPandas(pack, "paper_id string, content binary")


@query(
    """SELECT 'd' || doc_id AS paper_id, unnest(CASE WHEN doc_id % 3 = 0 THEN ['main'] ELSE ['main', 'parts/part'] END) AS name,
      unnest(CASE WHEN doc_id % 3 = 0 THEN [md5(text)] ELSE [md5(text), md5(source || ' of ' || lang)] END) AS text_md5
    FROM documents"""
)
def archive_members(spark, folder):
    """Documents packed as source archives, kept, and their files read back."""
    rows = table(spark, folder, "documents", "doc_id")
    part = F.when(F.col("doc_id") % 3 != 0, F.concat("source", F.lit(" of "), "lang"))
    files = rows.select(F.concat(F.lit("d"), "doc_id").alias("paper_id"), F.col("text").alias("main"), part.alias("part"))
    place = f"{checkpoint_folder(spark)}/archives-{uuid.uuid4().hex}"
    archives.keep(_archive(files), place)
    members = archives.cached(spark, place).select("paper_id", F.explode(archives.member_array(F.col("content"))).alias("_m"))
    return members.select("paper_id", "_m.name", F.md5("_m.text").alias("text_md5"))
