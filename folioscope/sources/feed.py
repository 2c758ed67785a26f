"""Paper metadata from an Atom feed: page requests, download, parsing."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from urllib.parse import quote_plus, urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.constants import FEED_LIMIT, FEED_PAGE_SIZE, REQUEST_DELAY_SECONDS
from folioscope.functions.text import collapse
from folioscope.session import materialise

ENTRY_START = re.compile(r"<entry[\s>]")

# --- fixed values: the parts of an Atom entry that are read ----------------
ENTRY_FIELDS = {
    "id": "string",
    "title": "string",
    "summary": "string",
    "author": "array<struct<name:string>>",
    "category": "array<struct<_term:string>>",
    "published": "string",
    "updated": "string",
    "link": "array<struct<_title:string,_href:string>>",
}
# ---------------------------------------------------------------------------


def page_url(url: str, query: str, start: int, size: int) -> str:
    asked = {"search_query": query, "sortBy": "submittedDate", "sortOrder": "descending", "start": start, "max_results": size}
    return f"{url}?{urlencode(asked, quote_via=quote_plus)}"


def download(
    spark: SparkSession,
    url: str,
    query: str,
    fetch: Callable[[str], str],
    limit: int = FEED_LIMIT,
    size: int = FEED_PAGE_SIZE,
    delay: float = REQUEST_DELAY_SECONDS,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """`start, body` of as many pages as hold the newest `limit` entries.

    Each request goes on from the number of entries received so far, so a page
    that comes back shorter than asked loses nothing; an empty one is the end.
    `fetch` raises on an error status, which fails the job. The host asks for one
    request at a time with a pause between: one task makes the requests, and the
    bodies are written down as they come, to be read by as many tasks as need be.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            received = 0
            while received < limit:
                if received:
                    sleep(delay)
                body = fetch(page_url(url, query, received, min(size, limit - received)))
                found = len(ENTRY_START.findall(body))
                if not found:
                    break
                yield pd.DataFrame({"start": [received], "body": [body]})
                received += found

    return materialise(spark.range(0, 1, 1, 1).mapInPandas(run, "start long, body string"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Entries of feed files on disk, one row per entry."""
    schema = ", ".join(f"{name} {kind}" for name, kind in ENTRY_FIELDS.items())
    return spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)


def entries(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row per entry of downloaded feed pages."""
    entry = ",".join(f"{name}:{kind}" for name, kind in ENTRY_FIELDS.items())
    parsed = bodies.select(F.from_xml(F.col(body), F.lit(f"struct<entry:array<struct<{entry}>>>")).alias("_feed"))
    return parsed.select(F.explode_outer("_feed.entry").alias("_e")).where("_e is not null").select("_e.*")


def _text(value: Column) -> Column:
    return F.coalesce(collapse(value), F.lit(""))


def papers(entry_rows: DataFrame) -> DataFrame:
    """Entries as papers. The identifier is what follows the last slash, with its
    version; absent fields are empty; the PDF is the first link titled so."""
    pdf = F.filter(F.coalesce("link", F.expr("cast(array() as array<struct<_title:string,_href:string>>)")),
                   lambda link: link["_title"] == "pdf")
    return entry_rows.select(
        F.element_at(F.split(_text(F.col("id")), "/"), -1).alias("paper_id"),
        _text(F.col("title")).alias("title"),
        _text(F.col("summary")).alias("abstract"),
        F.coalesce(F.transform("author", lambda a: _text(a["name"])), F.expr("cast(array() as array<string>)")).alias("authors"),
        F.coalesce(F.transform("category", lambda c: c["_term"]), F.expr("cast(array() as array<string>)")).alias("categories"),
        _text(F.col("published")).alias("published"),
        _text(F.col("updated")).alias("updated"),
        F.coalesce(F.get(pdf, F.lit(0))["_href"], F.lit("")).alias("pdf_url"),
    )
