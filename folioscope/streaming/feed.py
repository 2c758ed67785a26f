"""A paper feed as a streaming source: pages are requested one by one and each is asked for once.

The offset is the number of entries received. A page is kept in a shared folder before the offset moves past it, so a
stream that is started again, with its checkpoint or with a new one, reads what is there and goes on with the first
request that was not answered; a replayed micro-batch reads the pages it read before. Requests are made where the
micro-batches are planned, one page in memory at a time; the kept pages are read and parsed by tasks, one each.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from folioscope.constants import FEED_LIMIT, FEED_PAGE_SIZE, REQUEST_DELAY_SECONDS
from folioscope.sources.feed import ENTRY_START, page_url
from folioscope.sources.kept import Kept

FORMAT = "paper_feed"
PAGES_PER_BATCH = 20


@dataclass
class Page(InputPartition):
    start: int
    name: str


def feed_folder(folder: str, url: str, query: str) -> str:
    """Where the pages of one query are kept: entries are counted per query."""
    return f"{folder}/{hashlib.sha256(f'{url} {query}'.encode()).hexdigest()[:32]}"


class PageReader(DataSourceStreamReader):
    """Offsets and partitions over kept pages, whose names say at which entry they start and how many they hold."""

    def __init__(self, options: dict, fetch: Callable[[str], str], sleep: Callable[[float], None]):
        self.url, self.query = options["url"], options["query"]
        self.limit, self.size = int(options["limit"]), int(options["size"])
        self.delay, self.pages = float(options["delay"]), int(options["pages"])
        self.fetch, self.sleep = fetch, sleep
        self.folder = feed_folder(options["folder"], self.url, self.query)
        self.known: dict[int, tuple[str, int]] | None = None
        self.received, self.asked, self.ended = 0, False, False

    def _known(self) -> dict[int, tuple[str, int]]:
        if self.known is None:
            named = [(name, *map(int, name.split("-"))) for name in Kept(self.folder).names()]
            self.known = {start: (name, found) for name, start, found in named}
        return self.known

    def _next(self) -> bool:
        """Moves past one more page, kept or requested; false at the end of the feed."""
        known = self._known()
        if self.received not in known:
            if self.ended:
                return False
            if self.asked:
                self.sleep(self.delay)
            self.asked = True
            body = self.fetch(page_url(self.url, self.query, self.received, min(self.size, self.limit - self.received)))
            found = len(ENTRY_START.findall(body))
            if not found:
                self.ended = True
                return False
            name = f"{self.received:012d}-{found:06d}"
            Kept(self.folder).put(name, body.encode())
            known[self.received] = (name, found)
        self.received += known[self.received][1]
        return True

    def initialOffset(self) -> dict:
        return {"received": 0}

    def latestOffset(self) -> dict:
        for _ in range(self.pages):
            if self.received >= self.limit or not self._next():
                break
        return {"received": self.received}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        at, found = start["received"], []
        while at < end["received"]:
            name, entries = self._known()[at]
            found.append(Page(at, name))
            at += entries
        # A stream that goes on from its checkpoint has these behind it.
        self.received = max(self.received, end["received"])
        return found

    def read(self, partition: Page) -> Iterator[tuple]:
        body = Kept(self.folder).get(partition.name)
        if body is None:
            raise FileNotFoundError(f"page {partition.name} is no longer kept in {self.folder}")
        yield partition.start, body.decode()

    def commit(self, end: dict) -> None:
        """Pages stay kept: another stream of the same query starts from them."""


def source(fetch: Callable[[str], str], sleep: Callable[[float], None] = time.sleep) -> type[DataSource]:
    """The source for a host that is asked by `fetch`, which raises on an error status."""

    class FeedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return FORMAT

        def schema(self) -> str:
            return "start long, body string"

        def streamReader(self, schema) -> PageReader:
            return PageReader(dict(self.options), fetch, sleep)

    return FeedSource


def pages(
    spark: SparkSession,
    url: str,
    query: str,
    folder: str,
    fetch: Callable[[str], str],
    limit: int = FEED_LIMIT,
    size: int = FEED_PAGE_SIZE,
    delay: float = REQUEST_DELAY_SECONDS,
    pages_per_batch: int = PAGES_PER_BATCH,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """A stream of `start, body`, for `feed.entries`, of the newest `limit` entries; pages are kept in `folder`."""
    spark.dataSource.register(source(fetch, sleep))
    options = {"url": url, "query": query, "folder": folder, "limit": limit, "size": size, "delay": delay, "pages": pages_per_batch}
    return spark.readStream.format(FORMAT).options(**options).load()
