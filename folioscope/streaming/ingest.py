"""Continuous ingestion: new source files become stored papers and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioscope.plans.ingestion import ingest
from folioscope.plugins import Encoder
from folioscope.session import materialise
from folioscope.sources.store import Store

PAPER_FIELDS = ["paper_id", "title", "abstract", "authors", "categories", "published", "updated"]


def start(stream: DataFrame, store: Store, checkpoint: str, encoder: Encoder | None = None, **trigger) -> StreamingQuery:
    """Ingests a stream of papers with their archives (`content`).

    The micro-batch number is the store's batch, so a batch that is replayed
    after a failure takes the place of its own first attempt.
    """

    def write(rows: DataFrame, batch: int) -> None:
        arrived = materialise(rows)
        ingest(store, arrived.select(*PAPER_FIELDS), arrived.select("paper_id", "content"), batch, encoder).collect()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()
