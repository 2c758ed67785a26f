"""The papers and chunks tables as folders of parquet, one partition per batch and attempt.

A batch is written into a new attempt folder, chunks first, and becomes visible as
a whole when a numbered commit names the attempt. Nothing that was committed is ever
overwritten: writing a batch again adds an attempt, and the highest commit of a
batch counts. So a batch can be repeated, finished or not, while others read, and
a plan never reads what it writes. Visibility is decided per batch and attempt,
so reading never joins chunks with papers.

A writer remembers the last commit it has seen. If a later one touches one of its
batches, its own commit fails; writers of different batches do not disturb each other.

Vectors can be replaced without touching the chunks: a patch holds new vectors by
`chunk_id` and the attempt they were made for, written slice by slice. Readers see a
patch's vectors where there are some, and a batch written again is no longer covered
by patches of its earlier attempt.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from folioscope.plugins import Encoder
from folioscope.schemas import CHUNKS, PAPERS
from folioscope.session import materialise
from folioscope.sources.commits import Commits, Conflict

PLACE = "batch long, attempt string"
COMMITS = "batches array<struct<batch:long,attempt:string>>, patch struct<space:string,attempt:string>"
PATCH = ["chunk_id", "attempt", "embedding"]


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    folder: str

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    @property
    def commits(self) -> Commits:
        return Commits(self.spark, f"{self.folder}/commits")

    def version(self) -> int:
        """The number of the last commit."""
        return max(self.commits.numbers(), default=0)

    def _log(self) -> DataFrame:
        """`number, batches, patch` of every commit."""
        schema = T.StructType.fromDDL(COMMITS)
        if not self.version():
            return self.spark.createDataFrame([], schema).select(F.lit(0).cast("long").alias("number"), "*")
        rows = self.spark.read.schema(schema).json(f"{self.folder}/commits")
        return rows.select(F.col("_metadata.file_name").cast("long").alias("number"), "batches", "patch")

    def committed(self) -> DataFrame:
        """`batch, attempt`: the highest commit of every batch."""
        entries = self._log().selectExpr("number", "inline(batches)")
        return entries.groupBy("batch").agg(F.max_by("attempt", "number").alias("attempt"))

    def _placed(self, name: str, schema: T.StructType) -> DataFrame:
        placed = T.StructType([*schema.fields, *T.StructType.fromDDL(PLACE).fields])
        return self._read(name, placed).join(self.committed(), ["batch", "attempt"], "left_semi")

    def papers(self) -> DataFrame:
        return self._placed("papers", PAPERS).drop("attempt")

    def chunks(self) -> DataFrame:
        """Chunks with their newest vectors. Patches are joined only where the store has any."""
        chunks, space = self._placed("chunks", CHUNKS), self._space()
        if space is None:
            return chunks.drop("attempt")
        fresh = self._patched(space).withColumnRenamed("embedding", "_fresh")
        newest = F.coalesce("_fresh", "embedding").alias("embedding")
        columns = [newest if name == "embedding" else name for name in [*(f.name for f in CHUNKS.fields), "batch"]]
        return chunks.join(fresh, ["chunk_id", "attempt"], "left").select(*columns)

    def _space(self) -> str | None:
        """The name under which vectors were replaced last."""
        return self._log().where("patch is not null").agg(F.max_by("patch.space", "number")).first()[0]

    def _patched(self, space: str) -> DataFrame:
        """`chunk_id, attempt, embedding` of one patch's committed slices; a slice written twice counts once."""
        written = self._log().where(F.col("patch.space") == space).select(F.col("patch.attempt").alias("slice")).distinct()
        schema = T.StructType.fromDDL("chunk_id long, attempt string, embedding array<float>, space string, slice string")
        rows = self._read("patches", schema).where(F.col("space") == space).join(written, "slice", "left_semi")
        return rows.select(*PATCH).dropDuplicates(["chunk_id", "attempt"])

    def stored_ids(self, but: int | None = None) -> DataFrame:
        """Identifiers of stored papers; of all batches, or of all `but` one."""
        papers = self.papers()
        return (papers if but is None else papers.where(F.col("batch") != but)).select("paper_id").distinct()

    def write(self, papers: DataFrame, chunks: DataFrame, batch: int, since: int | None = None) -> None:
        """Stores papers that have chunks, with their chunks, as one batch.

        `since` is the version the caller has read from; a later commit of this batch is then a conflict.
        """
        since = self.version() if since is None else since
        attempt = _new_attempt()
        place = f"batch={batch}/attempt={attempt}"
        chunks.select(*[f.name for f in CHUNKS.fields]).write.parquet(f"{self.folder}/chunks/{place}")
        written = self.spark.read.schema(CHUNKS).parquet(f"{self.folder}/chunks/{place}")
        kept = papers.join(written.select("paper_id").distinct(), "paper_id", "left_semi")
        kept = kept.withColumn("ingested_at", F.current_timestamp()).select(*[f.name for f in PAPERS.fields])
        kept.write.parquet(f"{self.folder}/papers/{place}")
        self._commit([batch], attempt, since)

    def _commit(self, batches: list[int], attempt: str, since: int, patch: str | None = None) -> None:
        """One more commit, if none since `since` has touched one of the batches."""
        content = {"batches": [{"batch": batch, "attempt": attempt} for batch in batches]}
        if patch is not None:
            content["patch"] = {"space": patch, "attempt": attempt}
        own = set(batches)
        while True:
            last = since
            for last in (n for n in self.commits.numbers() if n > since):
                said = self.commits.read(last) or {"batches": []}
                touched = own.intersection(entry["batch"] for entry in said["batches"])
                if touched:
                    raise Conflict(f"commit {last} has touched batches {sorted(touched)}")
            try:
                return self.commits.create(last + 1, content)
            except Conflict:
                # The number was taken in between, perhaps by a writer of other batches.
                since = last

    def _write_all(self, papers: DataFrame, chunks: DataFrame, batches: DataFrame, folder: str, since: int) -> Store:
        """Rows with their batch numbers as one attempt at all of `batches`."""
        attempt = _new_attempt()
        for name, rows in (("chunks", chunks), ("papers", papers)):
            placed = rows.withColumn("attempt", F.lit(attempt))
            placed.write.mode("append").partitionBy("batch", "attempt").parquet(f"{folder}/{name}")
        written = Store(self.spark, folder)
        written._commit(sorted(row["batch"] for row in batches.select("batch").collect()), attempt, since)
        return written

    def copy_to(self, folder: str) -> Store:
        """Both tables exported to another folder, from which a store can be opened."""
        return self._write_all(self.papers(), self.chunks(), self.committed(), folder, 0)

    def reembedded(self, encoder: Encoder, folder: str) -> Store:
        """A copy in which every vector comes from `encoder`, so that passages and
        questions live in one space."""
        chunks = encoder.passages(self.chunks().drop("embedding"))
        return self._write_all(self.papers(), chunks, self.committed(), folder, 0)

    def reembed(self, encoder: Encoder, space: str, slices: int = 16, most: int | None = None) -> int:
        """Replaces the vectors by those of `encoder` in a patch called `space`; returns how many slices it wrote.

        Chunks are dealt into slices by their id. Each slice is encoded, written and committed by itself, so a run that
        was lost, or ended after the `most` slices it was allowed, is gone on with by calling this again: chunks that
        have a vector in this space are not encoded a second time, those added since are.
        """
        chunks = self._placed("chunks", CHUNKS).drop("embedding")
        pending = chunks.join(self._patched(space).select("chunk_id", "attempt"), ["chunk_id", "attempt"], "left_anti")
        dealt = pending.withColumn("_slice", F.pmod(F.xxhash64("chunk_id"), F.lit(slices)))
        open_slices = sorted(row["_slice"] for row in dealt.select("_slice").distinct().collect())[:most]
        for part in open_slices:
            name = _new_attempt()
            rows = encoder.passages(dealt.where(F.col("_slice") == part)).select(*PATCH)
            rows.write.parquet(f"{self.folder}/patches/space={space}/slice={name}")
            self._commit([], name, self.version(), patch=space)
        return len(open_slices)

    def remove(self, removed: DataFrame) -> None:
        """Removes papers and, with them, their chunks.

        Only batches that hold one of them are written again, as a new attempt. When another writer has written
        one of these batches in the meantime, this fails and nothing is removed.
        """
        since = self.version()
        gone = removed.select("paper_id").distinct()
        batches = materialise(self.papers().join(gone, "paper_id", "left_semi").select("batch").distinct())
        papers, chunks = (
            rows.join(batches, "batch", "left_semi").join(gone, "paper_id", "left_anti")
            for rows in (self.papers(), self.chunks())
        )
        self._write_all(papers, chunks, batches, self.folder, since)


def _new_attempt() -> str:
    return f"a{uuid.uuid4().hex}"


def unseen(papers: DataFrame, stored: DataFrame) -> DataFrame:
    """Papers not stored yet, each identifier once even if it arrives repeatedly."""
    return papers.join(stored.select("paper_id"), "paper_id", "left_anti").dropDuplicates(["paper_id"])
