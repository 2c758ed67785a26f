"""Session settings, and the two things a job needs from a session: a place to
cut lineage and the tables of a data folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "folioscope", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config(INPUT_PARTITIONS, str(os.cpu_count() if cpus == "*" else cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, set up if it is not yet."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Writes an intermediate table once to the shared checkpoint folder.

    Several consumers then read the files instead of each repeating the work, and
    a lost executor costs a re-read rather than a re-run of the lineage.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts stay small, in the JVM and in Python workers that later stages use again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


#: Into how many parts tables are dealt as they are read, where a session says so.
INPUT_PARTITIONS = "spark.folioscope.inputPartitions"


def table(spark: SparkSession, folder: str, name: str, key: str | None = None) -> DataFrame:
    """A table of a data folder, read as it lies.

    A session over small files with one row group each may ask, by the setting
    `spark.folioscope.inputPartitions`, for tables to be dealt into so many parts
    by their `key`; `local_session` asks for as many as it has cores. Nothing
    depends on a table's size.
    """
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    parts = spark.conf.get(INPUT_PARTITIONS, None)
    return rows.repartition(int(parts), key) if key and parts else rows
