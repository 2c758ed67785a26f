"""Source archives: download what is missing, read members, resolve includes."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import time
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from folioscope.constants import DOWNLOAD_ATTEMPTS, REQUEST_DELAY_SECONDS
from folioscope.session import materialise
from folioscope.sources.kept import Kept

MEMBERS = "array<struct<name:string,text:string>>"

# --- fixed values: how one LaTeX file names another ------------------------
INCLUDE_CALL = r"\\(?:input|include)\s*\{([^}]+)\}"
DOCUMENT_OPENING = r"\\begin\s*\{document\}"
# ---------------------------------------------------------------------------


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Archives on disk as `paper_id, content`; empty files do not count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar.gz").load(folder)
    return files.where("length > 0").select(
        F.regexp_extract("path", r"([^/]+)\.tar\.gz$", 1).alias("paper_id"), "content"
    )


def missing(papers: DataFrame, archives: DataFrame) -> DataFrame:
    """Papers whose archive has not been stored yet."""
    return papers.join(archives.select("paper_id"), "paper_id", "left_anti")


def download(
    papers: DataFrame,
    fetch: Callable[[str], bytes],
    attempts: int = DOWNLOAD_ATTEMPTS,
    delay: float = REQUEST_DELAY_SECONDS,
    sleep: Callable[[float], None] = time.sleep,
    arrivals: str | None = None,
) -> DataFrame:
    """Fetches one archive per paper as `paper_id, content`.

    `fetch` raises on any failure; it is retried with growing pauses and a paper
    that never arrives is left out. The host allows one request per `delay`
    seconds, which is why the requests share a single task: only the list of
    requests is brought together for it, and contents are written down as they
    come, so what follows runs in parallel and a lost task later on asks for
    nothing twice. With a shared folder for `arrivals`, every archive is kept there
    on arrival, and when this task itself is lost, the next attempt asks only for
    what had not come.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Kept(arrivals) if arrivals else None
        for batch in batches:
            for paper_id in batch["paper_id"]:
                content = kept.get(paper_id) if kept else None
                if content is not None:
                    yield pd.DataFrame({"paper_id": [paper_id], "content": [content]})
                    continue
                for attempt in range(attempts):
                    try:
                        content = fetch(paper_id)
                    except Exception:
                        if attempt + 1 < attempts:
                            sleep(min(20.0, max(2.0, 2.0 * 2**attempt)))
                        continue
                    if kept:
                        kept.put(paper_id, bytes(content))
                    yield pd.DataFrame({"paper_id": [paper_id], "content": [content]})
                    sleep(delay)
                    break

    wanted = papers.select("paper_id").distinct().repartition(1).sortWithinPartitions("paper_id")
    return materialise(wanted.mapInPandas(run, "paper_id string, content binary"))


def keep(archives: DataFrame, folder: str) -> None:
    """Adds downloaded archives to the cache that `cached` reads."""
    archives.select("paper_id", "content").write.mode("append").parquet(folder)


def cached(spark: SparkSession, folder: str) -> DataFrame:
    """Archives kept so far as `paper_id, content`; none when nothing was."""
    try:
        return spark.read.schema("paper_id string, content binary").parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "paper_id string, content binary")


def fetched(papers: DataFrame, folder: str, fetch: Callable[[str], bytes], **options) -> DataFrame:
    """Archives of the papers: kept ones from the cache, missing ones downloaded and then kept.

    Archives are kept one by one while they arrive (a folder whose name starts with an underscore is not read as part
    of the cache), so neither a lost task nor a lost driver makes the host send one again.
    """
    have = cached(papers.sparkSession, folder)
    keep(download(missing(papers, have), fetch, arrivals=f"{folder}/_arrivals", **options), folder)
    return cached(papers.sparkSession, folder).join(papers.select("paper_id").distinct(), "paper_id", "left_semi")


def _members(archive: bytes) -> list[dict]:
    """`.tex` files of an archive; a lone compressed file counts as `main`."""
    try:
        with tarfile.open(fileobj=io.BytesIO(archive), mode="r:*") as tar:
            return [
                {"name": entry.name[: -len(".tex")], "text": tar.extractfile(entry).read().decode("utf-8", "replace")}
                for entry in tar
                if entry.isfile() and entry.name.endswith(".tex")
            ]
    except (tarfile.TarError, OSError, EOFError, zlib.error):
        pass
    try:
        return [{"name": "main", "text": gzip.decompress(archive).decode("utf-8", "replace")}]
    except (OSError, EOFError, zlib.error):
        return []


def _read_all(archives: pd.Series) -> pd.Series:
    return archives.map(_members)


def member_array(archive: Column) -> Column:
    """Files of each archive in archive order."""
    read = F.pandas_udf(_read_all, MEMBERS)
    return read(archive)


def _expand(entry: str, files: dict[str, str]) -> str:
    """Text of `entry` with include calls replaced by the files they name.

    The stack holds the files being expanded; a file that is already on it, or
    does not exist, contributes nothing.
    """
    output: list[str] = []
    stack = [(entry, iter(re.split(INCLUDE_CALL, files[entry])), False)]
    while stack:
        name, parts, is_call = stack.pop()
        part = next(parts, None)
        if part is None:
            continue
        stack.append((name, parts, not is_call))
        if not is_call:
            output.append(part)
            continue
        target = part.strip().removesuffix(".tex")
        if target in files and all(target != open_name for open_name, _, _ in stack):
            stack.append((target, iter(re.split(INCLUDE_CALL, files[target])), False))
    return "".join(output)


def _expand_all(entries: pd.Series, members: pd.Series) -> pd.Series:
    return pd.Series(
        [
            "" if entry is None else _expand(entry, {m["name"]: m["text"] for m in listing})
            for entry, listing in zip(entries, members, strict=True)
        ]
    )


def entry_point(members: Column) -> Column:
    """Name of the file that opens the document: fewest folders deep, then the
    shortest name, then the first in the archive. Null when there is none."""
    opening = F.filter(members, lambda m: m["text"].rlike(DOCUMENT_OPENING))
    keyed = F.transform(
        opening,
        lambda m, i: F.struct(
            (F.length(m["name"]) - F.length(F.replace(m["name"], F.lit("/"), F.lit("")))).alias("depth"),
            F.length(m["name"]).alias("size"),
            i.alias("at"),
            m["name"].alias("name"),
        ),
    )
    return F.array_min(keyed)["name"]


def flatten(members: Column) -> Column:
    """One LaTeX text per submission; empty when no file opens a document."""
    expand = F.pandas_udf(_expand_all, "string")
    return expand(entry_point(members), members)
