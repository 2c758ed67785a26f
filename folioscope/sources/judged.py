"""Judged collections and question sets, from lines of JSON and tab-separated text.

Readers return lines; parsers turn lines into tables, so the same parser serves
files and lines that Spark produced itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import strip_space

QRELS_COLUMNS = "`query-id` string, `corpus-id` string, score bigint"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with a position that grows along the file."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("position"))


def _latest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last of several rows for a key counts."""
    return rows.groupBy(*keys).agg(F.max_by(value, "position").alias(value))


def corpus(json_lines: DataFrame) -> DataFrame:
    """`doc_id, text`: title and body, each stripped, joined by a space."""
    record = F.from_json("value", "_id string, title string, text string")
    parsed = json_lines.select(record.alias("_r"), "position").where("_r is not null")

    def part(name: str) -> Column:
        return strip_space(F.coalesce(F.col(f"_r.{name}"), F.lit("")))

    rows = parsed.select(
        F.col("_r._id").alias("doc_id"),
        strip_space(F.concat(part("title"), F.lit(" "), part("text"))).alias("text"),
        "position",
    )
    return _latest(rows, ["doc_id"], "text")


def qrels(tsv_lines: DataFrame) -> DataFrame:
    """`query_id, doc_id, grade` of a tab-separated table with a header."""
    record = F.from_csv("value", F.lit(QRELS_COLUMNS), {"sep": "\t"})
    rows = tsv_lines.where(~F.col("value").startswith("query-id\t")).select(record.alias("_r"), "position")
    named = rows.select(
        F.col("_r.query-id").alias("query_id"), F.col("_r.corpus-id").alias("doc_id"), F.col("_r.score").alias("grade"),
        "position",
    )
    return _latest(named, ["query_id", "doc_id"], "grade")


def queries(json_lines: DataFrame, judgements: DataFrame) -> DataFrame:
    """`query_id, text` of the queries that have judgements."""
    record = F.from_json("value", "_id string, text string")
    rows = json_lines.select(record.alias("_r"), "position").select(
        F.col("_r._id").alias("query_id"), F.col("_r.text").alias("text"), "position"
    )
    judged = judgements.select("query_id").distinct()
    return _latest(rows.join(judged, "query_id", "left_semi"), ["query_id"], "text")


def benchmark(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements of a collection unpacked in `folder`."""
    judgements = qrels(lines(spark, f"{folder}/qrels/{split}.tsv"))
    return (
        corpus(lines(spark, f"{folder}/corpus.jsonl")),
        queries(lines(spark, f"{folder}/queries.jsonl"), judgements),
        judgements,
    )


def question_rows(documents: DataFrame) -> DataFrame:
    """`question, paper_id, paragraph` of JSON arrays held in `value`; a question
    that is not anchored to a passage has a null paragraph."""
    parsed = F.from_json("value", "array<struct<question:string,arxiv_id:string,paragraph:bigint>>")
    return documents.select(F.explode(parsed).alias("_q")).select(
        "_q.question", F.col("_q.arxiv_id").alias("paper_id"), "_q.paragraph"
    )


def question_file(spark: SparkSession, path: str) -> DataFrame:
    return question_rows(spark.read.text(path, wholetext=True))


def plain_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings as `question`."""
    parsed = F.from_json("value", "array<string>")
    return spark.read.text(path, wholetext=True).select(F.explode(parsed).alias("question"))
