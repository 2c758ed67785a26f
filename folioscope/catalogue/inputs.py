"""The given tables under the names the operators use, and shared SQL fragments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from folioscope.session import table


def chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a chunk table: one chunk per document."""
    return table(spark, folder, "documents", "doc_id").selectExpr("doc_id as chunk_id", "text")


def question_table(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").selectExpr("item_id as query_id", "text")


def vector_table(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr("vec_id as chunk_id", "embedding")


# tf, lengths, corpus totals, df and question terms of documents x benchmark.
INDEX_CTES = """
lens AS (
  SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS length FROM documents
),
tot AS (SELECT count(*)::DOUBLE AS n, avg(length) AS mean_length FROM lens),
tf AS (
  SELECT doc_id, term, count(*)::DOUBLE AS tf
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents)
  GROUP BY doc_id, term
),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
qt AS (
  SELECT query_id, term, count(*)::DOUBLE AS qtf
  FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)
  GROUP BY query_id, term
)
"""

BM25_SCORES = """
idf AS (SELECT term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, tot),
bm AS (
  SELECT query_id, tf.doc_id AS chunk_id,
         round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN lens ON lens.doc_id = tf.doc_id, tot
  GROUP BY query_id, tf.doc_id
),
bm25 AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
  FROM bm WHERE score > 0
)
"""

BUCKET = "(('0x' || substr(md5(term), 1, 8))::BIGINT % 64)"

# Hashed vectors as sparse rows scaled to unit length in single precision.
DENSE_SCORES = f"""
dv0 AS (SELECT doc_id, {BUCKET} AS b, sum(tf) AS n FROM tf GROUP BY 1, 2),
dv AS (SELECT doc_id, b, (n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE AS x FROM dv0),
qv0 AS (SELECT query_id, {BUCKET} AS b, sum(qtf) AS n FROM qt GROUP BY 1, 2),
qv AS (SELECT query_id, b, (n / sqrt(sum(n * n) OVER (PARTITION BY query_id)))::FLOAT::DOUBLE AS x FROM qv0),
dn AS (
  SELECT q.query_id, d.doc_id AS chunk_id, round(coalesce(s.score, 0), 6) AS score
  FROM (SELECT item_id AS query_id FROM benchmark) q CROSS JOIN documents d
  LEFT JOIN (
    SELECT query_id, doc_id, sum(qv.x * dv.x) AS score FROM qv JOIN dv USING (b) GROUP BY 1, 2
  ) s ON s.query_id = q.query_id AND s.doc_id = d.doc_id
),
dense AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
  FROM dn
)
"""

FUSED = """
lists AS (
  SELECT query_id, chunk_id, rank, 0 AS list FROM dense WHERE rank <= 50
  UNION ALL SELECT query_id, chunk_id, rank, 1 FROM bm25 WHERE rank <= 50
),
rrf AS (
  SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS seen
  FROM lists GROUP BY query_id, chunk_id
),
fused AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank,
         chunk_id, score
  FROM rrf
)
"""

OVERLAP = """
dt AS (SELECT DISTINCT doc_id, term FROM tf),
qd AS (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS asked FROM qt),
pairs AS (
  SELECT f.query_id, f.chunk_id, f.rank AS before,
         round(coalesce(count(dt.term)::DOUBLE / max(qd.asked), 0), 6) AS score
  FROM fused f LEFT JOIN qd ON qd.query_id = f.query_id
  LEFT JOIN dt ON dt.doc_id = f.chunk_id AND dt.term = qd.term
  WHERE f.rank <= 25 GROUP BY 1, 2, 3
),
rr AS (
  SELECT query_id, chunk_id, score, 0 AS part, before, score AS key FROM pairs
  UNION ALL SELECT query_id, chunk_id, score, 1, rank, 0 FROM fused WHERE rank > 25
),
reranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY part, key DESC, before) AS rank,
         chunk_id, score
  FROM rr
)
"""


def over(fragment: str, documents: str = "documents", benchmark: str = "benchmark") -> str:
    """A fragment reading other relations of the same shape than the given tables."""
    return re.sub(r"\bbenchmark\b", benchmark, re.sub(r"\bdocuments\b", documents, fragment))
