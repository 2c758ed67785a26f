"""Indexing and ranking queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioscope.catalogue import query
from folioscope.catalogue.inputs import (
    BM25_SCORES,
    DENSE_SCORES,
    FUSED,
    INDEX_CTES,
    OVERLAP,
    chunk_table,
    over,
    question_table,
    vector_table,
)
from folioscope.functions.english import STOP_WORDS, stem_steps
from folioscope.functions.sizing import measure
from folioscope.functions.text import bags
from folioscope.operators import cells, dense, fulltext, fusion, lexical, phrases, segments
from folioscope.operators.rerank import rerank
from folioscope.plans import retrieval
from folioscope.plugins import HashingEncoder, OverlapScorer
from folioscope.session import checkpoint_folder, materialise, table


def stemmed_sql(source: str) -> str:
    """`source(term)` with its stem as `w`, one nested projection per step."""
    statement, present = f"SELECT term, term AS w FROM ({source})", {"w"}
    for step in stem_steps():
        for name, value in step.items():
            value = value.replace("'$1Y')", r"'\1Y', 'g')")
            change = f"* REPLACE ({value} AS {name})" if name in present else f"*, {value} AS {name}"
            present.add(name)
            statement = f"SELECT {change} FROM ({statement})"
    return statement


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
STOPPED = ", ".join(f"'{word}'" for word in STOP_WORDS)
LEXEME_CTES = f"""
wd AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({WORDS}) AS term FROM documents)
  WHERE term NOT IN ({STOPPED}) GROUP BY ALL
),
wq AS (
  SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({WORDS}) AS term FROM benchmark)
  WHERE term NOT IN ({STOPPED})
),
stems AS (SELECT term, w AS lexeme FROM ({stemmed_sql("SELECT term FROM wd UNION SELECT term FROM wq")})),
asked AS (SELECT DISTINCT query_id, lexeme FROM wq JOIN stems USING (term)),
ft AS (
  SELECT query_id, doc_id AS chunk_id, round(sum(tf) * 0.1, 6)::DOUBLE AS score
  FROM asked JOIN stems USING (lexeme) JOIN wd USING (term) GROUP BY ALL
),
fts AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM ft
)
"""


def corpus(spark, folder) -> retrieval.Corpus:
    return retrieval.Corpus(chunk_table(spark, folder))


@query(f"WITH {INDEX_CTES} SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS occurrences FROM tf GROUP BY term")
def tokenize_counts(spark, folder):
    terms = bags(chunk_table(spark, folder), "chunk_id", "text").selectExpr("inline_outer(terms) as (term, tf)")
    return (
        terms.where("term is not null")
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))
    )


@query(
    f"WITH {INDEX_CTES} SELECT term, df::BIGINT AS df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, tot"
)
def term_stats(spark, folder):
    stats = lexical.term_stats(lexical.build_index(chunk_table(spark, folder)))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


NAMED = """
named AS (SELECT 'd' || doc_id AS doc_id, text FROM documents), asked AS (SELECT 'q' || item_id AS item_id, text FROM benchmark)
"""


@query(
    f"""WITH {NAMED}, {over(INDEX_CTES, "named", "asked")}, {BM25_SCORES}
    SELECT query_id, rank, chunk_id, score FROM bm25 WHERE rank <= 10"""
)
def bm25_topk_named(spark, folder):
    """The same ranking over identifiers that are not numbers."""
    chunks = chunk_table(spark, folder).withColumn("chunk_id", F.concat(F.lit("d"), "chunk_id"))
    questions = question_table(spark, folder).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    return lexical.search(chunks, questions, limit=10)


def saved_index(spark, folder) -> lexical.TermIndex:
    path = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    lexical.build_index(chunk_table(spark, folder)).save(path)
    return lexical.TermIndex.load(spark, path)


def saved_chunks(spark, folder, *columns: str):
    """Documents as a stored chunk table with their vectors."""
    path = f"{checkpoint_folder(spark)}/chunks-{uuid.uuid4().hex}"
    chunks = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text", *columns)
    HashingEncoder().passages(chunks).write.parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {INDEX_CTES}, {BM25_SCORES} SELECT query_id, rank, chunk_id, score FROM bm25 WHERE rank <= 10")
def bm25_stored_topk(spark, folder):
    """Ranking from a stored index, of which only the questions' partitions are opened."""
    index = saved_index(spark, folder)
    return lexical.search(chunk_table(spark, folder), question_table(spark, folder), limit=10, index=index)


def segmented(spark, *batches) -> segments.SegmentedIndex:
    index = segments.SegmentedIndex(spark, f"{checkpoint_folder(spark)}/segments-{uuid.uuid4().hex}")
    for batch in batches:
        index.add(batch)
    return index


@query(f"WITH {INDEX_CTES}, {BM25_SCORES} SELECT query_id, rank, chunk_id, score FROM bm25 WHERE rank <= 10")
def bm25_pruned_topk(spark, folder):
    """The same ranking from blocks with bounds, of which those below the k-th best are not scored."""
    return segments.search(segmented(spark, chunk_table(spark, folder)), question_table(spark, folder), limit=10)


@query(f"WITH {INDEX_CTES}, {BM25_SCORES} SELECT query_id, rank, chunk_id, score FROM bm25 WHERE rank <= 10")
def bm25_after_second_batch(spark, folder):
    """The same ranking after the corpus came in two batches."""
    chunks = chunk_table(spark, folder)
    late = F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 0
    return segments.search(segmented(spark, chunks.where(~late), chunks.where(late)), question_table(spark, folder), limit=10)


LEFT = "left_over AS (SELECT * FROM documents WHERE lang IS DISTINCT FROM 'fr')"


@query(
    f"""WITH {LEFT}, {over(INDEX_CTES, "left_over", "benchmark")}, {BM25_SCORES}
    SELECT query_id, rank, chunk_id, score FROM bm25 WHERE rank <= 10"""
)
def bm25_after_removal(spark, folder):
    """Ranking after one language has been taken out and the segments merged."""
    chunks = chunk_table(spark, folder)
    late = F.pmod(F.xxhash64("chunk_id"), F.lit(3)) == 0
    index = segmented(spark, chunks.where(~late), chunks.where(late))
    index.remove(table(spark, folder, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("chunk_id")))
    index.merge(below=1 << 20)
    return segments.search(index, question_table(spark, folder), limit=10)


@query(f"WITH {INDEX_CTES}, {DENSE_SCORES} SELECT query_id, rank, chunk_id, score FROM dense WHERE rank <= 10")
def dense_stored_topk(spark, folder):
    """Ranking from stored vectors; only the questions are encoded."""
    return retrieval.dense_ranking(retrieval.Corpus(saved_chunks(spark, folder)), question_table(spark, folder), 10)


@query(
    f"""WITH {INDEX_CTES}, {BM25_SCORES}, {DENSE_SCORES}, {FUSED}, {OVERLAP}
    SELECT query_id, rank AS number, chunk_id, score, lang, source, md5(text) AS text_md5
    FROM reranked JOIN documents ON doc_id = chunk_id WHERE rank <= 5"""
)
def search_stored_passages(spark, folder):
    """The whole default search over stored postings, vectors and texts."""
    chunks = saved_chunks(spark, folder, "lang", "source")
    corpus = retrieval.Corpus(chunks, index=saved_index(spark, folder))
    found = retrieval.passages(corpus, question_table(spark, folder))
    return found.withColumn("text_md5", F.md5("text")).drop("text")


@query(
    f"""WITH {INDEX_CTES},
    raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, tot)
    SELECT term, df::BIGINT AS df,
           round(CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END, 6) AS idf FROM raw"""
)
def library_term_stats(spark, folder):
    stats = lexical.library_term_stats(lexical.build_index(chunk_table(spark, folder)))
    return stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {INDEX_CTES} SELECT doc_id AS chunk_id, length, round(1.5 * (0.25 + 0.75 * length / mean_length), 6) AS norm FROM lens, tot")
def doc_lengths(spark, folder):
    index = lexical.build_index(chunk_table(spark, folder))
    mean = index.totals()[1]
    return index.lengths.select(
        "chunk_id", "length", F.round(1.5 * (0.25 + 0.75 * F.col("length") / mean), 6).alias("norm")
    )


@query(
    f"""WITH {INDEX_CTES} SELECT n::BIGINT AS chunks, (SELECT count(*) FROM df)::BIGINT AS vocabulary,
    (SELECT count(*) FROM tf)::BIGINT AS postings,
    ((SELECT count(*) FROM tf) * 8 + (SELECT count(*) FROM df) * 8 + 4 + n * 4)::BIGINT AS bytes FROM tot"""
)
def index_size(spark, folder):
    return lexical.index_size(lexical.build_index(chunk_table(spark, folder)))


@query(f"WITH {INDEX_CTES}, {BM25_SCORES} SELECT query_id, rank, chunk_id, score FROM bm25 WHERE rank <= 10")
def bm25_topk(spark, folder):
    return lexical.search(chunk_table(spark, folder), question_table(spark, folder), limit=10)


@query(
    f"""WITH {INDEX_CTES},
    raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, tot),
    idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
    bm AS (
      SELECT query_id, tf.doc_id AS chunk_id,
             round(sum(idf * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))), 6) AS score
      FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN lens ON lens.doc_id = tf.doc_id, tot
      GROUP BY query_id, tf.doc_id
    ),
    ranked AS (
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
      FROM bm WHERE score > 0
    )
    SELECT query_id, rank, chunk_id, score FROM ranked WHERE rank <= 10"""
)
def bm25_library_topk(spark, folder):
    return lexical.search(chunk_table(spark, folder), question_table(spark, folder), limit=10, library=True)


@query(
    f"""WITH {LEXEME_CTES} SELECT lexeme, count(DISTINCT doc_id)::BIGINT AS df, sum(tf)::BIGINT AS positions
    FROM wd JOIN stems USING (term) GROUP BY lexeme"""
)
def lexeme_stats(spark, folder):
    found = fulltext.lexemes(chunk_table(spark, folder), "chunk_id", "text")
    return found.groupBy("lexeme").agg(F.count(F.lit(1)).alias("df"), F.sum("positions").alias("positions"))


@query(f"WITH {LEXEME_CTES} SELECT query_id, rank, chunk_id, score FROM fts WHERE rank <= 10")
def fts_or_topk(spark, folder):
    return fulltext.search(chunk_table(spark, folder), question_table(spark, folder), limit=10)


def quoted_questions(spark, folder):
    """Questions with two quoted phrases, two words and an excluded word, from the words of each benchmark item."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    rows = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("w")).where("size(w) >= 12")
    return rows.selectExpr(
        "query_id", """concat('"', w[2], ' ', w[3], ' ', w[4], '" ', w[7], ', ', w[0], ' "', w[9], ' ', w[10], '" -', w[5]) AS text"""
    )


def stored_lexemes(spark, folder, english: bool):
    path = f"{checkpoint_folder(spark)}/lexemes-{uuid.uuid4().hex}"
    phrases.LexemeIndex.build(chunk_table(spark, folder), english).save(path)
    return phrases.LexemeIndex.load(spark, path, english)


PHRASE_CTES = f"""
qw AS (SELECT item_id AS query_id, {WORDS} AS w FROM benchmark WHERE len({WORDS}) >= 12),
op AS (
  SELECT query_id, 1 AS operand, unnest([0, 1, 2]) AS off, 3 AS n, false AS neg, unnest(w[3:5]) AS term FROM qw
  UNION ALL SELECT query_id, 2, 0, 1, false, w[8] FROM qw
  UNION ALL SELECT query_id, 3, 0, 1, false, w[1] FROM qw
  UNION ALL SELECT query_id, 4, unnest([0, 1]), 2, false, unnest(w[10:11]) FROM qw
  UNION ALL SELECT query_id, 5, 0, 1, true, w[6] FROM qw
),
dp AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
hit AS (SELECT query_id, doc_id, operand, off, n, neg, term, pos FROM op JOIN dp USING (term)),
win AS (
  SELECT query_id, doc_id, neg, pos - off AS a, pos - off + n - 1 AS b FROM hit
  GROUP BY query_id, doc_id, operand, neg, n, pos - off HAVING count(DISTINCT off) = n
)
"""
PHRASE_RANKED = """
low AS (
  SELECT x.query_id, x.doc_id, x.a, x.b FROM cov x WHERE NOT EXISTS (
    SELECT 1 FROM cov y WHERE y.query_id = x.query_id AND y.doc_id = x.doc_id AND y.a >= x.a AND y.b <= x.b AND (y.a > x.a OR y.b < x.b))
),
scored AS (SELECT query_id, doc_id AS chunk_id, round(count(*) * 0.1, 6)::DOUBLE AS score FROM low GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
SELECT query_id, rank, chunk_id, score FROM ranked WHERE rank <= 10
"""


@query(
    f"""WITH {PHRASE_CTES},
    freed AS (SELECT query_id, doc_id, pos AS a, pos AS b FROM hit JOIN (SELECT query_id, term AS no FROM op WHERE neg) USING (query_id)
      WHERE term <> no),
    cov AS (SELECT query_id, doc_id, a, b FROM win WHERE NOT neg UNION SELECT * FROM freed), {PHRASE_RANKED}"""
)
def fts_phrase_topk(spark, folder):
    """Phrases, words and an exclusion joined by OR, over stored lexemes."""
    return phrases.search(stored_lexemes(spark, folder, False), quoted_questions(spark, folder), limit=10)


@query(
    f"""WITH {PHRASE_CTES}, no AS (SELECT DISTINCT query_id, doc_id FROM win WHERE neg),
    cov AS (SELECT DISTINCT query_id, doc_id, a, b FROM win ANTI JOIN no USING (query_id, doc_id) WHERE NOT neg), {PHRASE_RANKED}"""
)
def fts_exclude_topk(spark, folder):
    """The same questions where the exclusion excludes."""
    return phrases.search(stored_lexemes(spark, folder, False), quoted_questions(spark, folder), limit=10, strict=True)


@query(f"WITH {LEXEME_CTES} SELECT query_id, rank, chunk_id, score FROM fts WHERE rank <= 10")
def fts_stored_topk(spark, folder):
    """Stemmed questions without operators over stored lexemes."""
    plain = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")
    return phrases.search(stored_lexemes(spark, folder, True), question_table(spark, folder).withColumn("text", plain), limit=10)


@query(
    f"""WITH {INDEX_CTES}, {BM25_SCORES}, {DENSE_SCORES}, {LEXEME_CTES},
    lists AS (
      SELECT query_id, chunk_id, rank, 0 AS list FROM dense WHERE rank <= 50
      UNION ALL SELECT query_id, chunk_id, rank, 1 FROM bm25 WHERE rank <= 50
      UNION ALL SELECT query_id, chunk_id, rank, 2 FROM fts WHERE rank <= 50
    ),
    rrf AS (
      SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS seen
      FROM lists GROUP BY query_id, chunk_id
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS rank, chunk_id, score
    FROM rrf"""
)
def rrf_three_lists(spark, folder):
    documents, questions = corpus(spark, folder), question_table(spark, folder)
    extent = measure(questions)
    return fusion.fuse(
        [
            retrieval.dense_ranking(documents, questions, 50),
            retrieval.lexical_ranking(documents, questions, 50, extent),
            fulltext.search(documents.chunks, questions, 50, extent),
        ]
    )


NEAREST = """WITH pairs AS (
      SELECT q.vec_id AS query_id, d.vec_id AS chunk_id,
             round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) + 0.0 AS score
      FROM embeddings q CROSS JOIN embeddings d
    ), ranked AS (
      SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score
      FROM pairs
    ) SELECT query_id, rank, chunk_id, score FROM ranked WHERE rank <= 10"""


@query(NEAREST)
def dense_topk(spark, folder):
    vectors = vector_table(spark, folder)
    return dense.search(vectors, vectors.withColumnRenamed("chunk_id", "query_id"), limit=10)


@query(NEAREST)
def dense_cells_topk(spark, folder):
    """The same ranking from stored cells of 8-bit residuals, all of them looked at."""
    vectors = vector_table(spark, folder)
    index = cells.CellIndex.save(vectors, f"{checkpoint_folder(spark)}/cells-{uuid.uuid4().hex}")
    return cells.search(index, vectors.withColumnRenamed("chunk_id", "query_id"), limit=10, probes=len(index.centroids))


@query(f"WITH {INDEX_CTES}, {DENSE_SCORES} SELECT query_id, rank, chunk_id, score FROM dense WHERE rank <= 10")
def dense_topk_hashed(spark, folder):
    return retrieval.dense_ranking(corpus(spark, folder), question_table(spark, folder), 10)


@query(
    f"""WITH {INDEX_CTES}, {DENSE_SCORES},
    v AS (SELECT doc_id AS chunk_id, b, round(x, 6) AS x FROM dv)
    SELECT chunk_id, count(*)::BIGINT AS used, max(x) AS largest FROM v GROUP BY chunk_id
    UNION ALL SELECT doc_id, 0, 0 FROM lens WHERE length = 0"""
)
def passage_encoding(spark, folder):
    vectors = HashingEncoder().passages(chunk_table(spark, folder))
    return vectors.select(
        "chunk_id",
        F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("used"),
        F.round(F.array_max("embedding").cast("double"), 6).alias("largest"),
    )


@query(f"WITH {INDEX_CTES}, {BM25_SCORES}, {DENSE_SCORES}, {FUSED} SELECT query_id, rank, chunk_id, score FROM fused")
def rrf_fuse(spark, folder):
    return retrieval.fused_ranking(corpus(spark, folder), question_table(spark, folder))


@query(f"WITH {INDEX_CTES}, {BM25_SCORES}, {DENSE_SCORES}, {FUSED} SELECT query_id, rank, chunk_id, score FROM fused WHERE rank <= 5")
def hybrid_topk(spark, folder):
    return retrieval.search(corpus(spark, folder), question_table(spark, folder), reranked=False)


@query(f"WITH {INDEX_CTES}, {BM25_SCORES}, {DENSE_SCORES}, {FUSED}, {OVERLAP} SELECT query_id, rank, chunk_id, score FROM reranked")
def rerank_full(spark, folder):
    documents, questions = corpus(spark, folder), question_table(spark, folder)
    extent = measure(questions)
    fused = materialise(retrieval.fused_ranking(documents, questions, extent=extent))
    return rerank(fused, questions, documents.chunks, OverlapScorer(), extent)


@query(f"WITH {INDEX_CTES}, {BM25_SCORES}, {DENSE_SCORES}, {FUSED}, {OVERLAP} SELECT query_id, rank, chunk_id, score FROM reranked WHERE rank <= 5")
def rerank_topk(spark, folder):
    return retrieval.search(corpus(spark, folder), question_table(spark, folder))


@query(
    f"""WITH {INDEX_CTES}, {BM25_SCORES}, {DENSE_SCORES}, {FUSED}
    SELECT query_id, rank AS number, chunk_id, score, lang, source, md5(text) AS text_md5
    FROM fused JOIN documents ON doc_id = chunk_id WHERE rank <= 5"""
)
def search_passages(spark, folder):
    """Search results with provenance, text fetched after ranking."""
    chunks = table(spark, folder, "documents", "doc_id").selectExpr("doc_id as chunk_id", "text", "lang", "source")
    found = retrieval.passages(retrieval.Corpus(chunks), question_table(spark, folder), reranked=False)
    return found.withColumn("text_md5", F.md5("text")).drop("text")
