"""Planning, context, citations, cache and event streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalogue import query
from folioscope.catalogue.inputs import (
    BM25_SCORES,
    DENSE_SCORES,
    BUCKET,
    FUSED,
    INDEX_CTES,
    OVERLAP,
    over,
    question_table,
    vector_table,
)
from folioscope.constants import COMPARISON_PATTERN, REFUSAL, SIDE_PATTERN, WHITESPACE
from folioscope.functions.sizing import measure, spread_join, top_ranked
from folioscope.operators import cache, citations, context, events, planning
from folioscope.plans import answering
from folioscope.plans.evaluation import covered_report, latency_report
from folioscope.plans.evaluation import grounding_report as report
from folioscope.plans.retrieval import Corpus
from folioscope.session import table

# --- inputs ----------------------------------------------------------------


def asked(spark, folder):
    """Questions; one that joins two things with "and" is put as a comparison."""
    text = F.when(F.col("text").contains(" and "), F.concat(F.lit("Compare "), "text")).otherwise(F.col("text"))
    return question_table(spark, folder).withColumn("text", text)


ASKED = """
asked AS (SELECT item_id, CASE WHEN contains(text, ' and ') THEN 'Compare ' || text ELSE text END AS text FROM benchmark)
"""


def talk(spark, folder):
    return table(spark, folder, "conversations", "conv_id")


def marked_answers(spark, folder):
    """Assistant turns with markers derived from the turn; some refuse, some cite
    numbers that do not exist. Their passages are the other turns."""
    rows = talk(spark, folder)
    size = F.length("text")
    text = F.when(
        size % 3 != 0,
        F.regexp_replace(F.col("text"), F.lit(r"([a-z])\.(\s)"), F.concat(F.lit("$1 ["), "turn", F.lit("].$2"))),
    ).otherwise(F.col("text"))
    text = F.when(size % 5 == 0, F.concat(text, F.lit(" See [0][99] and [1]. [99999999999999999999]"))).otherwise(text)
    text = F.when(size % 7 == 0, F.concat(F.lit("\n" + REFUSAL + ". "), text)).otherwise(text)
    answers = rows.where("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), "conv_id", text.alias("answer")
    )
    others = top_ranked(
        rows.where("role <> 'assistant'").select("conv_id", "turn", "role", "text"),
        ["conv_id"],
        [F.col("turn").asc()],
        6,
        rank="number",
    ).select(
        F.col("conv_id").alias("query_id"),
        "number",
        F.concat(F.lit("conv"), "conv_id", F.lit("v"), "turn").alias("paper_id"),
        F.col("role").alias("section"),
        F.col("turn").cast("long").alias("paragraph"),
        "text",
    )
    passages = context.passage_arrays(others).withColumnRenamed("query_id", "conv_id")
    fits = measure(rows.select("conv_id", "text")).fits(copies=2)
    return spread_join(answers, passages, ["conv_id"], fits=fits, spread=["query_id"], how="left")


def checked_answers(spark, folder):
    return citations.check(marked_answers(spark, folder))


STRIPPED = f"regexp_replace(answer, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g')"
ANSWERS = rf"""
raw AS (
  SELECT conv_id * 100 + turn AS query_id, conv_id, length(text) AS size, turn,
    CASE WHEN length(text) % 3 <> 0 THEN regexp_replace(text, '([a-z])\.(\s)', '\1 [' || turn || '].\2', 'g') ELSE text END AS t
  FROM conversations WHERE role = 'assistant'
),
answers AS (
  SELECT query_id, conv_id,
    CASE WHEN size % 7 = 0 THEN chr(10) || '{REFUSAL}. ' ELSE '' END || t ||
    CASE WHEN size % 5 = 0 THEN ' See [0][99] and [1]. [99999999999999999999]' ELSE '' END AS answer
  FROM raw
),
passages AS (
  SELECT conv_id, number, paper_id, role, turn FROM (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number,
           'conv' || conv_id || 'v' || turn AS paper_id, role, turn
    FROM conversations WHERE role <> 'assistant') WHERE number <= 6
),
sents AS (
  SELECT query_id, conv_id, starts_with({STRIPPED}, '{REFUSAL}') AS refused,
    list_filter(string_split(regexp_replace({STRIPPED}, '([.!?]){WHITESPACE}+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: length(regexp_replace(x, '{WHITESPACE}+', '', 'g')) > 0) AS s
  FROM answers
),
nums AS (
  SELECT query_id, conv_id, refused,
    CASE WHEN refused THEN 0 ELSE len(s) END AS sentences,
    CASE WHEN refused THEN [] ELSE list_transform(s, lambda x: regexp_extract_all(x, '\[(\d+)\]', 1)) END AS n
  FROM sents
),
flat AS (
  SELECT query_id, conv_id, refused, sentences, len(list_filter(n, lambda x: len(x) = 0)) AS uncited,
    flatten(n) AS f,
    (SELECT count(*) FROM passages p WHERE p.conv_id = nums.conv_id) AS known
  FROM nums
),
chk AS (
  SELECT query_id, conv_id, refused, sentences::BIGINT AS sentences, uncited::BIGINT AS uncited,
    list_sort(list_distinct(list_transform(list_filter(f, lambda x: coalesce(TRY_CAST(x AS BIGINT) BETWEEN 1 AND known, false)),
      lambda x: TRY_CAST(x AS BIGINT)))) AS cited,
    list_transform(list_filter(f, lambda x: NOT coalesce(TRY_CAST(x AS BIGINT) BETWEEN 1 AND known, false)),
      lambda x: regexp_replace(x, '^0+([0-9])', '\1')) AS invalid,
    CASE WHEN refused OR sentences = 0 THEN 1.0 ELSE 1.0 - uncited::DOUBLE / sentences END::DOUBLE AS grounded
  FROM flat
)
"""

# --- routing and planning --------------------------------------------------


@query(f"WITH {ASKED} SELECT item_id AS query_id, regexp_matches(text, '(?i){COMPARISON_PATTERN}') AS comparative FROM asked")
def route_questions(spark, folder):
    return planning.route(asked(spark, folder)).select("query_id", "comparative")


PLAN = rf"""
parts AS (
  SELECT item_id, text, regexp_matches(text, '(?i){COMPARISON_PATTERN}') AS comparative,
    list_filter(list_transform(string_split(regexp_replace(text, '(?i){SIDE_PATTERN}', chr(1), 'g'), chr(1)), lambda p: trim(p, ' ?.,')),
      lambda p: len(list_filter(string_split(regexp_replace(p, '{WHITESPACE}+', ' ', 'g'), ' '), lambda w: w <> '')) >= 3) AS sides
  FROM asked
),
runs AS (
  SELECT item_id, CASE WHEN NOT comparative THEN [text] WHEN len(sides) = 0 THEN [text, text] ELSE list_prepend(text, sides) END AS q
  FROM parts
),
planned AS (SELECT item_id AS query_id, unnest(q) AS text, generate_subscripts(q, 1) - 1 AS query_no FROM runs)
"""


@query(f"WITH {ASKED}, {PLAN} SELECT query_id, query_no, text FROM planned")
def plan_queries(spark, folder):
    return planning.plan(asked(spark, folder))


GATHERED = f"""
{ASKED}, {PLAN},
subq AS (SELECT query_id * 65536 + min(query_no) AS item_id, text FROM planned GROUP BY query_id, text),
{over(INDEX_CTES, benchmark="subq")}, {over(BM25_SCORES, benchmark="subq")}, {over(DENSE_SCORES, benchmark="subq")}, {FUSED},
firsts AS (
  SELECT query_id // 65536 AS qid, chunk_id, min((query_id % 65536) * 1000 + rank) AS place FROM fused WHERE rank <= 5 GROUP BY ALL
),
found AS (
  SELECT qid AS query_id, row_number() OVER (PARTITION BY qid ORDER BY place, chunk_id) AS number, chunk_id FROM firsts
)
"""


GATHERED_RERANKED = f"""
{ASKED}, {PLAN},
subq AS (SELECT query_id * 65536 + min(query_no) AS item_id, text FROM planned GROUP BY query_id, text),
{over(INDEX_CTES, benchmark="subq")}, {over(BM25_SCORES, benchmark="subq")}, {over(DENSE_SCORES, benchmark="subq")}, {FUSED}, {OVERLAP},
firsts AS (
  SELECT query_id // 65536 AS qid, chunk_id, min((query_id % 65536) * 1000 + rank) AS place FROM reranked WHERE rank <= 5 GROUP BY ALL
),
found AS (
  SELECT qid AS query_id, row_number() OVER (PARTITION BY qid ORDER BY place, chunk_id) AS number, chunk_id FROM firsts
)
"""


def paper_chunks(spark, folder):
    return table(spark, folder, "documents", "doc_id").selectExpr(
        "doc_id as chunk_id", "text", "source || 'v1' as paper_id", "lang as section", "doc_id as paragraph"
    )


@query(f"WITH {GATHERED} SELECT query_id, number, chunk_id FROM found WHERE number <= 6")
def gather_context(spark, folder):
    found = answering.gather(Corpus(paper_chunks(spark, folder)), asked(spark, folder), reranked=False)
    return found.select("query_id", "number", "chunk_id")


PROMPTS = f"""
{GATHERED},
listed AS (
  SELECT query_id, string_agg('[' || number || '] ' || source || 'v1 · ' || lang || ' · paragraph ' || doc_id || chr(10) || text,
    chr(10) || chr(10) ORDER BY number) AS body
  FROM found JOIN documents ON doc_id = chunk_id WHERE number <= 6 GROUP BY query_id
)
"""


@query(
    f"""WITH {PROMPTS} SELECT item_id AS query_id,
    md5('{context.INSTRUCTIONS.replace("'", "''")}' || chr(10) || 'Passages:' || chr(10) || chr(10) || coalesce(body, '')
      || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer:') AS prompt_md5
    FROM asked LEFT JOIN listed ON query_id = item_id"""
)
def prompt_build(spark, folder):
    corpus, questions = Corpus(paper_chunks(spark, folder)), asked(spark, folder)
    found = answering.gather(corpus, questions, reranked=False)
    return answering.with_prompts(corpus, questions, found).select("query_id", F.md5("prompt").alias("prompt_md5"))


FIRST_SENTENCE = (
    f"regexp_replace(coalesce(list_filter(string_split(regexp_replace(regexp_replace(text, '^{WHITESPACE}+|{WHITESPACE}+$', '', 'g'),"
    rf" '([.!?]){WHITESPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(regexp_replace(x, '{WHITESPACE}+', '', 'g')) > 0)[1], text),"
    r" '[.!?\s]+$', '')"
)


@query(
    f"""WITH {GATHERED},
    claims AS (
      SELECT query_id, number, {FIRST_SENTENCE} || ' [' || number || '].' AS claim
      FROM found JOIN documents ON doc_id = chunk_id WHERE number <= 2
    ),
    support AS (
      SELECT DISTINCT f.query_id FROM found f JOIN qt ON qt.query_id = f.query_id * 65536
      JOIN tf ON tf.doc_id = f.chunk_id AND tf.term = qt.term WHERE f.number <= 6
    )
    SELECT item_id AS query_id, (s.query_id IS NULL) AS refused,
      md5(CASE WHEN s.query_id IS NULL THEN '{REFUSAL}.' ELSE (SELECT string_agg(claim, ' ' ORDER BY number) FROM claims c WHERE c.query_id = item_id) END) AS answer_md5
    FROM asked LEFT JOIN support s ON s.query_id = item_id"""
)
def answer_questions(spark, folder):
    answers = answering.answer(Corpus(paper_chunks(spark, folder)), asked(spark, folder), reranked=False)
    return answers.select("query_id", "refused", F.md5("answer").alias("answer_md5"))


def answers_sql(gathered: str, more: str = "", columns: str = "", joins: str = "", answer: str = "") -> str:
    """Checked answers of the extractive model over a gathered context."""
    told = "CASE WHEN s.query_id IS NULL THEN '" + REFUSAL + ".' ELSE (SELECT string_agg(claim, ' ' ORDER BY number) FROM claims c WHERE c.query_id = item_id) END"
    return f"""WITH {gathered},
    claims AS (
      SELECT query_id, number, {FIRST_SENTENCE} || ' [' || number || '].' AS claim
      FROM found JOIN documents ON doc_id = chunk_id WHERE number <= 2
    ),
    support AS (
      SELECT DISTINCT f.query_id FROM found f JOIN qt ON qt.query_id = f.query_id * 65536
      JOIN tf ON tf.doc_id = f.chunk_id AND tf.term = qt.term WHERE f.number <= 6
    ){more}
    SELECT item_id AS query_id, {columns} md5({answer.format(told=told) if answer else told}) AS answer_md5
    FROM asked LEFT JOIN support s ON s.query_id = item_id {joins}"""


@query(f"WITH {GATHERED_RERANKED} SELECT query_id, number, chunk_id FROM found WHERE number <= 6")
def gather_reranked(spark, folder):
    """The context of every question by the default plan."""
    found = answering.gather(Corpus(paper_chunks(spark, folder)), asked(spark, folder))
    return found.select("query_id", "number", "chunk_id")


@query(answers_sql(GATHERED_RERANKED))
def answer_reranked(spark, folder):
    """Answers by the default plan."""
    return answering.answer(Corpus(paper_chunks(spark, folder)), asked(spark, folder)).select("query_id", F.md5("answer").alias("answer_md5"))


@query(
    answers_sql(
        GATHERED,
        more=f""",
    eq0 AS (SELECT item_id, {BUCKET} AS b, count(*)::DOUBLE AS n FROM (
      SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM asked) GROUP BY 1, 2),
    eq AS (SELECT item_id, b, (n / sqrt(sum(n * n) OVER (PARTITION BY item_id)))::FLOAT::DOUBLE AS x FROM eq0),
    held AS (SELECT * FROM eq WHERE item_id IN (SELECT item_id FROM asked WHERE item_id % 3 = 0 ORDER BY item_id DESC LIMIT 256)),
    near AS (SELECT q.item_id AS qid, h.item_id AS seq, round(sum(q.x * h.x), 6) AS sim FROM eq q JOIN held h USING (b) GROUP BY 1, 2),
    hits AS (SELECT qid, seq FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, seq) AS r FROM near) WHERE r = 1 AND sim >= 0.9)""",
        columns="(h.seq IS NOT NULL) AS cached,",
        joins="LEFT JOIN hits h ON h.qid = item_id",
        answer="CASE WHEN h.seq IS NOT NULL THEN 'Kept answer ' || h.seq || ' [1].' ELSE {told} END",
    )
)
def answer_cached(spark, folder):
    """Every third question is in the cache with its answer; the others reach the model."""
    corpus, questions = Corpus(paper_chunks(spark, folder)), asked(spark, folder)
    kept = questions.where(F.col("query_id") % 3 == 0)
    entries = corpus.encoder.questions(kept).select(
        F.col("query_id").alias("seq"), F.col("text").alias("question"),
        F.concat(F.lit("Kept answer "), "query_id", F.lit(" [1].")).alias("answer"), "embedding",
    )
    answers = answering.answer(corpus, questions, reranked=False, entries=entries)
    return answers.select("query_id", "cached", F.md5("answer").alias("answer_md5"))


# --- citations -------------------------------------------------------------


@query(
    rf"""WITH {ANSWERS}, e AS (SELECT query_id, regexp_extract_all(answer, '\[(\d+)\]', 1) AS n FROM answers)
    SELECT query_id, unnest(n) AS digits, generate_subscripts(n, 1) - 1 AS position,
      TRY_CAST(unnest(n) AS BIGINT) AS number FROM e"""
)
def citation_extract(spark, folder):
    found = marked_answers(spark, folder).select(
        "query_id",
        F.arrays_zip(
            F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1).alias("digits"),
            citations.markers(F.col("answer")).alias("number"),
        ).alias("_m"),
    )
    return found.select("query_id", F.posexplode("_m").alias("position", "_e")).select(
        "query_id", F.col("position").cast("long").alias("position"), "_e.digits", "_e.number"
    )


@query(
    f"""WITH {ANSWERS} SELECT query_id, refused, sentences, uncited,
    len(cited)::BIGINT AS citations, array_to_string(cited, ',') AS cited,
    coalesce((SELECT string_agg(paper_id || '/' || role || '/' || turn, ' ' ORDER BY number) FROM passages p
      WHERE p.conv_id = chk.conv_id AND list_contains(chk.cited, p.number)), '') AS places,
    array_to_string(invalid, ',') AS invalid FROM chk"""
)
def citation_check(spark, folder):
    text = "transform(citations, c -> concat(c.paper_id, '/', c.section, '/', c.paragraph))"
    return checked_answers(spark, folder).select(
        "query_id",
        "refused",
        "sentences",
        "uncited",
        F.size("citations").cast("long").alias("citations"),
        F.expr("array_join(transform(citations, c -> string(c.number)), ',')").alias("cited"),
        F.expr(f"array_join({text}, ' ')").alias("places"),
        F.array_join("invalid", ",").alias("invalid"),
    )


@query(f"WITH {ANSWERS} SELECT query_id, round(grounded, 6) AS grounded FROM chk")
def grounded_share(spark, folder):
    return checked_answers(spark, folder).select("query_id", F.round("grounded", 6).alias("grounded"))


@query(
    f"""WITH {ANSWERS} SELECT count(*) AS answers, sum((len(invalid) > 0)::BIGINT)::BIGINT AS fabricated,
    sum(len(invalid))::BIGINT AS invalid_citations, round(avg(len(cited)), 6) AS mean_citations,
    round(avg(grounded), 6) AS grounded, sum(refused::BIGINT)::BIGINT AS declined,
    sum((NOT refused)::BIGINT)::BIGINT AS answered FROM chk"""
)
def grounding_report(spark, folder):
    return report(
        checked_answers(spark, folder).select(
            F.size("invalid").cast("long").alias("invalid"),
            F.size("citations").cast("long").alias("citations"),
            "grounded",
            "refused",
        )
    )


def timed_answers(spark, folder):
    """Checked answers as the reports take them. A quarter of the questions is not covered by the corpus; the times a
    caller would have measured are derived from the answers."""
    size = F.length("answer")
    return checked_answers(spark, folder).select(
        (F.col("query_id") % 4 != 0).alias("covered"),
        F.size("invalid").cast("long").alias("invalid"),
        F.size("citations").cast("long").alias("citations"),
        "grounded",
        "refused",
        (size % 97).alias("retrieval_ms"),
        (size % 911 + 100).alias("first_token_ms"),
        (size + 1000).alias("total_ms"),
    )


@query(
    f"""WITH {ANSWERS} SELECT query_id % 4 <> 0 AS covered, count(*) AS answers, sum((len(invalid) > 0)::BIGINT)::BIGINT AS fabricated,
    sum(len(invalid))::BIGINT AS invalid_citations, round(avg(len(cited)), 6) AS mean_citations,
    round(avg(grounded), 6) AS grounded, sum(refused::BIGINT)::BIGINT AS declined,
    sum((NOT refused)::BIGINT)::BIGINT AS answered FROM chk GROUP BY ALL"""
)
def grounding_report_full(spark, folder):
    """The figures of covered and uncovered questions."""
    return covered_report(timed_answers(spark, folder))


@query(
    f"""WITH {ANSWERS},
    s AS (SELECT length(answer) AS n FROM answers WHERE query_id % 4 <> 0),
    t AS (
      SELECT 'retrieval_ms' AS stage, (n % 97)::DOUBLE AS ms FROM s
      UNION ALL SELECT 'first_token_ms', n % 911 + 100 FROM s UNION ALL SELECT 'total_ms', n + 1000 FROM s
    )
    SELECT stage, median(ms) AS p50, list_sort(list(ms))[least(floor(count(*) * 0.95)::BIGINT, count(*) - 1) + 1] AS p95 FROM t GROUP BY stage"""
)
def latency_report_covered(spark, folder):
    """Middle and 95th percentile of each stage's time over the covered questions."""
    covered = timed_answers(spark, folder).where("covered")
    return latency_report(covered, ["retrieval_ms", "first_token_ms", "total_ms"])


@query(
    rf"""WITH {ANSWERS},
    cut AS (SELECT a.query_id, list_filter(string_split(regexp_replace(answer, '(\[\d+\])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p, cited
      FROM answers a JOIN chk USING (query_id)),
    pieces AS (SELECT query_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS position, cited FROM cut)
    SELECT query_id, position,
      CASE WHEN NOT regexp_matches(piece, '^\[\d+\]$') THEN 'text'
           WHEN list_contains(cited, TRY_CAST(regexp_extract(piece, '\d+') AS BIGINT)) THEN 'valid' ELSE 'invalid' END AS kind,
      CASE WHEN regexp_matches(piece, '^\[\d+\]$') THEN regexp_extract(piece, '\d+') ELSE piece END AS content
    FROM pieces"""
)
def marker_spans(spark, folder):
    known = checked_answers(spark, folder).select(
        "query_id", citations.spans(F.col("answer"), F.expr("transform(citations, c -> c.number)")).alias("_s")
    )
    return known.select("query_id", F.posexplode("_s").alias("position", "_e")).select(
        "query_id", F.col("position").cast("long").alias("position"), "_e.kind", "_e.content"
    )


@query(
    """SELECT conv_id, turn, regexp_replace('conv' || conv_id || 'v' || turn, 'v[0-9]+$', '') AS paper FROM conversations"""
)
def version_strip(spark, folder):
    paper = F.concat(F.lit("conv"), "conv_id", F.lit("v"), "turn")
    return talk(spark, folder).select("conv_id", "turn", citations.without_version(paper).alias("paper"))


# --- events ----------------------------------------------------------------


EVENTS = rf"""
{ANSWERS},
fr AS (
  SELECT query_id, CASE WHEN query_id % 3 = 0 THEN [answer] ELSE regexp_extract_all(answer, '(\S+\s*|^\s+)', 1) END AS f FROM answers
),
tok AS (SELECT query_id, unnest(f) AS data, generate_subscripts(f, 1) AS seq FROM fr),
shown AS (
  SELECT p.conv_id, to_json(list({{'number': number, 'paper_id': paper_id, 'section': p.role, 'paragraph': p.turn, 'text': c.text}} ORDER BY number))::VARCHAR AS data
  FROM passages p JOIN conversations c ON c.conv_id = p.conv_id AND c.turn = p.turn GROUP BY p.conv_id
),
cites AS (
  SELECT query_id, list({{'number': number, 'paper_id': paper_id, 'section': role, 'paragraph': turn}} ORDER BY number) AS c
  FROM chk JOIN passages p ON p.conv_id = chk.conv_id AND list_contains(chk.cited, p.number) GROUP BY query_id
),
sent AS (
  SELECT query_id, seq, 'token' AS event, to_json(data)::VARCHAR AS data FROM tok
  UNION ALL SELECT chk.query_id, 0, 'passages', shown.data FROM chk LEFT JOIN shown USING (conv_id)
  UNION ALL SELECT chk.query_id, len(f) + 1, 'citations', '{{"citations":' || coalesce(to_json(c)::VARCHAR, '[]')
    || ',"invalid":[' || array_to_string(invalid, ',') || '],"grounded":' || grounded || ',"refused":' || refused
    || ',"cached":' || (chk.query_id % 3 = 0) || '}}'
  FROM chk JOIN fr USING (query_id) LEFT JOIN cites USING (query_id)
)
"""


def sent_events(spark, folder):
    """Events of every answer; a third of them are replayed as cached."""
    return events.event_rows(checked_answers(spark, folder).withColumn("cached", F.col("query_id") % 3 == 0))


@query(f"WITH {EVENTS} SELECT query_id, seq, event, data FROM sent")
def event_rows(spark, folder):
    """All events with their whole payload."""
    return sent_events(spark, folder)


@query(
    f"""WITH {EVENTS} SELECT query_id, seq, md5('event: ' || event || chr(13) || chr(10) || 'data: ' || data
      || chr(13) || chr(10) || chr(13) || chr(10)) AS wire_md5 FROM sent"""
)
def event_wire(spark, folder):
    """The text that goes over the wire, event by event."""
    return events.wire(sent_events(spark, folder)).select("query_id", "seq", F.md5("wire").alias("wire_md5"))


@query(
    r"""WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations),
    done AS (SELECT conv_id, turn, l[1:len(l) - 1] AS whole, l[len(l)] AS tail FROM l),
    e AS (SELECT conv_id, turn, unnest(whole) AS line, generate_subscripts(whole, 1) AS position FROM done)
    SELECT conv_id, turn, position - 1 AS position, CASE WHEN position % 3 = 0 THEN 'message' ELSE 'token' END AS event,
      trim(line, ' ') || CASE WHEN position % 2 = 0 THEN chr(10) || 'more' ELSE '' END AS data
    FROM e
    UNION ALL SELECT conv_id, turn, -1, 'rest', 'event: token' || chr(10) || 'data: ' || tail FROM done"""
)
def sse_split(spark, folder):
    """Each turn sent as a stream with one event per line, the last one cut off,
    keep-alive comments between, and read back."""
    lines = F.split(F.col("text"), "\n")
    sent = F.array_join(
        F.transform(
            F.slice(lines, F.lit(1), F.size(lines) - 1),
            lambda line, i: F.concat(
                F.when((i + 1) % 3 == 0, F.lit("")).otherwise(F.lit("event: token\r\n")),
                F.lit("data: "),
                line,
                F.when((i + 1) % 2 == 0, F.lit("\r\ndata: more")).otherwise(F.lit("")),
                F.lit("\r\n\r\n: keep-alive\n\n"),
            ),
        ),
        "",
    )
    buffer = F.concat(sent, F.lit("event: token\ndata: "), F.element_at(lines, -1))
    read = talk(spark, folder).select("conv_id", "turn", events.split_events(buffer).alias("r"))
    whole = read.select("conv_id", "turn", F.posexplode("r.events").alias("position", "e")).select(
        "conv_id", "turn", F.col("position").cast("long").alias("position"), "e.event", "e.data"
    )
    rest = read.select(
        "conv_id", "turn", F.lit(-1).cast("long").alias("position"), F.lit("rest").alias("event"), F.col("r.rest").alias("data")
    )
    return whole.unionByName(rest)


# --- cache -----------------------------------------------------------------

LOOKUP = """
held AS (SELECT vec_id AS seq, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id DESC LIMIT 256),
sims AS (
  SELECT e.vec_id AS query_id, h.seq, round(list_dot_product(e.embedding::DOUBLE[], h.v), 6) + 0.0 AS similarity
  FROM embeddings e CROSS JOIN held h
),
best AS (
  SELECT query_id, seq, similarity, similarity >= 0.9 AS hit
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, seq) AS r FROM sims) WHERE r = 1
)
"""


def lookups(spark, folder):
    vectors = vector_table(spark, folder)
    entries = cache.surviving(vectors.withColumnRenamed("chunk_id", "seq"))
    return cache.lookup(vectors.withColumnRenamed("chunk_id", "query_id"), entries)


@query(f"WITH {LOOKUP} SELECT query_id, seq, similarity, hit FROM best")
def cache_lookup(spark, folder):
    return lookups(spark, folder)


@query(
    """SELECT user_id, event_id AS seq FROM (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events)
    WHERE age <= 50"""
)
def cache_fifo(spark, folder):
    """One bounded cache per user, filled by all of the user's events in order."""
    stored = table(spark, folder, "events").selectExpr("user_id", "event_id as seq")
    return cache.surviving(stored, capacity=50, by=["user_id"])


@query(
    f"""WITH {LOOKUP}, l AS (SELECT label, hit FROM best JOIN embeddings ON vec_id = query_id)
    SELECT label::BIGINT AS label, sum(hit::BIGINT)::BIGINT AS hits, sum((NOT hit)::BIGINT)::BIGINT AS misses,
      round(avg(hit::BIGINT), 6) AS hit_rate FROM l GROUP BY label"""
)
def hit_rate(spark, folder):
    labels = table(spark, folder, "embeddings").selectExpr("vec_id as query_id", "cast(label as bigint) as label")
    rates = cache.hit_rate(lookups(spark, folder).join(labels, "query_id"), ["label"])
    return rates.withColumn("hit_rate", F.round("hit_rate", 6))


@query(f"WITH {LOOKUP} SELECT (SELECT count(*) FROM held) AS entries, round(avg(hit::BIGINT), 3) AS hit_rate FROM best")
def health(spark, folder):
    entries = cache.surviving(vector_table(spark, folder).withColumnRenamed("chunk_id", "seq"))
    return cache.health(entries, lookups(spark, folder))
