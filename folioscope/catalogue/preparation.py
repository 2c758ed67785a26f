"""Markup, paragraphs, sentences and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalogue import query
from folioscope.constants import WHITESPACE
from folioscope.functions.text import answer_sentences, let, pack, passage_sentences
from folioscope.operators import chunks as chunking
from folioscope.operators.paragraphs import line_paragraphs, paragraphs
from folioscope.sources.archives import flatten
from folioscope.sources.markup import html_text, latex_text, page_title
from folioscope.session import table

WS = WHITESPACE


def documents(spark, folder):
    return table(spark, folder, "documents", "doc_id").select("doc_id", "text")


# --- SQL fragments ---------------------------------------------------------

def collapse(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '{WS}+', ' ', 'g'))"


def rendered_pages() -> str:
    text = "html"
    for tag in ("script", "style", "head", "nav", "footer"):
        text = rf"regexp_replace({text}, '(?is)<{tag}\b.*?</{tag}>', '', 'g')"
    for pattern, replacement in [
        (r"(?s)<!--.*?-->", "''"),
        (r"(?is)<h1\b[^>]*>(.*?)</h1>", r"chr(10) || chr(10) || '§ \1' || chr(10) || chr(10)"),
        (r"(?i)</?(?:p|div|article|li|ul|ol|table|tr)\b[^>]*>", "chr(10) || chr(10)"),
        (r"(?i)<br\s*/?>", "chr(10)"),
        (r"<[^>]+>", "''"),
    ]:
        text = f"regexp_replace({text}, '{pattern}', {replacement}, 'g')"
    for name, character in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        text = f"replace({text}, '&{name};', '{character}')"
    return text


TITLED = r"""CASE WHEN upper(raw_section) = raw_section AND lower(raw_section) <> raw_section
  THEN array_to_string(list_transform(range(1, length(raw_section) + 1), lambda i:
    CASE WHEN i > 1 AND regexp_matches(raw_section[i - 1], '\p{L}') THEN lower(raw_section[i]) ELSE upper(raw_section[i]) END), '')
  ELSE raw_section END"""

# Blocks of each page in order, then section carry-forward with windows.
PAGE_BLOCKS = rf"""
rendered AS (SELECT page_id, regexp_replace({rendered_pages()}, '(?m)^[ \t]*(§(?:\.§)*[ \t]+.+)$', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g') AS text FROM pages),
pieces AS (
  SELECT page_id, unnest(parts) AS piece, generate_subscripts(parts, 1) AS pos
  FROM (SELECT page_id, string_split(regexp_replace(text, '\n{WS}*\n', chr(1), 'g'), chr(1)) AS parts FROM rendered)
),
blocks AS (SELECT page_id, pos, {collapse("piece")} AS block FROM pieces),
marked AS (
  SELECT page_id, pos, block, CASE WHEN regexp_matches(block, '^§(\.§)* .') THEN regexp_replace(block, '^§(\.§)* ', '') END AS title
  FROM blocks WHERE length(block) > 0
),
carried AS (
  SELECT page_id, pos, block, title,
    last_value(title IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS raw_section
  FROM marked
),
paras AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS paragraph,
         coalesce({TITLED}, 'Abstract') AS section, block AS text
  FROM carried WHERE title IS NULL AND length(block) >= 200
)
"""

SENTENCES = rf"string_split(regexp_replace(text, '([.!?]){WS}+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))"

LINES = f"""
lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
),
paras AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS paragraph, 'Abstract' AS section, block AS text
  FROM (SELECT doc_id, pos, {collapse("line")} AS block FROM lines) WHERE length(block) > 0
)
"""


def packed(source: str, keys: str, limit: int = 1200) -> str:
    """Greedy packing of `source(keys, text)` with one sentence of overlap: one
    recursive step per sentence, then one per word for pieces above the limit."""
    on = " AND ".join(f"p.{k} = s.{k}" for k in keys.split(", "))
    on_words = " AND ".join(f"p.{k} = w.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""
sent AS (
  SELECT {keys}, list_filter({SENTENCES}, lambda x: length({collapse("x")}) > 0) AS s
  FROM {source} WHERE length(text) > {limit}
),
walk AS (
  SELECT {keys}, 0 AS i, []::VARCHAR[] AS cur, NULL::VARCHAR AS piece, 0 AS no FROM sent
  UNION ALL
  SELECT {pk}, p.i + 1,
    CASE WHEN p.i >= len(s.s) THEN NULL
         WHEN len(p.cur) > 0 AND length(array_to_string(list_append(p.cur, s.s[p.i + 1]), ' ')) > {limit}
         THEN [p.cur[-1], s.s[p.i + 1]] ELSE list_append(p.cur, s.s[p.i + 1]) END,
    CASE WHEN p.i >= len(s.s) THEN array_to_string(p.cur, ' ')
         WHEN len(p.cur) > 0 AND length(array_to_string(list_append(p.cur, s.s[p.i + 1]), ' ')) > {limit}
         THEN array_to_string(p.cur, ' ') END,
    p.i
  FROM walk p JOIN sent s ON {on}
  WHERE p.i <= len(s.s) AND p.cur IS NOT NULL
),
groups AS (SELECT {keys}, no, piece FROM walk WHERE piece IS NOT NULL AND len(piece) > 0),
words AS (
  SELECT {keys}, no, list_filter(string_split({collapse("piece")}, ' '), lambda x: length(x) > 0) AS w
  FROM groups WHERE length(piece) > {limit}
),
wwalk AS (
  SELECT {keys}, no, 0 AS i, '' AS cur, NULL::VARCHAR AS piece FROM words
  UNION ALL
  SELECT {pk}, p.no, p.i + 1,
    CASE WHEN p.i >= len(w.w) THEN NULL
         WHEN p.cur = '' THEN w.w[p.i + 1]
         WHEN length(p.cur) + 1 + length(w.w[p.i + 1]) > {limit} THEN w.w[p.i + 1]
         ELSE p.cur || ' ' || w.w[p.i + 1] END,
    CASE WHEN p.i >= len(w.w) THEN p.cur
         WHEN p.cur <> '' AND length(p.cur) + 1 + length(w.w[p.i + 1]) > {limit} THEN p.cur END
  FROM wwalk p JOIN words w ON {on_words} AND p.no = w.no
  WHERE p.i <= len(w.w) AND p.cur IS NOT NULL
),
allpieces AS (
  SELECT {keys}, 0 AS no, 0 AS sub, text AS piece FROM {source} WHERE length(text) <= {limit}
  UNION ALL SELECT {keys}, no, 0, piece FROM groups WHERE length(piece) <= {limit}
  UNION ALL SELECT {keys}, no, i, piece FROM wwalk WHERE piece IS NOT NULL AND piece <> ''
),
chunks AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY no, sub) - 1 AS chunk_index, piece AS text FROM allpieces
)
"""


# --- queries ---------------------------------------------------------------


@query(
    rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(
      regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'),
      '{WS}+', ' ', 'g')) AS title FROM pages"""
)
def page_title_extract(spark, folder):
    return table(spark, folder, "pages", "page_id").select("page_id", page_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, md5(text) AS text_md5, length(text) AS chars FROM (SELECT page_id, {rendered_pages()} AS text FROM pages)")
def render_pages(spark, folder):
    text = table(spark, folder, "pages", "page_id").select("page_id", html_text(F.col("html")).alias("text"))
    return text.select("page_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars"))


def _page_paragraphs(spark, folder):
    text = table(spark, folder, "pages", "page_id").select("page_id", html_text(F.col("html")).alias("text"))
    return paragraphs(text, "page_id")


@query(f"WITH {PAGE_BLOCKS} SELECT page_id, paragraph, section, md5(text) AS text_md5 FROM paras")
def sections_carry(spark, folder):
    return _page_paragraphs(spark, folder).withColumn("text_md5", F.md5("text")).drop("text")


@query(
    rf"""WITH {LINES},
    body AS (SELECT doc_id, source, string_agg(p.text, chr(10) || chr(10) ORDER BY paragraph) AS text
             FROM paras p JOIN documents USING (doc_id) GROUP BY doc_id, source)
    SELECT p.doc_id, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.paragraph) - 1 AS paragraph,
           'Src' || substr(source, 4) AS section, md5(p.text) AS text_md5
    FROM paras p JOIN documents d ON d.doc_id = p.doc_id WHERE length(p.text) >= 200"""
)
def latex_paragraphs(spark, folder):
    """Documents written out as LaTeX (a shouted section title, a paragraph macro
    between lines, an appendix after the references) and read back."""
    special = F.regexp_replace(F.col("text"), r"([%&#_$])", r"\\$1")
    body = F.regexp_replace(special, "\n", F.lit("\\\\par "))
    latex = let(
        body,
        lambda text: F.concat(
            F.lit("\\documentclass{article}\n\\newtheorem{lemma}{Lemma}\n\\begin{document}\n% a comment line\n\\section{"),
            F.upper("source"),
            F.lit("}\n"),
            text,
            F.lit("\n\\section*{References}\n"),
            text,
            F.lit("\n\\section{Appendix}\n"),
            text,
            F.lit("\n\\end{document}\nafter the end"),
        ),
    )
    written = table(spark, folder, "documents", "doc_id").select("doc_id", latex.alias("latex"))
    read = written.select("doc_id", latex_text(F.col("latex")).alias("text"))
    return paragraphs(read, "doc_id").withColumn("text_md5", F.md5("text")).drop("text")


MACRO_WORDS = "regexp_extract_all(text, '[A-Za-z]+')"


@query(
    f"""WITH w AS (SELECT doc_id, {MACRO_WORDS} AS w FROM documents)
    SELECT doc_id, 'On ' || w[1] || ' ' || w[2] || '_3 codes' AS section,
      md5('We study ' || w[3] || ' over ' || w[4] || ' and ' || w[5] || ' over the field. Here ' || w[6] || '_1/' || w[7] || ' and α'
        || w[8] || ' <cit.>. ' || w[9] || ' ' || w[10] || repeat(' end of the table', 12)) AS text_md5
    FROM w WHERE len(w) >= 10"""
)
def latex_macros(spark, folder):
    """The first words of each document in nested groups, macros with arguments, fractions and a table, read back."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1).alias("w")
    rows = table(spark, folder, "documents", "doc_id").select("doc_id", words).where("size(w) >= 10")
    w = [F.get("w", F.lit(i)) for i in range(10)]
    pieces = [
        "\\documentclass{article}\n\\newcommand{\\code}[2][the field]{#2 over #1}\n\\def\\both#1#2{#1 and \\code{#2}}\n",
        "\\begin{document}\n\\section{On \\textbf{", w[0], " $\\mathbb{", w[1], "}_{3}$} codes}\nWe study \\both{\\code[{\\it ", w[3], "}]{",
        w[2], "}}{\\emph{\\textbf{", w[4], "}}}. % {a comment\nHere $\\frac{", w[5], "_{1}}{", w[6], "}$ and {\\large $\\alpha", "{", w[7],
        "}$} \\cite{key}. \\begin{tabular}{ll}", w[8], " & ", w[9], "\\end{tabular}", " end of the table" * 12, "\n\\end{document}\n",
    ]
    latex = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    read = rows.select("doc_id", latex_text(latex).alias("text"))
    return paragraphs(read, "doc_id").select("doc_id", "section", F.md5("text").alias("text_md5"))


@query(
    f"""WITH {LINES}, numbered AS (SELECT doc_id, paragraph, text, max(paragraph) OVER (PARTITION BY doc_id) AS last FROM paras),
    cut AS (SELECT doc_id, min(paragraph) AS stop FROM numbered WHERE paragraph * 2 > last GROUP BY doc_id)
    SELECT n.doc_id, count(*) FILTER (WHERE n.paragraph < coalesce(c.stop, n.last + 1) AND length(text) >= 200)::BIGINT AS kept
    FROM numbered n LEFT JOIN cut c ON c.doc_id = n.doc_id GROUP BY n.doc_id
    HAVING count(*) FILTER (WHERE n.paragraph < coalesce(c.stop, n.last + 1) AND length(text) >= 200) > 0"""
)
def stop_section_cut(spark, folder):
    """A closing section set in the middle of each document ends it there."""
    lines = line_paragraphs(documents(spark, folder), "doc_id")
    last = lines.groupBy("doc_id").agg(F.max("paragraph").alias("last"))
    marked = lines.join(last, "doc_id").withColumn(
        "block",
        F.when(F.col("paragraph") * 2 > F.col("last"), F.concat(F.lit("§ ACKNOWLEDGMENTS\n"), F.col("text"))).otherwise(
            F.col("text")
        ),
    )
    whole = marked.groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "block"))), lambda e: e["block"]), "\n\n"
        ).alias("text")
    )
    return paragraphs(whole, "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"WITH {LINES} SELECT doc_id, paragraph, section, md5(text) AS text_md5, length(text) AS chars FROM paras")
def line_blocks(spark, folder):
    found = line_paragraphs(documents(spark, folder), "doc_id")
    return found.select(
        "doc_id", "paragraph", "section", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("chars")
    )


@query(
    f"""WITH s AS (SELECT doc_id, list_filter({SENTENCES}, lambda x: length({collapse("x")}) > 0) AS s FROM documents)
    SELECT doc_id, len(s)::BIGINT AS sentences, md5(array_to_string(s, chr(1))) AS sentences_md5 FROM s"""
)
def sentence_split(spark, folder):
    split = documents(spark, folder).select("doc_id", passage_sentences(F.col("text")).alias("s"))
    return split.select(
        "doc_id",
        F.size("s").cast("long").alias("sentences"),
        F.md5(F.array_join("s", "\u0001")).alias("sentences_md5"),
    )


@query(
    rf"""WITH s AS (
      SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), '([.!?]){WS}+', '\1' || chr(1), 'g'), chr(1)),
        lambda x: length({collapse("x")}) > 0) AS s FROM documents)
    SELECT doc_id, len(s)::BIGINT AS sentences, md5(array_to_string(s, chr(1))) AS sentences_md5 FROM s"""
)
def answer_sentence_split(spark, folder):
    split = documents(spark, folder).select("doc_id", answer_sentences(F.col("text")).alias("s"))
    return split.select(
        "doc_id",
        F.size("s").cast("long").alias("sentences"),
        F.md5(F.array_join("s", "\u0001")).alias("sentences_md5"),
    )


@query(
    f"""WITH RECURSIVE {packed("documents", "doc_id")}
    SELECT doc_id, chunk_index, length(text) AS chars, md5(text) AS text_md5 FROM chunks"""
)
def chunk_split(spark, folder):
    pieces = documents(spark, folder).select("doc_id", pack(F.col("text")).alias("_p"))
    return (
        pieces.select("doc_id", F.posexplode_outer("_p").alias("chunk_index", "text"))
        .where("text is not null")
        .select(
            "doc_id",
            F.col("chunk_index").cast("long"),
            F.length("text").cast("long").alias("chars"),
            F.md5("text").alias("text_md5"),
        )
    )


@query(
    f"""WITH RECURSIVE {PAGE_BLOCKS}, {packed("paras", "page_id, paragraph", 300)}
    SELECT c.page_id, c.paragraph, c.chunk_index, p.section, md5(c.text) AS text_md5
    FROM chunks c JOIN paras p ON p.page_id = c.page_id AND p.paragraph = c.paragraph"""
)
def page_chunks(spark, folder):
    """Pages to paragraphs to chunks, at a limit that cuts most paragraphs."""
    found = chunking.chunk(_page_paragraphs(spark, folder), "page_id", limit=300)
    return found.withColumn("text_md5", F.md5("text")).drop("text")


@query(
    f"""WITH RECURSIVE {LINES}, {packed("paras", "doc_id, paragraph")}
    SELECT count(*)::BIGINT AS locations, coalesce(sum((n > 1)::BIGINT), 0)::BIGINT AS duplicated FROM (
      SELECT doc_id, paragraph, chunk_index, count(*) AS n FROM chunks GROUP BY ALL)"""
)
def chunk_provenance_unique(spark, folder):
    found = chunking.chunk(line_paragraphs(documents(spark, folder), "doc_id"), "doc_id")
    counted = found.groupBy("doc_id", "paragraph", "chunk_index").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.count(F.lit(1)).alias("locations"),
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0).cast("long")).alias("duplicated"),
    )


@query(
    f"""WITH RECURSIVE {PAGE_BLOCKS}, {packed("paras", "page_id, paragraph")}
    SELECT count(DISTINCT page_id) AS papers, count(*) AS chunks,
           (SELECT count(DISTINCT section) FROM paras) AS sections,
           round(count(*)::DOUBLE / count(DISTINCT page_id), 6) AS chunks_per_paper,
           round(avg(length(text)), 6) AS mean_chars FROM chunks"""
)
def corpus_summary(spark, folder):
    return chunking.corpus_summary(chunking.chunk(_page_paragraphs(spark, folder), "page_id"), "page_id")


@query(
    r"""SELECT doc_id, md5('\begin{document}' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x: x || chr(10)), '')
       || '\end{document}') AS latex_md5 FROM documents"""
)
def flatten_includes(spark, folder):
    """Each document cut into one file per line, included by a main file that a
    decoy in a subfolder resembles, and put together again."""
    lines = F.split(F.col("text"), "\n")
    parts = F.transform(
        lines, lambda line, i: F.struct(F.concat(F.lit("parts/p"), i.cast("string")).alias("name"), line.alias("text"))
    )
    calls = F.array_join(
        F.transform(
            lines,
            lambda line, i: F.concat(
                F.when(i % 2 == 0, F.lit("\\input{")).otherwise(F.lit("\\include { ")),
                F.lit("parts/p"),
                i.cast("string"),
                F.when(i % 3 == 0, F.lit(".tex}\n")).otherwise(F.lit("}\n")),
            ),
        ),
        "",
    )
    main = F.concat(F.lit("\\begin{document}\n"), calls, F.lit("\\end{document}"))
    decoy = F.struct(F.lit("old/draft").alias("name"), F.lit("\\begin{document}draft\\end{document}").alias("text"))
    opened = F.struct(F.lit("paper").alias("name"), main.alias("text"))
    members = documents(spark, folder).select("doc_id", F.concat(parts, F.array(decoy, opened)).alias("members"))
    return members.select("doc_id", F.md5(flatten(F.col("members"))).alias("latex_md5"))
