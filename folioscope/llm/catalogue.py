"""The queries of this subpackage, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import bpe, chat, decontamination, infill, jaccard, lines, ngrams, packing, passages, quality, turns, urls, vectors
from folioscope.llm.common import LOWER, UPPER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return ngrams.score(read(spark, folder, "documents"), held_out, order=3)


@query()
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.duplicates(read(spark, folder, "documents"), percent=80)


WORD = r"[^\x20\x09-\x0D]+"
STEP = (1 + quality.ACCURACY) / (1 - quality.ACCURACY)


def _quality_sql() -> str:
    """Counts, sketches and cutoffs; the same constants, another engine."""
    metrics = list(quality.METRICS)
    bucket = f"CASE WHEN v <= 0 THEN {-(1 << 30)} ELSE CAST(ceil(round(ln(v) / ln({STEP!r}::DOUBLE), 9)) AS INT) END"
    value = f"CASE WHEN b = {-(1 << 30)} THEN 0.0 ELSE round(pow({STEP!r}::DOUBLE, b::DOUBLE) * {2 / (1 + STEP)!r}::DOUBLE, 9) END"

    def quantiles(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        pick = ", ".join(
            f"min(CASE WHEN upto >= ceil(n_all * {share!r}::DOUBLE) THEN b END) AS {label}"
            for label, share in (("lo", 1 - quality.OUTER), ("mid", quality.MIDDLE), ("hi", quality.OUTER))
        )
        cuts = []
        for metric in metrics:
            cuts.append(f"max(CASE WHEN metric = '{metric}' THEN h * (h / m) * (h / m) * (h / m) * (h / m) END) AS {metric}_max")
            if metric == "word_length":
                cuts.append(f"max(CASE WHEN metric = '{metric}' THEN l * (l / m) * (l / m) * (l / m) * (l / m) END) AS {metric}_min")
        read = ", ".join(f"({value.replace('b =', f'{x} =').replace(', b::', f', {x}::')}) AS {y}" for x, y in (("lo", "l"), ("mid", "m"), ("hi", "h")))
        return f"""
        {name}_b AS (SELECT {by}metric, b, sum(n) AS n FROM sk GROUP BY ALL),
        {name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {by}metric) AS n_all FROM {name}_b),
        {name}_q AS (SELECT {by}metric, max(n_all) AS n_all, {pick} FROM {name}_c GROUP BY {by}metric),
        {name} AS (SELECT {by}max(n_all) AS n_all, {", ".join(cuts)} FROM (SELECT *, {read} FROM {name}_q) {f"GROUP BY {keys}" if keys else ""})"""

    enough = quality.ENOUGH
    level = f"CASE WHEN coalesce(g.n_all, 0) >= {enough} THEN 0 WHEN coalesce(y.n_all, 0) >= {enough} THEN 1 ELSE 2 END"
    names = [f"{m}_max" for m in metrics] + ["word_length_min"]
    chosen = ", ".join(f"CASE {level} WHEN 0 THEN g.{c} WHEN 1 THEN y.{c} ELSE e.{c} END AS {c}" for c in names)
    outside = """
        (greatest(n_symbols - 3 * sqrt(n_symbols + 1), 0) + 1) / (word_chars + 1) > symbol_share_max
        OR (greatest(n_dup_lines - 3 * sqrt(n_dup_lines + 1), 0) + 1) / (n_lines + 1) > dup_line_share_max
        OR (greatest(n_repeat_words - 3 * sqrt(6 * (n_repeat_words + 6)), 0) + 1) / (n_words + 1) > repeat_share_max
        OR (greatest(word_chars - 3 * sqrt(word_chars + 1), 0) + 1) / (n_words + 1) > word_length_max
        OR (word_chars + 3 * sqrt(word_chars + 1) + 1) / (n_words + 1) < word_length_min"""
    return f"""
    WITH w AS (
      SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents
    ),
    win AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 2], ' ') AS g FROM (
      SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS pos FROM w)),
    often AS (SELECT doc_id, g FROM win GROUP BY 1, 2 HAVING count(*) > 1),
    rep AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM win JOIN often USING (doc_id, g), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
    c AS (
      SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
      FROM w LEFT JOIN rep USING (doc_id)
    ),
    m AS (
      SELECT *, (n_symbols + 1) / (word_chars + 1) AS symbol_share, (n_dup_lines + 1) / (n_lines + 1) AS dup_line_share,
        (n_repeat_words + 1) / (n_words + 1) AS repeat_share, (word_chars + 1) / (n_words + 1) AS word_length,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
    ),
    each AS ({" UNION ALL ".join(f"SELECT lang, source, '{x}' AS metric, {x} AS v FROM m WHERE NOT base_failed" for x in metrics)}),
    sk AS (SELECT lang, source, metric, {bucket} AS b, count(*) AS n FROM each GROUP BY ALL),
    {quantiles("g", "lang, source")}, {quantiles("y", "lang")}, {quantiles("e", "")},
    j AS (
      SELECT m.*, {level} AS cutoff_level, {chosen} FROM m
      LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
      LEFT JOIN y ON m.lang IS NOT DISTINCT FROM y.lang LEFT JOIN e ON true
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND NOT coalesce({outside}, false) AS kept, {", ".join(metrics)}, cutoff_level::BIGINT AS cutoff_level FROM j"""


@query(_quality_sql())
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(read(spark, folder, "documents"))
    words = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *words, "base_failed", "kept", *quality.METRICS, F.col("cutoff_level").cast("long").alias("cutoff_level"))


def tokenizer() -> str:
    """The public byte-level tokenizer of the contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), tokenizer(), capacity=2048, end_id=0)


@query(
    rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
    reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
    least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id
    FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
    """
)
def op5_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.linked(read(spark, folder, "documents"), width=4, percent=85)


@query()
def op6_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(read(spark, folder, "documents"), tokenizer())


@query()
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated(read(spark, folder, "documents"), least_words=50, percent=80)


@query(
    """
    WITH rows AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), marked AS (
        SELECT *, length(text) + length(text) - length(replace(text, chr(92), ''))
            + (length(text) - length(replace(text, '<s>', ''))) // 3
            + (length(text) - length(replace(text, '</s>', ''))) // 4
            + (length(text) - length(replace(text, '[INST]', ''))) // 6
            + (length(text) - length(replace(text, '[/INST]', ''))) // 7
            + (length(text) - length(replace(text, '<|endoftext|>', ''))) // 13 + length(role) AS chars
        FROM rows
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(chars + 17) + 3 AS BIGINT) AS formatted_chars
    FROM marked GROUP BY conv_id
    """
)
def op8_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role")
    rows = rows.unionByName(extra.withColumn("text", F.lit(planted)))
    return chat.read_back(chat.format_turns(rows, tokenizer()), tokenizer())


@query(
    """
    WITH RECURSIVE valid AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b
        ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
    ), reach AS (
        SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
    ), least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
    counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(other, e.vec_id)) AS component_id,
        e.vec_id = least(e.vec_id, coalesce(other, e.vec_id)) AS kept
    FROM embeddings e LEFT JOIN counted USING (vec_id) LEFT JOIN least USING (vec_id)
    """
)
def op9_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = read(spark, folder, "embeddings")
    return vectors.near_duplicates(rows, "vec_id", "embedding", threshold=0.95)


URL_RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


@query()
def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge(read(spark, folder, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.col("block_probability"))


@query(
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
    h AS (SELECT doc_id, t, length(t) AS n, list_transform(range(0, 4), lambda i: ('0x' || substr(x, 8 * i + 1, 8))::BIGINT) AS h FROM d),
    c AS (
        SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
    ), p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
            ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM p
    """
)
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return infill.digests(read(spark, folder, "documents"))


@query(
    rf"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), q AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1),
            lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) > 0
    ), sizes AS (SELECT DISTINCT size FROM q),
    p AS (
        SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS pos, w FROM d, sizes WHERE len(w) >= size
    ), o AS (
        SELECT p.doc_id, p.pos, p.size, q.item_id FROM (SELECT doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS g FROM p) p JOIN q USING (size, g)
    ), hit AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM (SELECT doc_id, pos, unnest(range(0, size)) AS k FROM o) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (
        SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items,
        sha256(coalesce(it.ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
    """
)
def op12_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.digests(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query(
    """
    WITH t AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL
    ), n AS (SELECT c, max(p) AS n FROM t GROUP BY c),
    steps AS (SELECT c, [4294967295] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1])) AS s FROM n),
    crc AS (
        SELECT c, xor(list_reduce(s, lambda acc, x: xor(xor(acc, greatest(x, 0)) >> 1, (xor(acc, greatest(x, 0)) & 1) * 3988292384)), 4294967295) % 9 AS h FROM steps
    ), plan AS (
        SELECT n.c, n.n, n.c - n.c % 5 AS s, h, least(h, coalesce(m.n, 0)) AS k FROM n JOIN crc USING (c) LEFT JOIN n m ON m.c = n.c - n.c % 5
    ), r AS (
        SELECT plan.c, t.p AS d, role, text FROM plan JOIN t ON t.c = plan.s AND t.p <= plan.k
        UNION ALL SELECT c, k + p - h, role, text FROM plan JOIN t USING (c) WHERE p > h
        UNION ALL SELECT c, 0, '', '' FROM plan
    ), paths AS (
        SELECT c, d, strlen(text) AS bytes, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (
            PARTITION BY c ORDER BY d)) AS key, max(d) OVER (PARTITION BY c) AS l FROM r
    ), before AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS up FROM paths),
    nodes AS (
        SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, max(up) AS up,
            sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = l), '')) AS ends_sha256 FROM before GROUP BY key, d
    ), kids AS (SELECT up AS key, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
    full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (key, d)),
    owned AS (
        SELECT b.c, b.d, b.key, sum(CASE WHEN f.conv_id = b.c THEN (f.n_convs - 1) * f.bytes ELSE 0 END) OVER w AS saved,
            sum(CASE WHEN f.conv_id = b.c AND f.n_children = 0 THEN 1 ELSE 0 END) OVER w AS leaves
        FROM before b JOIN full_nodes f USING (key, d)
        WINDOW w AS (PARTITION BY b.c ORDER BY b.d DESC)
    ), totals AS (SELECT key, d, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM owned GROUP BY key, d)
    SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
    FROM full_nodes f JOIN totals USING (key, d) LEFT JOIN full_nodes p ON p.key = f.up AND p.d = f.d - 1
    """
)
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turns.shared_heads(read(spark, folder, "conversations"))
