"""Fuzzy duplicate lines, by column expressions alone.

A line's set holds its character shingles: the eight characters from every place that has as many after it; a shorter
line is one shingle. `HASHES` minima over differently flipped hashes sign the set; `BANDS` choices of `ROWS` minima are
the keys under which similar lines meet. Equal lines are folded before that by a 128-bit hash. Lines that meet are
checked against the first of them; where a key then still spans several components, every line outside its largest
component is checked against all lines of other components, in blocks of `BLOCK` lines on either side. Before a
pair's sets are compared exactly, half of its minima must agree, and their sizes and parity sketches must not differ by more
than sets as similar as asked can; that rule alone loses no pair. Of a line's hashes, few are near enough to a flip to be its minimum, and only those are
compared; lines that lack a minimum so are signed over all their hashes. Distributed union-find makes components, and of
each the line that comes first (by doc_id, then place) is kept.

Chance of meeting, from the binomial spread of agreeing minima: 0.97 at similarity 0.8, over 0.998 from 0.88 on.

Lines are split at line feeds and compared without the white space around them. Blank lines are left alone, and so are
null and empty texts. Rows that repeat a doc_id count as one document; rows with a null doc_id are left alone. An
empty table gives no rows.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import discard, small, stored
from folioscope.llm.graph import components, joined

#: One match per character that a shingle begins with.
WIDTH = 8
SHINGLE = rf"(?s)(?=(.{{{WIDTH}}}|^.{{1,{WIDTH - 1}}}\z))."
HASHES, ROWS, BANDS, SEED = 20, 4, 12, 11
#: Hashes of a line that are looked at for one minimum, on average.
LOW = 16
#: Longs of a parity sketch.
WORDS = 16
BLOCK = 2048
_BITS = (1 << 31) - 1


def _choices() -> tuple[list[int], list[list[int]]]:
    """What flips the hashes, and which minima form each band."""
    chance = random.Random(SEED)
    return [chance.getrandbits(31) for _ in range(HASHES)], [sorted(chance.sample(range(HASHES), ROWS)) for _ in range(BANDS)]


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line and its two hashes, without blank lines."""
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(" \t\n\x0b\f\r"))).where("line <> ''")
    return rows.withColumns({"_a": F.xxhash64("line"), "_b": F.xxhash64(F.lit(3), "line")})


def shingles(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(SHINGLE), F.lit(1))


def hashed(lines: DataFrame, *keys: str) -> DataFrame:
    """The keys, the number of shingles (_n) and each one's xxhash64 (_x), a row for each of `shingles(line)`, repeats
    included.

    Windows are cut from bytes, so that no line is read from its start for each: eight bytes where all is ASCII, else as
    many as eight characters can have, from every byte that begins one.
    """
    size = F.octet_length("line")
    rows = lines.select(
        *keys,
        (size == F.length("line")).alias("_plain"),
        F.col("line").cast("binary").alias("_bytes"),
        F.greatest(F.length("line") - (WIDTH - 1), F.lit(1)).alias("_n"),
        (size - F.octet_length(F.substring("line", -WIDTH, WIDTH)) + 1).alias("_last"),
    )
    rows = rows.select(*keys, "_plain", "_bytes", "_n", F.explode(F.sequence(F.lit(1), "_last")).alias("_at"))
    rows = rows.where("_plain OR substring(_bytes, _at, 1) NOT BETWEEN X'80' AND X'BF'")
    narrow = F.expr(f"CAST(substring(_bytes, _at, {WIDTH}) AS STRING)")
    wide = F.expr(f"substring(CAST(substring(_bytes, _at, {4 * WIDTH}) AS STRING), 1, {WIDTH})")
    return rows.select(*keys, "_n", F.xxhash64(F.when(F.col("_plain"), narrow).otherwise(wide)).alias("_x"))


def _minima(lines: DataFrame, few: bool) -> DataFrame:
    """The minima (_0, _1, ...) of every distinct line. With `few`, hashes flipped to more than `LOW` in `_n` of their range
    are passed over, which seldom leaves a minimum out; one that is left out is null."""
    flips, _ = _choices()
    each = hashed(lines, "_a", "_b").withColumn("_x", F.expr(f"CAST(_x & {_BITS} AS INT)"))
    each = each.withColumn("_most", F.expr(f"CAST(least({_BITS}L, {LOW * (_BITS + 1)}L div _n) AS INT)"))
    only = " FILTER (WHERE (_x ^ {0}) <= _most)" if few else ""
    minima = [F.expr(("min(_x ^ {0})" + only).format(flip)).alias(f"_{i}") for i, flip in enumerate(flips)]
    return each.groupBy("_a", "_b").agg(*minima)


def signed(docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """One row per distinct line: its first place (node), how often it occurs and its minima; and the stored tables that
    it is read from."""
    lines = split_lines(docs)
    places = lines.groupBy("_a", "_b").agg(F.min(F.struct("doc_id", "line_no")).alias("node"), F.count(F.lit(1)).alias("n"))
    names = [f"_{i}" for i in range(HASHES)]
    lacks = reduce(lambda x, y: x | y, map(F.isnull, names))
    found = stored(places.join(_minima(lines, few=True), ["_a", "_b"]).withColumn("_lacks", lacks))
    # Lines that repeat few shingles often can lack a minimum: theirs are taken over all hashes.
    lacking = stored(found.where("_lacks").select("_a", "_b", "node.doc_id"))
    held = docs.join(small(lacking.select("doc_id").distinct()), "doc_id", "left_semi")
    whole = _minima(split_lines(held).join(small(lacking.select("_a", "_b")), ["_a", "_b"], "left_semi"), few=False)
    whole = stored(whole.withColumnsRenamed({name: f"_whole{name}" for name in names}))
    discard(lacking)
    minima = F.array(*[F.coalesce(f"_whole{name}", name) for name in names]).alias("_m")
    return found.join(small(whole, 256), ["_a", "_b"], "left").select("_a", "_b", "node", "n", minima), [found, whole]


def _agree(a: str, b: str) -> Column:
    same = [(F.col(a)[i] == F.col(b)[i]).cast("int") for i in range(HASHES)]
    return reduce(lambda x, y: x + y, same) >= HASHES // 2


def _read(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lines (node, line) that stand at some places, stored."""
    ids = stored(nodes.select("node.doc_id").distinct())
    lines = split_lines(docs.join(small(ids), "doc_id", "left_semi")).withColumn("node", F.struct("doc_id", "line_no"))
    texts = stored(lines.join(small(nodes), "node", "left_semi").dropDuplicates(["node"]).select("node", "line"))
    discard(ids)
    return texts


def sketched(texts: DataFrame) -> DataFrame:
    """The size (_size) and the parity sketch (_bits, `WORDS` longs) of every line's set: each shingle flips one bit."""
    each = texts.select("node", F.explode(F.array_distinct(shingles(F.col("line")))).alias("_s"))
    each = each.select("node", F.xxhash64("_s").alias("_x"))
    bit, word = F.expr("shiftleft(1L, CAST(_x & 63 AS INT))").alias("_x"), F.expr(f"pmod(shiftright(_x, 6), {WORDS})").alias("_w")
    each = each.select("node.doc_id", "node.line_no", bit, word)
    words = [F.coalesce(F.expr(f"bit_xor(_x) FILTER (WHERE _w = {i})"), F.lit(0).cast("long")) for i in range(WORDS)]
    sets = each.groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("_size"), F.array(*words).alias("_bits"))
    return sets.select(F.struct("doc_id", "line_no").alias("node"), "_size", "_bits")


def _near(a: str, b: str, percent: int) -> Column:
    """False only for sets that are less similar than asked: the bits in which two sketches differ are no more than the
    shingles that one set has and the other lacks, nor is the difference of their sizes."""
    x, y = F.col(a), F.col(b)
    most = (100 - percent) * (x["_size"] + y["_size"])
    bits = reduce(lambda p, q: p + q, [F.bit_count(x["_bits"][i].bitwiseXOR(y["_bits"][i])) for i in range(WORDS)])
    return ((100 + percent) * F.abs(x["_size"] - y["_size"]) <= most) & _agree(f"{a}._m", f"{b}._m") & ((100 + percent) * bits <= most)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets, of `_sizes` shingles together, are as similar as asked, stored."""
    # The text is an eighth of its set; the sets are made where they are compared, once per pair.
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("line").alias("_x")), "u")
    both = both.join(texts.select(F.col("node").alias("v"), F.col("line").alias("_y")), "v")
    shared = F.size(F.array_intersect(shingles(F.col("_x")), shingles(F.col("_y"))))
    return stored(both.where((100 + percent) * shared >= percent * F.col("_sizes")).select("u", "v"))


def duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Every line that goes: doc_id, line_no, the place of the line kept for it, and whether the two are equal."""
    _, bands = _choices()
    docs = docs.select("doc_id", "text")
    lines = split_lines(docs)
    distinct, read = signed(docs)
    keys = [F.xxhash64(F.lit(i), *[F.col("_m")[j] for j in band]) for i, band in enumerate(bands)]
    met = distinct.select("node", F.explode(F.array(*keys)).alias("_key"))
    key = Window.partitionBy("_key")
    met = met.withColumns({"_head": F.min("node").over(key), "_last": F.max("node").over(key)})
    met = stored(met.where("_head <> _last").select("_key", "node", "_head"))

    nodes = stored(met.select("node").distinct())
    texts = _read(docs, nodes)
    concerned = distinct.select("node", "_m").join(small(nodes), "node", "left_semi").join(sketched(texts), "node")
    concerned = stored(concerned.select("node", F.struct("_size", "_bits", "_m").alias("_p")))
    stars = met.where("node <> _head").select(F.col("node").alias("u"), F.col("_head").alias("v")).distinct()
    tested = stars.join(concerned.withColumnRenamed("node", "u"), "u")
    tested = tested.join(concerned.select(F.col("node").alias("v"), F.col("_p").alias("_q")), "v").where(_near("_p", "_q", percent))
    sizes = (F.col("_p._size") + F.col("_q._size")).alias("_sizes")
    links = _verified(tested.select("u", "v", sizes), texts, percent)
    so_far = stored(components(links))

    # Keys that still span several components: all pairs of lines of different components.
    rows = met.select("_key", "node").join(so_far, "node", "left").withColumn("_group", F.coalesce("component", "node"))
    counted = rows.groupBy("_key", "_group").agg(F.count(F.lit(1)).alias("_n"))
    mixed = counted.groupBy("_key").agg(
        F.max_by("_group", F.struct("_n", "_group")).alias("_main"), F.max("_n").alias("_most"), F.sum("_n").alias("_all")
    )
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.where("_most < _all").select("_key", "_main", blocks(F.col("_all") - F.col("_most")).alias("_nx"), blocks(F.col("_all")).alias("_ny"))
    waiting = stored(rows.select("_key", "node", "_group").join(mixed, "_key").join(concerned, "node"))
    rows = waiting.withColumn("_minor", F.col("_group") != F.col("_main"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("_minor").select("_key", own("_nx").alias("_i"), every("_ny").alias("_j"), "node", "_group", "_p")
    right = rows.select(
        "_key", every("_nx").alias("_i"), own("_ny").alias("_j"), F.col("node").alias("_node"), F.col("_group").alias("_other"),
        "_minor", F.col("_p").alias("_q"),
    )
    apart = (F.col("_group") != F.col("_other")) & (~F.col("_minor") | (F.col("node") > F.col("_node"))) & _near("_p", "_q", percent)
    pairs = left.withColumnsRenamed({"_key": "_k", "_i": "_x", "_j": "_y"}).join(
        right, F.expr("_k = _key AND _x = _i AND _y = _j") & apart
    )
    pairs = pairs.select(F.greatest("node", "_node").alias("u"), F.least("node", "_node").alias("v"), sizes).distinct()
    late = _verified(pairs.join(stars, ["u", "v"], "left_anti"), texts, percent)
    groups = stored(joined(so_far, late))

    moved = groups.where("node <> component")
    kept = distinct.select("_a", "_b", "node", "n").join(moved, "node", "left")
    kept = kept.where("n > 1 OR component IS NOT NULL")
    kept = stored(kept.select("_a", "_b", F.col("node").alias("_first"), F.coalesce("component", "node").alias("_kept")))
    discard(*read, met, nodes, texts, concerned, links, so_far, waiting, late, groups)
    gone = lines.select("doc_id", "line_no", "_a", "_b").join(small(kept), ["_a", "_b"])
    gone = gone.where(F.struct("doc_id", "line_no") != F.col("_kept"))
    return gone.select(
        "doc_id",
        "line_no",
        F.col("_kept.doc_id").alias("kept_doc_id"),
        F.col("_kept.line_no").alias("kept_line_no"),
        (F.col("_first") == F.col("_kept")).alias("equal"),
    )


def clean(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The documents without the lines that go, with all their columns; `n_chars`, where present, follows the text.

    Documents that lose every line they had go themselves: all of it stands elsewhere.
    """
    gone = duplicates(docs, percent).groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    gone = stored(gone)
    lines = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_gone", i))
    left = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    named = {c: f"_in{c}" for c in docs.columns if c == "_gone"}
    rows = docs.withColumnsRenamed(named).join(small(gone, 256), "doc_id", "left")
    rows = rows.withColumn("text", left).where(F.col("_gone").isNull() | (F.trim(F.regexp_replace("text", r"\s", " ")) != ""))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return rows.select(*[F.col(f"`{named.get(c, c)}`").alias(c) for c in docs.columns])
