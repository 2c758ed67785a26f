"""Column expressions over text: tokens, sentences, packing. No Python per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.constants import MAX_CHARS, OVERLAP_SENTENCES, TOKEN_PATTERN, WHITESPACE


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates `value` once per row and hands it to `body`.

    An expression referenced inside a lambda may otherwise be inlined there and
    evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    """Every run of whitespace becomes one space; the ends are trimmed."""
    # A single space stays as it is, so that only what changes is written anew.
    return F.trim(F.regexp_replace(text, rf"(?! (?!{WHITESPACE})){WHITESPACE}+", " "))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.length(strip_space(text)) == 0


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_PATTERN})"), 1)


def token_count(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(TOKEN_PATTERN)).cast("long")


def term_counts(words: Column) -> Column:
    """`array<struct<term, tf>>` of a token array, computed within the row.

    The sorted array is cut where neighbours differ, so counting a document's
    terms needs no shuffle.
    """

    def runs(ordered: Column) -> Column:
        def cut(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda at, i: F.struct(
                    F.get(ordered, at).alias("term"),
                    (F.coalesce(F.get(starts, i + 1), F.size(ordered)) - at).cast("long").alias("tf"),
                ),
            )

        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(starts, cut)

    nothing = F.expr("cast(array() as array<struct<term:string,tf:bigint>>)")
    return let(F.sort_array(words), lambda s: F.when(F.size(s) == 0, nothing).otherwise(runs(s)))


def bags(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document: `key`, token count and its terms with counts."""
    words = df.select(key, tokens(F.col(text)).alias("_words"))
    return words.select(
        key,
        F.size("_words").cast("long").alias("length"),
        term_counts(F.col("_words")).alias("terms"),
    )


def question_terms(questions: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """`key, term, qtf`: a term repeated in a question counts each time."""
    return bags(questions, key, text).selectExpr(key, "inline_outer(terms) as (term, qtf)").where("term is not null")


# --- sentences -------------------------------------------------------------

PASSAGE_SENTENCE_END = rf"(?<=[.!?]){WHITESPACE}+(?=[A-Z(])"
ANSWER_SENTENCE_END = rf"(?<=[.!?]){WHITESPACE}+"


def passage_sentences(text: Column) -> Column:
    """A sentence ends before a capital or an opening bracket."""
    return F.filter(F.split(text, PASSAGE_SENTENCE_END), lambda s: ~is_blank(s))


def answer_sentences(text: Column) -> Column:
    """A sentence ends at any whitespace after its full stop."""
    return F.filter(F.split(strip_space(text), ANSWER_SENTENCE_END), lambda s: ~is_blank(s))


# --- packing ---------------------------------------------------------------


def _spans(parts: Column, limit: int, overlap: int) -> Column:
    """Greedy grouping of consecutive parts as `array<struct<first, last>>`.

    Works on lengths alone. A group is closed when the next part would push the
    joined text past `limit`; the next group starts `overlap` parts back.
    """
    integer = "int"

    def fold(sizes: Column) -> Column:
        start_state = F.struct(
            F.lit(0).alias("first"),
            F.lit(-1).alias("width"),
            F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("done"),
        )

        def step(state: Column, i: Column) -> Column:
            grown = state["width"] + 1 + F.get(sizes, i)
            closing = (i > state["first"]) & (grown > limit)
            reopened = F.greatest(state["first"], i - overlap)
            rewidth = (
                F.aggregate(
                    F.slice(sizes, reopened + 1, i - reopened + 1), F.lit(0), lambda total, size: total + size
                )
                + i
                - reopened
            )
            closed = F.concat(
                state["done"],
                F.array(F.struct(state["first"].alias("first"), (i - 1).cast(integer).alias("last"))),
            )
            return F.when(
                closing,
                F.struct(
                    reopened.cast(integer).alias("first"),
                    rewidth.cast(integer).alias("width"),
                    closed.alias("done"),
                ),
            ).otherwise(
                F.struct(
                    state["first"].alias("first"),
                    grown.cast(integer).alias("width"),
                    state["done"].alias("done"),
                )
            )

        def finish(state: Column) -> Column:
            last = F.struct(state["first"].alias("first"), (F.size(sizes) - 1).cast(integer).alias("last"))
            return F.concat(state["done"], F.array(last))

        return F.aggregate(F.sequence(F.lit(0), F.size(sizes) - 1), start_state, step, finish)

    nothing = F.expr("cast(array() as array<struct<first:int,last:int>>)")
    sizes = F.transform(parts, lambda part: F.length(part))
    return F.when(F.size(parts) == 0, nothing).otherwise(let(sizes, fold))


def _joined(parts: Column, limit: int, overlap: int) -> Column:
    return F.transform(
        _spans(parts, limit, overlap),
        lambda span: F.array_join(F.slice(parts, span["first"] + 1, span["last"] - span["first"] + 1), " "),
    )


def _word_pieces(piece: Column, limit: int) -> Column:
    """A piece still above the limit is cut between words; a giant word stays whole."""
    words = F.filter(F.split(piece, WHITESPACE + "+"), lambda w: F.length(w) > 0)
    return F.when(F.length(piece) <= limit, F.array(piece)).otherwise(
        let(words, lambda w: _joined(w, limit, 0))
    )


def pack(text: Column, limit: int = MAX_CHARS, overlap: int = OVERLAP_SENTENCES) -> Column:
    """Splits a text into pieces of at most `limit` characters between sentences.

    Consecutive pieces share `overlap` sentences. A text within the limit is
    returned unchanged.
    """
    packed = let(passage_sentences(text), lambda s: _joined(s, limit, overlap))
    pieces = F.flatten(F.transform(packed, lambda piece: _word_pieces(piece, limit)))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(pieces)


def title_case_if_shouted(title: Column) -> Column:
    """An all-capitals title gets a capital after every non-letter."""
    shouted = (F.upper(title) == title) & (F.lower(title) != title)
    cased = let(
        F.split(title, ""),
        lambda chars: F.array_join(
            F.transform(
                chars,
                lambda c, i: F.when(
                    (i > 0) & F.coalesce(F.get(chars, i - 1).rlike(r"\p{L}"), F.lit(False)), F.lower(c)
                ).otherwise(F.upper(c)),
            ),
            "",
        ),
    )
    return F.when(shouted, cased).otherwise(title)
