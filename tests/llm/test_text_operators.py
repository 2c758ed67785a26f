"""Scoring, quality rules, near copies, lines and passages against plain versions."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import shingle_set, similar_pairs, smallest_reachable, words
from pyspark.sql import functions as F

from folioscope.llm import jaccard, lines, ngrams, passages, quality
from folioscope.llm.graph import components, joined
from folioscope.llm.trie import Monotone, Shelf, Trie, quantised, restored

ODD = [None, "", " \n\t ", "a", "a b", "A  b\x0bc d", "x" * 30_000, "same words here " * 400, "same words here " * 400]


def made_up(n, seed, low=5, high=120, vocabulary=400):
    chance = random.Random(seed)
    return [" ".join(f"w{chance.randrange(vocabulary)}" for _ in range(chance.randint(low, high))) for _ in range(n)]


def edited(text, seed, share):
    chance = random.Random(seed)
    return " ".join(f"e{chance.randrange(10**6)}" if chance.random() < share else w for w in text.split())


# ---- connected components


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame(path + star + [(7, 7), (101, 100)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == smallest_reachable({n for e in path + star for n in e}, path + star)


def test_components_after_more_links(spark):
    first, more = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (30, 31), (21, 40), (2, 1)]
    edges, links = (spark.createDataFrame(rows, "u long, v long") for rows in (first, more))
    got = {r["node"]: r["component"] for r in joined(components(edges), links).collect()}
    assert got == smallest_reachable({n for e in first + more for n in e}, first + more)
    assert sorted(joined(components(edges), links.limit(0)).collect()) == sorted(components(edges).collect())


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- op1


def test_monotone_sequence_reads_and_finds():
    chance = np.random.default_rng(3)
    for universe in (1, 50, 10**6, 2**45):
        values = np.unique(chance.integers(0, universe, 500).astype(np.uint64))
        shelf = Shelf()
        level = Monotone(values, universe, shelf)
        shelf.close()
        n = len(values)
        assert (level.at(np.arange(n)) == values).all()
        asked = chance.integers(0, universe + 5, 300).astype(np.uint64)
        whole = np.zeros(300, dtype=np.int64), np.full(300, n)
        assert (level.find(asked, *whole) == np.searchsorted(values, asked)).all()


def test_trie_finds_what_it_holds_and_nothing_else():
    chance = np.random.default_rng(4)
    grams = np.unique(chance.integers(0, 40, (3000, 3)), axis=0)
    held, other = grams[::2], grams[1::2]
    trie = Trie(held, 40, np.full(len(held), 0.25), np.arange(len(held)) + 1)
    assert (trie.find(held) == np.arange(len(held))).all()
    assert (trie.find(other) == -1).all()
    codes, counts = trie.values(trie.find(np.concatenate([held, other])))
    assert counts.tolist() == [*range(1, len(held) + 1), *[0] * len(other)]
    assert np.allclose(restored(codes[: len(held)]), 0.25, rtol=1e-3) and not codes[len(held) :].any()


def test_quantised_probabilities_come_back_closely():
    values = 10.0 ** np.linspace(-8, 0, 1000)
    assert np.abs(restored(quantised(values)) / values - 1).max() < 2e-4
    assert (restored(np.zeros(1, dtype=np.uint16)) == 0).all()


@pytest.mark.parametrize("order", [2, 3])
def test_scores_are_those_of_the_plain_model(documents, order, monkeypatch):
    monkeypatch.setattr(ngrams, "HOT", 30)  # spreads common contexts over shards
    texts = ODD + made_up(60, 1, vocabulary=30)
    docs = documents([*enumerate(texts), (0, "a repeated id"), (None, "no id")])
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = sorted((r["doc_id"], *r[1:]) for r in ngrams.score(docs, held_out, order).collect() if r["doc_id"] not in (None, 0))

    every = [*enumerate(texts), (0, "a repeated id"), (None, "no id")]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in every]
    tokens = [["<"] * (order - 1) + words(t) + [">"] for _, t in every]
    counts = Counter()
    for own, out in zip(tokens, held, strict=True):
        if not out:
            counts.update(tuple(own[i - n + 1 : i + 1]) for n in range(1, order + 1) for i in range(n - 1, len(own)))
    singles = {g: c for g, c in counts.items() if len(g) == 1 and g != ("<",)}
    total, known = sum(singles.values()), len(singles)
    for (i, _), own, out in zip(every, tokens, held, strict=True):
        if i in (None, 0):
            continue
        base = score = 0.0
        for k in range(order - 1, len(own)):
            p = (counts[(own[k],)] + 1) / (total + known + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                gram = tuple(own[k - n + 1 : k + 1])
                weight = ngrams.WEIGHT[n]
                p = (counts[gram] + weight * p) / (counts[gram[:-1]] + weight)
            score += math.log10(p)
        row = next(r for r in got if r[0] == i)
        assert row[1:5] == (out, len(own) - order + 1, sum(counts[(w,)] > 0 for w in own[order - 1 :]), total)
        assert row[5] == pytest.approx(base, rel=1e-9) and row[6] == pytest.approx(score, abs=1e-4 * row[2])


def test_scoring_nothing_and_learning_from_nothing(documents):
    assert ngrams.score(documents([]), F.lit(False)).count() == 0
    rows = ngrams.score(documents(["a b", None]), F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(0, 0, 0.0, 0.0)] * 2


def test_held_out_texts_like_the_corpus_score_above_the_base(documents):
    chance = random.Random(8)
    after = {f"w{i}": [f"w{chance.randrange(50)}" for _ in range(3)] for i in range(50)}
    texts = []
    for _ in range(150):
        text = ["w0"]
        for _ in range(80):
            text.append(chance.choice(after[text[-1]]))
        texts.append(" ".join(text))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = ngrams.score(documents(texts), held_out).where("held_out").collect()
    assert rows and all(r["score"] > r["base_score"] for r in rows)


# ---- op3


def plain_counts(text):
    found = words(text, lower=False)
    text_lines = [x for x in (text or "").split("\n") if words(x)]
    runs = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    often = {r for r, n in Counter(runs).items() if n > 1}
    covered = {i + k for i, r in enumerate(runs) if r in often for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(found), sum(map(len, found)), symbols, len(text_lines) - len(set(text_lines)), len(covered), len(text_lines))


def test_counts_of_texts(corpus):
    texts = [r["text"] for r in corpus.collect()] + ODD + ["a a a a", "x y z x y z q", "a\n\na\n a\nb $$ |", " a b c"]
    assert [quality.measured(t) for t in texts] == [plain_counts(t) for t in texts]


def test_cutoffs_follow_the_group(documents):
    clean = made_up(300, 5, 60, 90)
    junk = [" ".join(w + "$#" for w in t.split()) for t in made_up(8, 6, 60, 90)]
    docs = documents(clean + junk + ODD)
    rows = {r["doc_id"]: r for r in quality.judge(docs, enough=20).collect()}
    assert len(rows) == 308 + len(ODD)
    assert all(rows[i]["kept"] for i in range(300))
    assert not any(rows[i]["kept"] for i in range(300, 308)) and not rows[300]["base_failed"]
    assert all(rows[308 + i]["base_failed"] and not rows[308 + i]["kept"] for i in (0, 1, 2, 3))
    kept = quality.filter_documents(docs, enough=20)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["kept"]}


def test_a_group_of_heavy_symbols_sets_its_own_cutoff(documents, spark):
    code = [" ".join(w + "$" if k % 3 else w for k, w in enumerate(t.split())) for t in made_up(150, 9, 60, 90)]
    prose = made_up(150, 10, 60, 90)
    docs = documents(code + prose + code[:1]).withColumn("lang", F.lit("en"))
    docs = docs.withColumn("source", F.when((F.col("doc_id") < 150), "code").otherwise("prose"))
    kept = {r["doc_id"] for r in quality.filter_documents(docs, enough=100).collect()}
    assert kept == set(range(300))  # the last, code among prose, goes


def test_repeated_lines_are_judged_by_their_group(documents):
    """Two groups of long documents: lists that repeat many lines, and prose that repeats none."""
    chance = random.Random(41)
    line = lambda: " ".join(f"w{chance.randrange(5000)}" for _ in range(6))

    def text(lines, repeats):
        own = [line() for _ in range(lines - repeats)]
        return "\n".join([*own, *(own[k % 3].split()[0] for k in range(repeats))])

    prose = [text(chance.randrange(25, 40), 0) for _ in range(150)]
    lists = [text(chance.randrange(40, 60), chance.randrange(12, 18)) for _ in range(150)]
    planted = [text(50, 22), prose[0] + "\n" + prose[0].split("\n")[0], text(60, 28)]
    docs = documents(prose + lists + planted).withColumn("lang", F.lit("en"))
    docs = docs.withColumn("source", F.when((F.col("doc_id") >= 150) & (F.col("doc_id") < 300), "lists").otherwise("prose"))
    rows = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert all(rows[i]["kept"] for i in range(300))
    assert not any(r["base_failed"] for r in rows.values())
    assert [rows[i]["kept"] for i in (300, 301, 302)] == [False, True, False]
    cuts = quality.thresholds(quality.with_metrics(quality.with_counts(docs, ["lang", "source"]))).collect()
    assert len({r["_cut"]["dup_line_share_max"] for r in cuts}) == 2 and {r["cutoff_level"] for r in cuts} == {0}


def test_quality_of_columns_named_like_its_own(documents):
    docs = documents(made_up(5, 42, 60, 90)).selectExpr("*", *[f"'mine' AS `{c}`" for c in ("_text", "_cut", "_l", "_s")])
    rows = quality.filter_documents(docs)
    assert rows.columns == docs.columns
    assert {(r["_text"], r["_cut"], r["_l"], r["_s"]) for r in rows.collect()} == {("mine",) * 4}


def test_quality_of_an_empty_table(documents):
    assert quality.judge(documents([])).count() == 0 and quality.filter_documents(documents([])).count() == 0


def test_quantiles_of_the_sketch_are_close(spark):
    chance = random.Random(2)
    values = [chance.lognormvariate(0, 1) for _ in range(5000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(quality.bucket(F.col("v")).alias("b"))
    middle = rows.select(quality._value(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY b)"))).first()[0]
    assert middle == pytest.approx(sorted(values)[2500], rel=0.03)


# ---- op5


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_similarity_join_finds_every_link(documents, width, percent):
    texts = ODD + made_up(60, 11)
    for k in range(9, 60):
        texts += [texts[k], edited(texts[k], k, 0.01 * (k % 5))]
    chain = made_up(1, 12, 200, 200)[0]
    for k in range(6):  # each like the one before, the ends unlike each other
        texts.append(chain)
        chain = chain.split()
        chain = " ".join(chain[8:] + [f"n{k}_{j}" for j in range(8)])
    got = {r["doc_id"]: r for r in jaccard.linked(documents(texts), width, percent).collect()}
    sets = {i: shingle_set(t, width) for i, t in enumerate(texts)}
    want = smallest_reachable(sets, similar_pairs(sets, percent))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_one_document_of_a_group_stays(documents):
    docs = documents([*ODD, (50, "one two three four five six"), (51, "ONE two three four five six"), (None, "x y"), (50, "one two three four five six")])
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in kept.collect())
    assert ids == [-1, 0, 1, 2, 3, 4, 5, 6, 7, 50, 50]


def test_similarity_join_of_nothing(documents):
    assert jaccard.linked(documents([])).count() == 0


def test_fewer_columns_keep_the_order():
    chance = np.random.default_rng(26)
    for bound in (5, 1 << 20, 1 << 21, (1 << 31) + 7, 1 << 62):
        grams = chance.integers(0, bound, (400, 3)) if bound > 5 else chance.integers(0, 5, (400, 3))
        grams[:2] = [[0, bound - 1, bound - 1], [bound - 1, 0, 0]]
        few = ngrams._few(list(grams.T), [bound] * 3)
        assert len(few) == (1 if bound < 1 << 21 else 2 if bound < 1 << 32 and bound**2 < 1 << 63 else 3)
        assert np.array_equal(np.lexsort(few[::-1]), np.lexsort(grams.T[::-1]))


# ---- op2


def plain_shingles(line):
    return {line[i : i + 8] for i in range(max(1, len(line) - 7))}


def line_sets(texts):
    first, places = {}, []
    for i, text in sorted(texts):
        for k, line in enumerate((text or "").split("\n")):
            line = line.strip(" \t\n\x0b\f\r")
            if line:
                places.append((i, k, line))
                first.setdefault(line, (i, k))
    return first, places, {place: plain_shingles(line) for line, place in first.items()}


def test_like_lines_go_but_for_the_first(documents):
    base = made_up(40, 20, 8, 60)
    texts = []
    for k in range(30):
        own = [base[(k * 7 + j) % 40] for j in range(4)]
        own[1] = edited(own[1], k, 0.03)
        texts.append("\n".join([*own, "", "  ", f"only here {k} {'z' * k}"]))
    texts += [None, "", "\n\n", "漢字漢字漢字の行です", "漢字漢字漢字の行です", "Le " * 300]
    got = {(r["doc_id"], r["line_no"]): (r["kept_doc_id"], r["kept_line_no"]) for r in lines.duplicates(documents(texts)).collect()}
    first, places, sets = line_sets(enumerate(texts))
    group = smallest_reachable(sets, similar_pairs(sets, 80))
    want = {(i, k): group[first[line]] for i, k, line in places if group[first[line]] != (i, k)}
    assert set(got) <= set(want)
    assert len(got) >= 0.97 * len(want)
    equal = {(i, k) for i, k, line in places if first[line] != (i, k)}
    assert equal <= set(got)


def test_cleaned_documents(documents):
    docs = documents(["one line of some length\nanother line that stays", "one line of some length\n\nits own last line", "one line of some length", None, ""])
    rows = {r["doc_id"]: r for r in lines.clean(docs).collect()}
    assert rows[0]["text"] == "one line of some length\nanother line that stays"
    assert rows[1]["text"] == "\nits own last line" and rows[1]["n_chars"] == len(rows[1]["text"])
    assert rows[0]["_gone"] == rows[0]["_spans"] == "x"
    assert 2 not in rows and rows[3]["text"] is None and rows[4]["text"] == ""
    assert lines.clean(docs).columns == docs.columns
    assert lines.clean(documents([])).count() == 0


def line_texts():
    """Lines that are alike at word starts only, and lines of which each has a copy with one edit."""
    chance = random.Random(21)
    thai = ["".join(chr(0x0E01 + chance.randrange(46)) for _ in range(90)) for _ in range(4)]
    alike = ["https://example.org/a/very/long/path/one", "https://example.org/other/page?x=9", "Rechnungsnummer: 20240001-A", "Rechnungsnummer: 97316442-B"]
    alike += ["short", "shore", "seven c", "/usr/share/" + "x" * 40, "/usr/share/" + "y" * 40, "\U0001f600" * 9 + "a", "\U0001f600" * 9 + "b", *thai]
    alike += [thai[0][:8] + thai[1][8:], thai[2][:40] + "\u0e20" + thai[2][41:], "z" + thai[3]]
    for k in range(20):
        path = "https://host/" + "".join(chance.choice("abcdefghij/") for _ in range(150))
        alike += [path, path[:70] + "Z" + path[71:]]
    return alike


def test_lines_are_compared_at_every_character(documents):
    texts = line_texts()
    got = {r["doc_id"]: r["kept_doc_id"] for r in lines.duplicates(documents(texts)).collect()}
    sets = {i: plain_shingles(line) for i, line in enumerate(texts)}
    group = smallest_reachable(sets, similar_pairs(sets, 80))
    want = {i: g for i, g in group.items() if g != i}
    assert got.items() <= want.items() and len(want) >= 22
    assert len(got) >= 0.97 * len(want)


@pytest.mark.parametrize("block", [37, 2048])
def test_lines_of_one_template_are_all_compared(documents, block, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK", block, raising=False)
    chance = random.Random(22)
    frame = "".join(chance.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200))
    texts = []
    for _ in range(150):
        own = "".join(chance.choice("0123456789") for _ in range(40))
        texts.append(f"{frame[:100]}|{own}|{frame[100:]}")
        texts.append(f"{frame[:100]}|{own[:20]}x{own[21:]}|{frame[100:]}")
    chance.shuffle(texts)
    sets = {i: plain_shingles(line) for i, line in enumerate(texts)}
    want = {i: g for i, g in smallest_reachable(sets, similar_pairs(sets, 80)).items() if g != i}
    assert len(want) == 150
    got = {r["doc_id"]: r["kept_doc_id"] for r in lines.duplicates(documents(texts)).collect()}
    assert got == want


def test_unlike_lines_of_one_passage_are_not_compared_exactly(documents, monkeypatch):
    chance = random.Random(23)
    some = lambda n: "".join(chance.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).strip()
    passage = some(240)
    texts = [f"{some(30)}{passage}{some(30)}" for _ in range(90)]
    texts += [f"{t[:9]}#{t[10:]}" for t in texts[:30]]
    sets = {i: plain_shingles(line) for i, line in enumerate(texts)}
    links = similar_pairs(sets, 80)
    checked, plain = [], lines._verified

    def counted(pairs, *rest):
        checked.extend((r["u"]["doc_id"], r["v"]["doc_id"]) for r in pairs.collect())
        return plain(pairs, *rest)

    monkeypatch.setattr(lines, "_verified", counted)
    got = {r["doc_id"]: r["kept_doc_id"] for r in lines.duplicates(documents(texts)).collect()}
    assert got == {i: g for i, g in smallest_reachable(sets, links).items() if g != i}
    assert len(checked) < 2 * len(texts)


def test_sketches_lose_no_pair(documents):
    chance = random.Random(24)
    texts = line_texts()
    for size in (8, 9, 40, 300, 3000):
        line = "".join(chance.choice("abcdefgh ij") for _ in range(size)).replace(" ", "k")
        texts += [line, line[: size - size // 10], line[: size // 2] + line[size // 2 + 1 :], line + line[: size // 8], "ab" * size]
    rows = lines.split_lines(documents(texts)).withColumn("node", F.struct("doc_id", "line_no"))
    rows = lines.sketched(rows).withColumn("_m", F.array(*[F.lit(1)] * lines.HASHES))
    left, right = (rows.select(F.col("node.doc_id").alias(i), F.struct("_size", "_bits", "_m").alias(p)) for i, p in (("i", "_p"), ("j", "_q")))
    near = {(r["i"], r["j"]) for r in left.join(right, F.expr("i < j")).where(lines._near("_p", "_q", 80)).collect()}
    sets = {i: plain_shingles(line) for i, line in enumerate(texts)}
    links = {(min(p), max(p)) for p in similar_pairs(sets, 80)}
    assert len(links) > 25 and links <= near
    assert {r["node"]["doc_id"]: r["_size"] for r in rows.collect()} == {i: len(s) for i, s in sets.items()}


def test_signatures_hold_all_minima(documents, monkeypatch):
    chance = random.Random(25)
    texts = [*line_texts(), "\u00e9" + "x" * 7, "\u00e9t\u00e9", "-" * 700, "ab" * 400, "na\u00efve " * 90, "\U0001f600" * 300]
    texts += ["".join(chance.choice("abcd\u00e9\u4e2d ") for _ in range(n)).strip() + "." for n in (1, 6, 7, 8, 9, 60, 900, 5000)]
    rows = lines.split_lines(documents(texts))
    plain = rows.select("doc_id", F.explode(lines.shingles(F.col("line"))).alias("_s")).select("doc_id", F.xxhash64("_s").alias("_x"))
    want, got = ({}, {})
    for found, table in ((want, plain), (got, lines.hashed(rows, "doc_id"))):
        for r in table.collect():
            found.setdefault(r["doc_id"], []).append(r["_x"])
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    flips, _ = lines._choices()
    minima = {i: [min((v & lines._BITS) ^ flip for v in x) for flip in flips] for i, x in want.items()}
    full, plain_minima = [], lines._minima

    def counted(table, few):
        if not few:
            full.extend(r["doc_id"] for r in table.select("doc_id").collect())
        return plain_minima(table, few)

    monkeypatch.setattr(lines, "_minima", counted)
    distinct, _ = lines.signed(documents(texts).select("doc_id", "text"))
    assert {r["node"]["doc_id"]: r["_m"] for r in distinct.collect()} == {i: minima[i] for i in want}
    assert texts.index("-" * 700) in full and len(full) < 10


# ---- op7


def test_repeated_passages_are_found_and_clean_documents_are_not(documents):
    filler, passage = made_up(40, 30, 80, 200, 5000), made_up(1, 31, 70, 70, 5000)[0]
    texts = list(filler)
    for k in (3, 9, 17):
        texts[k] = f"{filler[k]} {passage} {filler[k + 1][:50]}"
    fuzzy = passage.split()
    for k in (11, 26, 41, 55):
        fuzzy[k] = f"changed{k}"
    texts[25] = f"{filler[25]} {' '.join(fuzzy)}"
    docs = documents([*enumerate(texts), *((100 + i, t) for i, t in enumerate(ODD[:5])), (200, filler[30]), (201, filler[30].upper())])
    rows = passages.repeated(docs).collect()
    assert {r["doc_id"] for r in rows} == {9, 17, 25, 200, 201}
    assert {r["ref_doc_id"] for r in rows} <= {3, 9, 17, 30, 200}
    for r in rows:
        own = words(texts[r["doc_id"]] if r["doc_id"] < 100 else filler[30])
        assert 0 <= r["start_word"] < r["end_word"] <= len(own) and r["end_word"] - r["start_word"] >= 50
    spans = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in rows if r["ref_doc_id"] == 3}
    begin = len(filler[9].split())
    assert spans[9][0] <= begin and spans[9][1] >= begin + 70


def common_words(x, y):
    row = [0] * (len(y) + 1)
    for word in x:
        corner = 0
        for j, own in enumerate(y, 1):
            corner, row[j] = row[j], corner + 1 if own == word else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("length,similarity", [(60, 0.80), (55, 0.83), (70, 0.85), (100, 0.81), (55, 0.91)])
def test_fuzzy_passages_are_found(documents, length, similarity):
    """Random substitutions near the threshold: found, and every row found is as alike as plain alignment says."""
    chance, pairs = random.Random(length), 40
    filler = made_up(2 * pairs, 34, 60, 120, 10**6)
    texts = list(filler)
    for k in range(pairs):
        held = [f"p{chance.randrange(10**6)}" for _ in range(length)]
        copy = list(held)
        for at in chance.sample(range(1, length - 1), round(length * (1 - similarity))):
            copy[at] = f"e{chance.randrange(10**6)}"
        for i, run in ((k, held), (pairs + k, copy)):
            own = filler[i].split()
            texts[i] = " ".join([*own[:30], *run, *own[30:]])
    rows = passages.repeated(documents(texts)).collect()
    assert all(r["doc_id"] == r["ref_doc_id"] + pairs for r in rows)
    assert len({r["doc_id"] for r in rows}) >= 0.9 * pairs
    for r in rows:
        own = texts[r["doc_id"]].split()[r["start_word"] : r["end_word"]]
        other = texts[r["ref_doc_id"]].split()[r["ref_start_word"] : r["ref_end_word"]]
        assert min(len(own), len(other)) >= 50 and common_words(own, other) >= 0.8 * max(len(own), len(other))


def test_every_run_of_words_is_a_seed(documents):
    """An edit after every fifth word leaves runs of five words alone, none of which may be left out."""
    chance, pairs = random.Random(9), 40
    filler = made_up(2 * pairs, 35, 60, 120, 10**6)
    texts = list(filler)
    for k in range(pairs):
        held = [f"p{chance.randrange(10**6)}" for _ in range(65)]
        copy = [f"e{chance.randrange(10**6)}" if at % 6 == 5 else word for at, word in enumerate(held)]
        for i, run in ((k, held), (pairs + k, copy)):
            own = filler[i].split()
            texts[i] = " ".join([*own[:30], *run, *own[30:]])
    docs = documents(texts)
    assert {r["doc_id"] for r in passages.repeated(docs).collect()} == set(range(pairs, 2 * pairs))
    assert passages.seeds(docs).count() == sum(len(words(t)) - 4 for t in texts)


def test_long_windows_are_equal_for_equal_runs_alone():
    values = np.random.default_rng(4).integers(0, 3, 400).astype(np.uint64)
    for width in (1, 2, 7, 50, 400, 401):
        runs = [values[i : i + width].tobytes() for i in range(len(values) - width + 1)]
        hashes = passages.long_windows(values, width).tolist()
        assert len(hashes) == len(runs) and len(set(hashes)) == len(set(runs)) == len(set(zip(hashes, runs, strict=True)))


def test_exact_passages_are_found_behind_partial_quotes(documents):
    filler, held = made_up(120, 32, 60, 90, 5000), made_up(30, 33, 52, 52, 50_000)
    texts = [*filler[:30]]
    for k in range(30):
        texts[k] = f"{filler[k]} {' '.join(held[k].split()[:40])} {filler[k + 30]}"
    texts += [f"{filler[k + 60]} {held[k]}" for k in range(30)] + [f"{held[k]} {filler[k + 90]}" for k in range(30)]
    rows = passages.repeated(documents(texts)).collect()
    got = {(r["doc_id"], r["ref_doc_id"]) for r in rows}
    assert {(60 + k, 30 + k) for k in range(30)} == got


def test_passages_are_cut_out(documents):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = documents([f"start\n{passage}\nend", f"before it\n{passage}\nafter it", passage, None, ""])
    rows = {r["doc_id"]: r for r in passages.clean(docs).collect()}
    assert rows[0]["text"] == f"start\n{passage}\nend"
    assert rows[1]["text"] == "before it\nafter it" and rows[1]["n_chars"] == 18
    assert set(rows) == {0, 1, 3, 4} and passages.clean(docs).columns == docs.columns
    assert passages.clean(documents([])).count() == 0


def test_chains_go_on_over_gaps_and_not_backwards():
    a = np.array([0, 4, 8, 30, 34, 60])
    rows = passages.segments(a, a + np.array([100, 100, 100, 103, 103, 20]))
    assert rows.tolist() == [[0, 100, 13], [30, 133, 9], [60, 80, 5]]
    assert [c.tolist() for c in passages.chains(rows)] == [[[0, 100, 13], [30, 133, 9]], [[60, 80, 5]]]


def test_alignment_counts_edits():
    x = np.arange(100, dtype=np.uint64)
    y = np.concatenate([x[:50], [np.uint64(999)], x[50:]])
    start, end, other, other_end, share = passages.aligned(x, y, np.array([[10, 10, 20], [60, 61, 20]]))
    assert (start, end, other, other_end) == (0, 100, 0, 101) and share == pytest.approx(100 / 101)
