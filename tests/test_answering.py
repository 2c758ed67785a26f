"""Planning, context, citations, cache, events, providers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.constants import REFUSAL
from folioscope.operators import cache, citations, context, events, planning
from folioscope.plans import answering
from folioscope.plans.retrieval import Corpus
from folioscope.plugins import ExtractiveProvider, ModelError, RemoteProvider, after, forward, provider_named, try_models


def plans(spark, question):
    rows = spark.createDataFrame([(1, question)], "query_id long, text string")
    return [r["text"] for r in planning.plan(rows).orderBy("query_no").collect()]


def test_a_plain_question_is_one_query(spark):
    assert plans(spark, "How is the key rate computed?") == ["How is the key rate computed?"]


def test_a_comparison_adds_its_sides(spark):
    question = "Compare decoy state protocols versus measurement device independent ones?"
    assert plans(spark, question) == [question, "Compare decoy state protocols", "measurement device independent ones"]
    assert plans(spark, "BB84 vs. E91") == ["BB84 vs. E91", "BB84 vs. E91"]
    assert plans(spark, "trade-offs between A and B")[0] == "trade-offs between A and B"


def merged(spark, rows, **options):
    ranked = spark.createDataFrame([(f"1#{n}", r, c, 0.5) for n, r, c in rows], "query_id string, rank long, chunk_id long, score double")
    queries = spark.createDataFrame([(f"1#{n}", 1, n) for n in range(3)], "query_id string, question_id long, query_no long")
    return [r["chunk_id"] for r in planning.merge(ranked, queries, **options).orderBy("number").collect()]


def test_passages_are_kept_once_in_query_order_and_capped(spark):
    rows = [(0, 1, 7), (0, 2, 8), (1, 1, 8), (1, 2, 9), (2, 1, 5)]
    assert merged(spark, rows) == [7, 8, 9, 5]
    assert merged(spark, rows, cap=3) == [7, 8, 9]
    assert merged(spark, rows, interleave=True) == [7, 8, 5, 9]


PASSAGES = "array<struct<number:bigint,paper_id:string,section:string,paragraph:bigint,text:string>>"


def checked(spark, answer, count=3):
    listed = [(n, f"24{n}v1", "Results", n, f"text {n}") for n in range(1, count + 1)]
    return citations.check(spark.createDataFrame([(answer, listed)], f"answer string, passages {PASSAGES}")).first()


def test_citations_resolve_once_in_order(spark):
    row = checked(spark, "B holds [3][1]. A holds [3].")
    assert [(c["number"], c["paper_id"], c["paragraph"]) for c in row["citations"]] == [(1, "241v1", 1), (3, "243v1", 3)]
    assert row["invalid"] == [] and row["grounded"] == 1.0


def test_numbers_outside_the_passages_are_reported_in_order(spark):
    row = checked(spark, "X [0] and [7]. Y [7][2]. Z [99999999999999999999].")
    assert row["invalid"] == ["0", "7", "7", "99999999999999999999"] and [c["number"] for c in row["citations"]] == [2]


def test_uncited_sentences_lower_the_share(spark):
    row = checked(spark, "Cited [1]. Not cited. Nor this!")
    assert (row["sentences"], row["uncited"]) == (3, 2) and row["grounded"] == pytest.approx(1 / 3)
    assert checked(spark, "Claim. [1] Next [2].")["uncited"] == 1


def test_refusals_and_empty_answers_count_as_grounded(spark):
    refused = checked(spark, f" {REFUSAL}. But see [9].")
    assert refused["refused"] and refused["sentences"] == 0 and refused["invalid"] == [] and refused["grounded"] == 1.0
    assert checked(spark, "")["grounded"] == 1.0 and not checked(spark, "")["refused"]


def test_prompt_carries_numbered_provenance(spark):
    listed = [(1, "241v1", "Results", 4, "first"), (2, "242v1", "Intro", 0, "second")]
    row = spark.createDataFrame([("Why?", listed)], f"q string, p {PASSAGES}")
    text = row.select(context.prompt(F.col("q"), F.col("p"))).first()[0]
    assert "[1] 241v1 · Results · paragraph 4\nfirst\n\n[2] 242v1 · Intro · paragraph 0\nsecond" in text
    assert text.endswith("\n\nQuestion: Why?\n\nAnswer:") and REFUSAL in text


def test_event_text_is_split_as_the_reader_does(spark):
    def split(buffer):
        row = spark.createDataFrame([(buffer,)], "b string").select(events.split_events(F.col("b")).alias("r")).first()["r"]
        return [(e["event"], e["data"]) for e in row["events"]], row["rest"]

    crlf = 'event: token\r\ndata: "first"\r\n\r\nevent: token\r\ndata: "second"\r\n\r\n'
    assert split(crlf) == ([("token", '"first"'), ("token", '"second"')], "")
    assert split(crlf.replace("\r", "")) == split(crlf)
    assert split("data: 1\ndata: 2\n\n: keep-alive\r\n\r\nevent: tok") == ([("message", "1\n2")], "event: tok")


def vectors(spark, rows, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{key} long, embedding array<float>")


def test_cache_hits_at_the_threshold_and_prefers_the_oldest(spark):
    entries = vectors(spark, [(1, (1, 0, 0)), (2, (1, 0, 0)), (3, (0, 1, 0))], "seq")
    asked = vectors(spark, [(1, (1, 0, 0)), (2, (0.9, 0.435889894, 0)), (3, (0, 0, 1))], "query_id")
    rows = {r["query_id"]: (r["seq"], r["hit"]) for r in cache.lookup(asked, entries).collect()}
    assert rows == {1: (1, True), 2: (1, True), 3: (1, False)}
    nothing = cache.lookup(asked, entries.limit(0))
    assert [r["hit"] for r in nothing.collect()] == [False] * 3
    assert cache.hit_rate(nothing.limit(0)).first()["hit_rate"] == 0.0


def test_cache_keeps_the_latest(spark):
    rows = spark.range(10).withColumnRenamed("id", "seq")
    assert sorted(r["seq"] for r in cache.surviving(rows, 3).collect()) == [7, 8, 9]


def papers(spark):
    rows = [(i, f"2401.{i}v1", "Results", i, t) for i, t in enumerate(["The key rate falls. It does.", "Bell tests close loopholes.", "Decoy states help the key rate."], 1)]
    return Corpus(spark.createDataFrame(rows, "chunk_id long, paper_id string, section string, paragraph long, text string"))


def test_answers_cite_what_was_retrieved_and_the_cache_spares_the_model(spark):
    corpus = papers(spark)
    asked = spark.createDataFrame([(1, "How does the key rate fall?"), (2, "zzz qqq")], "query_id long, text string")
    first = answering.answer(corpus, asked)
    rows = {r["query_id"]: r for r in first.collect()}
    assert rows[1]["grounded"] == 1.0 and rows[1]["citations"][0]["paper_id"].startswith("2401.") and rows[2]["refused"]
    entries = answering.stored_entries(corpus, first)
    assert sorted(r["seq"] for r in entries.collect()) == [1, 2]

    def never(model, prompt):
        raise AssertionError("reached")

    again = answering.answer(corpus, asked, RemoteProvider(["m"], never), entries=entries)
    assert all(r["cached"] and r["answer"] == rows[r["query_id"]]["answer"] for r in again.collect())
    streamed = answering.stream_events(again).where("query_id = 1").orderBy("seq").collect()
    assert [r["event"] for r in streamed] == ["passages", "token", "citations"]
    assert '"cached":true' in streamed[-1]["data"] and events.wire(answering.stream_events(again)).count() == 6


def test_a_remote_model_is_asked_per_prompt(spark):
    corpus, asked = papers(spark), spark.createDataFrame([(1, "How does the key rate fall?")], "query_id long, text string")
    provider = RemoteProvider(["m"], lambda model, prompt: iter(["It falls ", "", "[1]. Made up [9]."]))
    row = answering.answer(corpus, asked, provider).first()
    assert row["answer"] == "It falls [1]. Made up [9]." and row["invalid"] == ["9"]


def failing(codes):
    def call(model):
        calls.append(model)
        if codes.get(model):
            raise ModelError(codes[model])
        return "answer"

    calls = []
    return call, calls


def test_models_are_tried_in_order():
    pauses = []
    call, calls = failing({"busy": 503})
    assert try_models(["busy", "spare"], call, 3, pauses.append) == "answer"
    assert calls == ["busy"] * 3 + ["spare"] and pauses == [2.0, 4.0]
    call, calls = failing({"spent": 429})
    assert try_models(["spent", "fresh"], call, 3, pauses.append) == "answer" and calls == ["spent", "fresh"]
    call, calls = failing({"a": 400})
    with pytest.raises(ModelError):
        try_models(["a", "b"], call)
    assert calls == ["a"]
    call, calls = failing({"a": 429, "b": 503})
    with pytest.raises(ModelError, match="503"):
        try_models(["a", "b"], call, 2, pauses.append)
    statuses = (429, 500, 503, 400, 404, None)
    assert [after(ModelError(code)) for code in statuses] == ["next", "again", "again", "stop", "stop", "stop"]
    assert after(ValueError("no status")) == "stop"


def test_a_model_failing_on_its_first_fragment_is_replaced():
    def ask(model, prompt):
        if model == "busy":
            raise ModelError(429)
        yield from ["a", "", "b"]

    assert list(RemoteProvider(["busy", "spare"], ask).fragments("p")) == ["a", "b"]


def test_unknown_providers_are_refused():
    with pytest.raises(ValueError):
        provider_named("other")


def test_graphs_run_in_small_batches():
    class Item:
        def __init__(self, text):
            self.ids, self.attention_mask, self.type_ids = [len(text)] * len(text), [1] * len(text), [0] * len(text)

    class Graph:
        sizes = []

        def get_inputs(self):
            return [type("Input", (), {"name": "input_ids"})]

        def run(self, _, feeds):
            assert list(feeds) == ["input_ids"]
            self.sizes.append(feeds["input_ids"].shape)
            return [feeds["input_ids"][:, :1].astype(float)]

    tokenizer = type("Tokenizer", (), {"encode_batch": staticmethod(lambda texts: [Item(t) for t in texts])})
    assert forward(tokenizer, Graph(), ["a", "bbb", "cc", "d"], 512, cells=4).ravel().tolist() == [1.0, 3.0, 2.0, 1.0]
    assert Graph.sizes == [(1, 3), (2, 2), (1, 1)]
    Graph.sizes.clear()
    assert forward(tokenizer, Graph(), ["a", "bbbbb"], 2).ravel().tolist() == [1.0, 5.0] and Graph.sizes == [(2, 2)]
    assert forward(tokenizer, Graph(), [], 512).shape == (0, 0)


def test_cache_replay_follows_question_order(spark, tmp_path):
    from folioscope.streaming import cache as streaming_cache

    rng = np.random.default_rng(5)
    raw = rng.normal(size=(12, 4))
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    rows = [(node, seq, f"a{seq}", [float(x) for x in unit[rng.integers(12)]]) for seq in range(60) for node in (1, 2)]
    schema = "node long, seq long, answer string, embedding array<double>"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 20 == part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming_cache.replay(stream, capacity=5).writeStream.format("memory").queryName("served").outputMode("append")
    query = query.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    served = {(r["node"], r["seq"]): (r["hit"], r["answer"]) for r in spark.table("served").collect()}
    wanted = {}
    for node in (1, 2):
        held = []
        for _, seq, answer, vector in sorted(r for r in rows if r[0] == node):
            scores = [round(float(np.dot(vector, v)), 6) for v, _ in held]
            hit = bool(scores) and max(scores) >= 0.9
            wanted[node, seq] = (hit, held[scores.index(max(scores))][1] if hit else answer)
            if not hit:
                held = [*held, (vector, answer)][-5:]
    assert served == wanted


def test_long_answers_are_cut_at_markers_alone(spark):
    text = "a🙂" * 50_000 + "[1]" + "b🙂" * 50_000 + "[007][99999999999999999999]"
    rows = spark.createDataFrame([(text,), ("",), ("[1]",), ("no marker",)], "t string")
    cut = [[tuple(s) for s in r[0]] for r in rows.select(citations.spans(F.col("t"), F.expr("array(1L, 7L)"))).collect()]
    assert cut[0] == [("text", "a🙂" * 50_000), ("valid", "1"), ("text", "b🙂" * 50_000), ("valid", "007"), ("invalid", "99999999999999999999")]
    assert cut[1:] == [[], [("valid", "1")], [("text", "no marker")]]


def test_a_model_is_asked_once_per_question(spark):
    class Counting(ExtractiveProvider):
        def complete(self, df):
            seen = calls

            @F.udf("string")
            def note(text):
                seen.add(1)
                return text

            return super().complete(df).withColumn("answer", note.asNondeterministic()("answer"))

    calls = spark.sparkContext.accumulator(0)
    chunks = spark.createDataFrame([(1, "Heat moves through metal.", "p1", "s", 0), (2, "Water boils.", "p2", "s", 1)], "chunk_id long, text string, paper_id string, section string, paragraph long")
    asked = spark.createDataFrame([(1, "how does heat move in metal"), (2, "when does the water boil")], "query_id long, text string")
    checked_rows = answering.answer(Corpus(chunks), asked, Counting(), reranked=False)
    for _ in range(3):
        checked_rows.count()
    events.event_rows(checked_rows).collect()
    assert calls.value == 2


def test_an_evicted_entry_is_no_hit(spark):
    entries = spark.createDataFrame([(i, [1.0, 0.0] if i == 0 else [0.0, 1.0]) for i in range(1000)], "seq long, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert not cache.lookup(asked, entries).first()["hit"]
    assert cache.lookup(asked, entries, capacity=1000).first()["hit"]


def test_event_data_loses_all_white_space_round_it(spark):
    rows = spark.createDataFrame([("event:\ttoken\r\ndata:\t x \r\n\r\nrest",)], "b string")
    read = rows.select(events.split_events(F.col("b")).alias("r")).first()["r"]
    assert [(e["event"], e["data"]) for e in read["events"]] == [("token", "x")] and read["rest"] == "rest"
