"""The engine's operators against hand-computed results and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from ragloom.functions import columns as C
from ragloom.functions.python_columns import merge, parse_citations
from ragloom.operators import chunking, embedding, retrieval
from ragloom.options import ChunkOptions, EmbedOptions, PackingOptions, RetrievalOptions, SemanticOptions
from ragloom.plans import rag
from ragloom.providers import OfflineProvider
from ragloom.sources import stores
from ragloom.streaming.ingest import ingest_stream


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "document_id string, text string")


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [("one two three", 6, 2, [("one tw", 0), ("two th", 4), ("three", 8)]), ("one two th", 6, 2, [("one tw", 0), ("two th", 4)]), ("zyxwv", 4, 3, [("zyxw", 0), ("yxwv", 1)]), ("", 4, 1, []), (None, 4, 1, []), ("a😀\nb🚀c", 2, 0, [("a😀", 0), ("\nb", 3), ("🚀c", 5)]), ("😀b😀d😀f", 4, 3, [("😀b😀d", 0), ("b😀d😀", 2), ("😀d😀f", 3)])],
)
def test_fixed_chunks(spark, text, size, overlap, want):
    rows = chunking.fixed_chunks(docs(spark, text), ChunkOptions(size, overlap)).orderBy("chunk_index").collect()
    assert [(r["text"], r["start_offset"]) for r in rows] == want


KINDS = ["", "short", "word " * 300, "One sentence. Another one! A third? " * 40, "x" * 900, "😀🚀" * 200, "a\n\nb\n" * 150, "   lead", "漢字かな交じり文。" * 60, "\n\n\n" * 80, "mixed 😀 text, 漢字 and words. " * 40]


@pytest.mark.parametrize("overlap", [0, 16])
def test_recursive_chunks_cover_the_text_within_budget(overlap):
    for text in KINDS:
        spans = chunking.recursive_spans(text, ChunkOptions(100, overlap))
        assert bool(spans) == bool(text)
        if text:
            assert spans[0][0] == 0 and spans[-1][1] == len(text)
            assert all(b[0] <= a[1] and b[1] > a[1] for a, b in zip(spans, spans[1:], strict=False))
            assert all(len(text[a:b]) <= 100 for a, b in spans)


def test_recursive_token_mode():
    words = ChunkOptions(3, 0, count_tokens=lambda t: len(t.split()))
    text = "a b c d e f g"
    assert [text[a:b] for a, b in chunking.recursive_spans(text, words)] == ["a b c ", "d e f ", "g"]
    with pytest.raises(ValueError):
        ChunkOptions(3, 1, count_tokens=len)


def test_semantic_spans():
    import numpy as np

    text = "One is here. Two is here. Three is far."
    spans = chunking.sentence_spans(text)
    got = chunking.semantic_spans(text, np.array([[1, 0], [0.95, 0.05], [0, 1]]), spans, SemanticOptions(percentile=50))
    assert [text[a:b] for a, b in got] == ["One is here. Two is here. ", "Three is far."]
    assert chunking.similarity_threshold(np.array([0.5, 0.5]), 10) == -math.inf


def test_vectors(spark):
    rows = spark.createDataFrame([("alpha", [1.0, 0.0, 0.0]), ("beta", [0.0, 1.0, 0.0]), ("gamma", [0.7, 0.7, 0.0]), ("zero", [0.0, 0.0, 0.0])], "name string, embedding array<float>").withColumn("metadata", F.create_map(F.lit("k"), F.substring("name", 1, 1)))
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, query_vector array<float>")
    assert [r["name"] for r in retrieval.retrieve(q, rows, ["name"], RetrievalOptions(2)).orderBy("rank").collect()] == ["alpha", "gamma"]
    assert retrieval.retrieve(q, rows, ["name"], RetrievalOptions(1, 0.5, {"k": "g"})).collect()[0]["name"] == "gamma"
    assert rows.select(C.cosine(F.col("embedding"), F.col("embedding")).alias("c")).where("c = 0").count() == 1
    with pytest.raises(Exception, match="differ in length"):
        rows.select(C.dot(F.col("embedding"), F.array(F.lit(1.0)))).collect()


def test_more_queries_than_are_broadcast(spark):
    """Blocks of queries give the scores that brute force gives."""
    import numpy as np

    n = 2 * retrieval.BROADCAST_QUERIES + 345
    rng = np.random.default_rng(1)
    wanted, held = rng.integers(-3, 4, (n, 4)).astype(np.float32), rng.integers(-3, 4, (12, 4)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist(), {"k": "x"}) for k, v in enumerate(held)], "name int, embedding array<float>, metadata map<string,string>")
    q = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(wanted)], "query_id int, query_vector array<float>")
    size = np.linalg.norm(wanted.astype(float), axis=1)[:, None] * np.linalg.norm(held.astype(float), axis=1)
    score = np.divide(wanted.astype(float) @ held.T.astype(float), size, out=np.zeros_like(size), where=size > 0).astype(np.float32)
    got = retrieval.retrieve(q, rows, ["name"], RetrievalOptions(3)).collect()
    assert len(got) == 3 * n
    for r in got:
        assert r["score"] == pytest.approx(-np.sort(-score[r["query_id"]])[r["rank"] - 1], abs=1e-6)
        assert r["score"] == pytest.approx(score[r["query_id"], r["name"]], abs=1e-6)


def test_fusion(spark):
    rows = spark.createDataFrame([(1, 0, 1, "d0"), (1, 0, 2, "d1"), (1, 0, 3, "d0"), (1, 1, 1, "d0"), (1, 1, 2, "d2")], "query_id int, list_id int, rank int, item string")
    got = {r["item"]: r["score"] for r in retrieval.reciprocal_rank_fusion(rows, ["item"]).collect()}
    assert got == pytest.approx({"d0": 2 / 61, "d1": 1 / 62, "d2": 1 / 62})


def test_pack(spark):
    rows = spark.createDataFrame([(1, k, 20) for k in (1, 2, 3)], "query_id int, rank int, token_count int")
    got = retrieval.pack(rows, PackingOptions(50, separator_tokens=2)).orderBy("rank").collect()
    assert [r["status"] for r in got] == ["selected", "selected", "dropped"] and got[2]["drop_reason"] == "BudgetExhausted" and got[0]["tokens_used"] == 42
    order = spark.range(5).select(C.lost_in_middle(F.col("id").cast("int"), F.lit(5)).alias("p")).collect()
    assert [r["p"] for r in order] == [0, 4, 1, 3, 2]


def test_token_batches(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate([4, 4, 6, 2])] + [(2, 0, 99), (2, 1, 1)], "g int, k int, t int")
    got = embedding.token_batches(rows, ["g"], ["k"], "t", 10).orderBy("g", "k").collect()
    assert [r["batch_index"] for r in got] == [0, 0, 1, 1, 0, 1]


def test_metrics(spark):
    found = spark.createDataFrame([("q", k + 1, x) for k, x in enumerate("axby")] + [("dup", 1, "a"), ("dup", 2, "a")], "query_id string, rank int, item string")
    relevant = spark.createDataFrame([("q", "a"), ("q", "b"), ("dup", "a"), ("none", "z")], "query_id string, item string")
    got = {r["query_id"]: (r["ndcg"], r["reciprocal_rank"], r["recall_at_k"]) for r in retrieval.ranking_metrics(found, relevant, 2).collect()}
    assert got == {"q": (0.919721, 1.0, 0.5), "dup": (1.0, 1.0, 1.0), "none": (0.0, 0.0, 0.0)}


def test_retry_and_validation():
    class Flaky(OfflineProvider):
        calls = 0

        def embed(self, texts, kind):
            self.calls += 1
            if self.calls < 3:
                raise RuntimeError("HTTP 503")
            return super().embed(texts, kind)

    assert embedding.call_with_retry(Flaky(), ["a"], EmbedOptions(base_delay=0))[2] == 3
    assert embedding.response_problem([[1.0], [float("nan")]], 2, None) == "an embedding is not finite"
    assert embedding.response_problem([[1.0], [1.0, 2.0]], 2, None)


def test_json_and_citations(spark):
    assert merge({"a": {"x": 1}, "b": 2}, {"a": {"y": 2}, "c": 3}) == {"a": {"x": 1, "y": 2}, "b": 2, "c": 3}
    clean, found = parse_citations("A «cite:0»fact«/cite» and «cite:7»other«/cite».", 1)
    assert clean == "A fact and other." and found == [(2, 6, "fact", 0)]
    message = spark.createDataFrame([("HTTP 429",), ("embed-500d",), ("code 5000",), (None,)], "m string")
    assert [r[0] for r in message.select(C.is_transient(F.col("m"))).collect()] == [True, False, False, False]


def test_small_functions(spark):
    from ragloom.operators.grounding import grounding_documents, split_for_limit

    row = spark.range(1).select(C.input_type(F.lit("Query")).alias("a"), C.input_type(F.lit(None)).alias("b"), C.total_tokens(F.lit(2), F.lit(None), F.lit(3)).alias("c"), C.tool_choice(F.lit("Auto"), F.lit("x")).alias("d"), C.tool_choice(F.lit("f"), F.lit("x")).alias("e"), C.tool_arguments(F.lit('say "hi"')).alias("f"), C.strip_code_fence(F.lit("```json\n{}\n```")).alias("g"), C.ensure_json_word(F.lit("json please")).alias("h")).first()
    assert row[:5] == ("search_query", "search_document", 5, "auto", '{"type":"function","function":{"name":"x"}}') and row[5] == '"say \\"hi\\""' and row[6:] == ("{}", "json please")
    text = "some words " * 30 + "x" * 50
    parts = split_for_limit(text, 20)
    assert "".join(parts) == text and all(len(p) <= 20 for p in parts)
    chunk = spark.range(1).select(F.lit("d").alias("document_id"), F.lit(3).alias("chunk_index"), F.lit("t").alias("text"), F.create_map(F.lit("title"), F.lit("T")).alias("metadata"))
    assert tuple(grounding_documents(chunk).first()) == ("d_3", "t", "d", "T")


def test_streams(spark, tmp_path):
    lines = spark.createDataFrame([("r", 0, 'data: {"delta":"Hel"}'), ("r", 1, "event: x"), ("r", 2, "data: {bad"), ("r", 3, 'data: {"delta":"lo"}'), ("r", 4, "data: [DONE]"), ("r", 5, 'data: {"delta":"!"}')], "request_id string, seq int, line string")
    assert stores.assemble_answers(stores.sse_data(lines)).collect()[0]["answer"] == "Hello"
    docs(spark, "some text " * 300, "more").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("document_id string, text string").parquet(str(tmp_path / "in"))
    ingest_stream(stream, OfflineProvider(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("is_success").count() == 5


def test_ask(spark):
    chunks = rag.ingest(docs(spark, "cats and dogs", "stars and planets"), OfflineProvider())
    got = rag.ask(spark.createDataFrame([(1, "planets")], "query_id int, query string"), chunks, OfflineProvider(), RetrievalOptions(1)).collect()
    assert got[0]["n_selected"] == 1 and "stars" in got[0]["context"]


def test_texts_of_the_reference_kind(spark):
    """Fences, the JSON word, families, image kinds, malformed JSON, nulls."""
    from ragloom.functions.python_columns import citations, json_deep_merge, message_content

    fence = lambda t: spark.range(1).select(C.strip_code_fence(F.lit(t))).first()[0]
    assert fence(" ```json\n{}\n``` tail ") == "{}" and fence("  bare ") == "  bare " and fence("``` one line ```") == "``` one line ```" and fence("```\na\n```\nb\n```") == "a\n```\nb"
    row = spark.range(1).select(C.ensure_json_word(F.lit("Be brief.")), C.ensure_json_word(F.lit(None).cast("string")), *(C.model_family(F.lit(m)) for m in ("O3-mini", "gpt-5", "gpt-4o")), C.data_uri(F.lit("x.bmp"), F.lit("a").cast("binary"))).first()
    assert tuple(row) == ("Be brief. Respond in JSON.", "Respond in JSON.", "reasoning", "gpt5", "legacy", "data:application/octet-stream;base64,YQ==")
    rows = spark.createDataFrame([("{", '{"a":1}', None), ('{"b":2}', "{", None), ("{", "{", None), ('{"a":{"x":1}}', '{"a":{"y":2}}', 1)], "a string, b string, n int")
    got = rows.select(json_deep_merge("a", "b").alias("m"), message_content("a").alias("t"), citations(F.lit("«cite:0»x«/cite»"), "n").alias("c")).collect()
    assert [r["m"] for r in got] == ['{"a":1}', '{"b":2}', None, '{"a": {"x": 1, "y": 2}}'] and got[0]["t"] is None and got[0]["c"]["citations"] == [] and len(got[3]["c"]["citations"]) == 1


def test_judge_without_a_score(spark):
    from ragloom.operators.grounding import judge

    class Judge(OfflineProvider):
        def chat(self, messages, temperature=None):
            return '```json\n{"score": 1.4, "rationale": "r"}\n```' if "good" in messages[-1][1] else "no idea"

    rows = spark.createDataFrame([(1, "q", "c", "good"), (2, "q", "c", "bad")], "query_id int, query string, context string, answer string")
    got = {r["query_id"]: r for r in judge(rows, Judge(), "groundedness").collect()}
    assert got[1]["score"] == 1.0 and got[1]["error"] is None and got[2]["score"] is None and "no idea" in got[2]["error"]


def test_embedding_in_order_and_at_once(spark):
    class Slow(OfflineProvider):
        def __getstate__(self):
            return {"dimension": self.dimension}

        def embed(self, texts, kind):
            import time

            time.sleep(0.05 if "0" in texts[0] else 0)
            return super().embed(texts, kind)

    rows = [(f"d{k}", 0, 0, 3, f"t {k}") for k in range(23)]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_index int, start_offset int, end_offset int, text string").repartition(2)
    for concurrency in (1, 4):
        got = embedding.embed_chunks(chunks, Slow(), EmbedOptions(5, concurrency=concurrency)).collect()
        sizes = {}
        for r in got:
            sizes[r["batch_index"]] = sizes.get(r["batch_index"], 0) + 1
            assert r["is_success"] and r["embedding"] == pytest.approx(OfflineProvider().embed([r["text"]], "document")[0])
        assert len(got) == 23 and max(sizes.values()) == 5 and len({b >> 33 for b in sizes}) == 2
    done = embedding.progress(embedding.embed_chunks(chunks, Slow(), EmbedOptions(5))).orderBy("batch_index").collect()
    assert done[-1]["completed_batches"] == len(done) and done[-1]["total_chunks"] == 23 and done[-1]["failed_batches"] == 0
    budget = embedding.embed_chunks(chunks.coalesce(1), OfflineProvider(), EmbedOptions(10, max_tokens=3)).groupBy("batch_index").agg(F.sum((F.length("text") / 4).cast("int")).alias("t")).collect()
    assert max(r["t"] for r in budget) == 3


def scripted():
    """Answers by what it is asked for; a class of its own here, as workers don't know this module."""

    class Scripted(OfflineProvider):
        def chat(self, messages, temperature=None):
            system, user = messages[0][1], messages[-1][1]
            if "stands alone" in system:
                return "stars and planets" if "astronomy" in user else ""
            if "queries" in system:
                return "planets\nPLANETS\ncats"
            return "It is «cite:0»so«/cite»."

    return Scripted()


def test_transformers_in_turn(spark):
    from ragloom.operators import grounding

    asked = spark.createDataFrame([(1, "stars"), (2, "dogs")], "query_id int, query string")
    step = grounding.transformer(scripted(), "Give queries", grounding.expanded(3))
    got = grounding.transform_in_turn(asked, [step, step]).orderBy("query_id", "position").collect()
    assert [(r["query_id"], r["position"], r["query"]) for r in got] == [(1, 0, "stars"), (1, 1, "planets"), (1, 2, "cats"), (2, 0, "dogs"), (2, 1, "planets"), (2, 2, "cats")]
    several = grounding.transform_queries(asked, scripted(), "x", grounding.hypothetical(True), calls=2).where("query_id = 1").collect()
    assert [r["query"] for r in several] == ["stars", "It is «cite:0»so«/cite»."]

    class Broken(OfflineProvider):
        def chat(self, messages, temperature=None):
            raise RuntimeError("no model")

    with pytest.raises(Exception, match="no model"):
        grounding.transform_queries(asked, Broken(), "x", grounding.rewritten).collect()
    history = spark.createDataFrame([(1, 0, "user", "astronomy")], "query_id int, turn int, role string, text string")
    assert {r["query_id"]: r["rewritten_query"] for r in grounding.rewrite_with_history(asked, history, scripted()).collect()} == {1: "stars and planets", 2: None}
    assert {r["query_id"]: r["rewritten_query"] for r in grounding.rewrite_with_history(asked, history, Broken()).collect()} == {1: "stars", 2: None}


def test_converse(spark):
    from ragloom.operators import grounding

    chunks = rag.ingest(docs(spark, "cats and dogs", "stars and planets", "rivers and lakes"), OfflineProvider())
    asked = spark.createDataFrame([(1, "tell me more"), (2, "cats")], "query_id int, query string")
    history = spark.createDataFrame([(1, 0, "user", "astronomy please")], "query_id int, turn int, role string, text string")
    find = rag.vector_retriever(chunks, OfflineProvider())
    got = {r["query_id"]: r for r in rag.converse(asked, [find], scripted(), rag.AskOptions(1), history).collect()}
    assert got[1]["rewritten_query"] == "stars and planets" and got[1]["chunks"][0]["document_id"] == "d1" and got[1]["chunks"][0]["score"] == pytest.approx(1)
    assert got[2]["rewritten_query"] is None and got[2]["chunks"][0]["document_id"] == "d0" and got[2]["search_queries"] == ["cats"]
    assert got[1]["answer"] == "It is so." and got[1]["citations"][0]["doc_index"] == 0 and got[1]["error_message"] is None
    step = grounding.transformer(scripted(), "Give queries", grounding.expanded(3))
    fused = {r["query_id"]: r for r in rag.converse(asked, [find, find], scripted(), rag.AskOptions(2, rag.RetrievalOptions(1), rerank=True), transformers=[step]).collect()}
    assert fused[2]["search_queries"] == ["cats", "planets"] and {c["document_id"] for c in fused[2]["chunks"]} == {"d0", "d1"}

    def picky(queries, options):
        if options.provider_query:
            raise ValueError("unknown extension")
        return find(queries, options)

    knows = lambda queries, options: find(queries, RetrievalOptions(options.top_k))
    own = rag.AskOptions(retrieval=RetrievalOptions(1, provider_query="x"))
    assert rag.converse(asked, [picky, knows], scripted(), own, chat=False).count() == 2
    with pytest.raises(ValueError, match="unknown extension"):
        rag.converse(asked, [picky], scripted(), own)
    nothing = rag.converse(asked, [rag.vector_retriever(chunks, OfflineProvider())], scripted(), rag.AskOptions(retrieval=RetrievalOptions(1, 2.0))).collect()
    assert all(r["chunks"] == [] and r["n_dropped"] == 0 for r in nothing)


def test_token_counters(spark):
    import public_tokenizers

    from ragloom.functions.tokens import LocalCounter, RemoteCounter, token_count

    local = LocalCounter(public_tokenizers.path("byte_bpe_50k.json"))
    text = "Some words, and then some more of them. " * 8
    n = local.count(text)
    assert local.index_from_start(text, n) == len(text) and local.index_from_end(text, n) == 0 and local.index_from_end(text, 0) == len(text)
    assert local.count(text[: local.index_from_start(text, 5)]) == 5
    spans = chunking.recursive_spans(text, local.chunk_options(20, 4))
    assert spans[-1][1] == len(text) and all(local.count(text[a:b]) <= 21 for a, b in spans) and len(spans) > 3
    remote = RemoteCounter(lambda t: len(t.split()), 30)
    assert remote.count(text) == 64
    got = spark.createDataFrame([("one two",), (None,)], "t string").select(token_count(F.col("t"), remote).alias("n")).collect()
    assert [r["n"] for r in got] == [2, None]


def test_http_provider():
    import base64
    import json
    import pickle
    import struct
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from ragloom import providers, providers_http

    seen = []

    class Service(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            bad = body["model"] == "bad"
            flaky = body["model"] == "flaky" and sum(b["model"] == "flaky" for b in seen) < 3
            self.send_response(400 if bad else 503 if flaky else 200)
            self.end_headers()
            if self.path.endswith("/embeddings"):
                vector = base64.b64encode(struct.pack("<2f", 1, 2)).decode() if body["encoding_format"] == "base64" else [1.0, 2.0]
                out = {"data": [{"index": k, "embedding": vector} for k in range(len(body["input"]))]}
            elif self.path.endswith("/rerank"):
                out = {"results": [{"index": 1, "relevance_score": 0.5}]}
            else:
                out = {"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}]}
            self.wfile.write(json.dumps(out).encode())

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, quick = f"http://127.0.0.1:{server.server_port}", providers_http.Resilience(delay=0.01)
    models = {"embed": "flaky", "rerank": "r", "chat": "c"}
    for encoding in ("float", "base64"):
        provider = pickle.loads(pickle.dumps(providers.create("http", base_url=url, models=models, encoding=encoding, rules=quick)))
        assert provider.embed(["a", "b"], "document") == [[1.0, 2.0]] * 2
    assert provider.rerank("q", ["a", "b"]) == [(1, 0.5)] and provider.chat([("user", "hi")]) == "HI"
    assert providers.has(provider, "chat") and not providers.has(providers_http.HttpProvider(url, {}), "chat")
    bad = providers_http.HttpProvider(url, {"chat": "bad"}, rules=quick)
    before = len(seen)
    with pytest.raises(RuntimeError, match="HTTP 400"):
        bad.chat([("user", "x")])
    assert len(seen) == before + 1
    server.shutdown()
    server.server_close()
    gone = providers_http.HttpProvider(url, {"chat": "c"}, rules=providers_http.Resilience(retries=0, delay=0.01, least_calls=3))
    for _ in range(3):
        with pytest.raises(RuntimeError, match="unavailable"):
            gone.chat([("user", "x")])
    with pytest.raises(providers_http.CircuitOpen):
        gone.chat([("user", "x")])
    with pytest.raises(ValueError):
        providers.create("no such")
    states = iter(["in_progress", "completed"])
    assert providers.wait_until_processed(lambda: next(states), interval=0.01) == "completed"
    with pytest.raises(TimeoutError):
        providers.wait_until_processed(lambda: "in_progress", 0.02, 0.01)


def test_stores_and_sources(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.txt").write_text(folder)
    got = stores.text_files(spark, f"{tmp_path}/*/same.txt").collect()
    assert len({r["document_id"] for r in got}) == 2 and {r["text"] for r in got} == {"a", "b"}
    spark.sql("CREATE DATABASE IF NOT EXISTS ragloom_test")
    spark.catalog.setCurrentDatabase("ragloom_test")
    try:
        store = stores.VectorStore(spark, "store_of_test")
        store.drop()
        assert not store.exists()
        rows = spark.createDataFrame([(f"d{k % 3}", k) for k in range(9)], "document_id string, chunk_index int")
        store.add(rows)
        store.add(rows)
        assert store.exists() and store.count() == 18 and store.file("d1").count() == 6 and "store_of_test" in stores.VectorStore.names(spark)
        assert [r["document_id"] for r in store.files("d0", 5).collect()] == ["d1", "d2"]
        store.delete_files(["d1"])
        assert store.count() == 12 and store.file("d1").count() == 0
        store.drop()
    finally:
        spark.catalog.setCurrentDatabase("default")
        spark.sql("DROP DATABASE IF EXISTS ragloom_test CASCADE")


def test_cited_documents(spark):
    from ragloom.functions.python_columns import citations
    from ragloom.operators import grounding

    cited = spark.createDataFrame([(1, "«cite:1»x«/cite» y")], "query_id int, t string").select("query_id", citations(F.col("t"), F.lit(2)).alias("c")).select("query_id", "c.citations")
    documents = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "query_id int, position int, document_id string")
    assert [(r["cited"], r["document_id"]) for r in grounding.cited_documents(cited, documents).collect()] == [("x", "b")]
    modes = spark.createDataFrame([("Accurate", "command-a-03"), ("accurate", "command-r"), ("fast", None), ("SearchResult", "x")], "mode string, model string")
    assert [r[0] for r in modes.select(grounding.citation_mode(F.col("mode"), F.col("model"))).collect()] == ["FAST", "ACCURATE", "FAST", "ENABLED"]


def test_streamed_answers(spark, tmp_path):
    from ragloom.streaming.answers import ask_stream, assemble_stream, file_stream

    def lines(name, rows):
        spark.createDataFrame(rows, "request_id string, seq int, line string").coalesce(1).write.mode("append").json(str(tmp_path / "lines"))

    def run():
        stream = file_stream(spark, str(tmp_path / "lines"), "request_id string, seq int, line string", max_files=1)
        query = assemble_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "answers")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    lines(1, [("a", 1, 'data: {"delta":"lo"}'), ("b", 0, 'data: {"delta":"half"}')])
    run()
    lines(2, [("a", 2, "data: [DONE]"), ("a", 0, 'data: {"delta":"Hel"}')])
    run()
    assert [(r["request_id"], r["answer"], r["finished"]) for r in spark.read.parquet(str(tmp_path / "answers")).collect()] == [("a", "Hello", True)]
    chunks = rag.ingest(docs(spark, "cats and dogs", "stars and planets"), OfflineProvider())
    chunks.write.parquet(str(tmp_path / "chunks"))
    spark.createDataFrame([(1, "planets")], "query_id int, query string").write.json(str(tmp_path / "asked"))
    find = rag.vector_retriever(spark.read.parquet(str(tmp_path / "chunks")), OfflineProvider())
    ask_stream(file_stream(spark, str(tmp_path / "asked"), "query_id int, query string"), [find], OfflineProvider(), str(tmp_path / "out"), str(tmp_path / "check"), rag.AskOptions(1)).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0]["chunks"][0]["document_id"] == "d1"
