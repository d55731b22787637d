"""Queries over the driver's tables, one for each operator, and the SQL that DuckDB runs for the same rows.

Searches take as queries every row whose id is divisible by 50, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import chunking, embedding, grounding, retrieval
from .options import ChunkOptions, EmbedOptions, PackingOptions, RetrievalOptions, SemanticOptions
from .plans import rag
from .providers import OfflineProvider
from .sources import stores

Query = Callable[[SparkSession, str], DataFrame]
K, EVERY = 10, 50
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))


def _query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0)
    return vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("query_label"))


_SUM = "list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE))"
_DOT = "list_sum(list_transform(generate_series(1, len(e.embedding)), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))"
_SCORED = f"""scored AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id, e.label,
    (CASE WHEN {_SUM.format('e.embedding')} = 0 OR {_SUM.format('q.embedding')} = 0 THEN 0 ELSE {_DOT} / (sqrt({_SUM.format('e.embedding')}) * sqrt({_SUM.format('q.embedding')})) END)::FLOAT::DOUBLE AS score
  FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0)"""
_RANKED = f"{_SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)"


@query(f"SELECT q.vec_id AS query_id, e.vec_id, round(({_DOT})::FLOAT::DOUBLE, 6) AS dot FROM embeddings e, embeddings q WHERE q.vec_id % {EVERY} = 0")
def vector_dot(spark, sf_dir):
    items = _table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(_query_vectors(spark, sf_dir)))
    return items.select("query_id", "vec_id", F.round(C.dot(F.col("embedding"), F.col("query_vector")).cast("double"), 6).alias("dot"))


@query(f"WITH {_RANKED} SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM ranked WHERE rank <= {K}")
def vector_cosine_topk(spark, sf_dir):
    found = retrieval.retrieve(_query_vectors(spark, sf_dir), _items(spark, sf_dir), ["vec_id"], RetrievalOptions(K))
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, unnest(generate_series(0, len(embedding) - 1))::INTEGER AS place, unnest(list_transform(embedding, lambda x: round((CASE WHEN {_SUM.format('embedding')} = 0 THEN x ELSE (x::DOUBLE / sqrt({_SUM.format('embedding')}))::FLOAT END)::DOUBLE, 5) + 0.0)) AS unit FROM embeddings")
def vector_normalize(spark, sf_dir):
    units = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(C.normalize(F.col("embedding"))).alias("place", "x"))
    return units.select("vec_id", "place", (F.round(F.col("x").cast("double"), 5) + 0.0).alias("unit"))


@query(f"WITH {_SCORED}, kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE label = 1 AND score >= 0.05) SELECT query_id, rank::INTEGER AS rank, vec_id, round(score, 6) AS score FROM kept WHERE rank <= {K}")
def retrieve_metadata_minscore_topk(spark, sf_dir):
    options = RetrievalOptions(K, 0.05, {"label": "1"})
    return retrieval.retrieve(_query_vectors(spark, sf_dir), _items(spark, sf_dir), ["vec_id"], options).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _two_lists(spark, sf_dir):
    """The nearest by cosine, and the nearest of the query's own label, whose items repeat those of the first."""
    queries, items = _query_vectors(spark, sf_dir), _items(spark, sf_dir)
    first = retrieval.retrieve(queries, items, ["vec_id", "label"], RetrievalOptions(None)).join(F.broadcast(queries.select("query_id", "query_label")), "query_id")
    near = first.where(F.col("rank") <= K).select("query_id", F.lit(0).alias("list_id"), "rank", "vec_id")
    own = retrieval.top_k(first.where("label = query_label").drop("rank"), K, ["vec_id"]).select("query_id", F.lit(1).alias("list_id"), "rank", "vec_id")
    return near.unionByName(own)


_LISTS = f"""{_RANKED}, own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS own_rank FROM scored WHERE label = query_label),
lists AS (SELECT query_id, 0 AS list_id, rank, vec_id FROM ranked WHERE rank <= {K} UNION ALL SELECT query_id, 1, own_rank, vec_id FROM own WHERE own_rank <= {K})"""


@query(f"WITH {_LISTS}, fused AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, list_id, vec_id, min(rank) AS rank FROM lists GROUP BY ALL) GROUP BY ALL) SELECT query_id, vec_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM fused")
def rrf_fuse(spark, sf_dir):
    return retrieval.reciprocal_rank_fusion(_two_lists(spark, sf_dir), ["vec_id"]).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_RANKED}, relevant AS (SELECT query_id, vec_id FROM scored WHERE label = query_label), n AS (SELECT query_id, count(*) AS n_relevant FROM relevant GROUP BY 1),
hits AS (SELECT r.query_id, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first_hit, count(*) FILTER (rank <= 5) AS in_k FROM ranked r JOIN relevant v ON r.query_id = v.query_id AND r.vec_id = v.vec_id WHERE rank <= {K} GROUP BY 1)
SELECT n.query_id, round(coalesce(dcg / list_sum(list_transform(generate_series(1, least(n_relevant, (SELECT count(*) FROM ranked x WHERE x.query_id = n.query_id AND rank <= {K}))), lambda i: 1 / log2(i + 1))), 0), 6) AS ndcg, round(coalesce(1.0::DOUBLE / first_hit, 0), 6) AS reciprocal_rank, round(coalesce(in_k::DOUBLE / n_relevant, 0), 6) AS recall_at_k FROM n LEFT JOIN hits USING (query_id)""")
def metric_ranking(spark, sf_dir):
    queries, items = _query_vectors(spark, sf_dir), _items(spark, sf_dir)
    found = retrieval.retrieve(queries, items, ["vec_id"], RetrievalOptions(K)).select("query_id", "rank", F.col("vec_id").cast("string").alias("item"))
    relevant = items.join(F.broadcast(queries), F.col("label") == F.col("query_label")).select("query_id", F.col("vec_id").cast("string").alias("item"))
    return retrieval.ranking_metrics(found, relevant, 5)


@query("""SELECT doc_id::VARCHAR AS document_id, (k - 1)::INTEGER AS chunk_index, md5(substring(text, b + 1, 1024)) AS chunk_md5, b::INTEGER AS start_offset, (b + length(substring(text, b + 1, 1024)))::INTEGER AS end_offset
FROM (SELECT doc_id, text, unnest(starts) AS b, unnest(generate_series(1, len(starts))) AS k FROM (SELECT doc_id, text, list_filter(generate_series(0, length(text) - 1, 896), lambda x: x = 0 OR x - 896 + 1024 < length(text)) AS starts FROM documents WHERE length(text) > 0))""")
def chunk_fixed_size(spark, sf_dir):
    chunks = chunking.fixed_chunks(stores.documents(_table(spark, sf_dir, "documents")))
    return chunks.select("document_id", "chunk_index", "start_offset", "end_offset", F.md5("text").alias("chunk_md5"))


_WHITE = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"SELECT doc_id, unnest(s) AS sentence, unnest(generate_series(0, len(s) - 1))::INTEGER AS position FROM (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]){_WHITE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '[^\\t\\n\\v\\f\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')) AS s FROM documents)")
def sentence_split(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("position", "sentence"))


@query("SELECT doc_id, length(text)::INTEGER AS utf16_length, (length(text) // 4)::INTEGER AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", C.utf16_length(F.col("text")).alias("utf16_length"), C.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT source, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 32)::BIGINT AS batch_index FROM documents")
def batch_by_items(spark, sf_dir):
    return embedding.item_batches(_table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


_TURNS = "turns AS (SELECT conv_id, turn, (length(text) // 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)"


@query(f"""WITH RECURSIVE {_TURNS}, walk AS (SELECT conv_id, turn, tokens, k, 0::BIGINT AS batch_index, tokens AS used, 1 AS n FROM turns WHERE k = 1
UNION ALL SELECT t.conv_id, t.turn, t.tokens, t.k, w.batch_index + (CASE WHEN w.used + t.tokens > 60 OR w.n >= 3 THEN 1 ELSE 0 END), CASE WHEN w.used + t.tokens > 60 OR w.n >= 3 THEN t.tokens ELSE w.used + t.tokens END, CASE WHEN w.used + t.tokens > 60 OR w.n >= 3 THEN 1 ELSE w.n + 1 END FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.k = w.k + 1)
SELECT conv_id, turn, batch_index FROM walk""")
def batch_by_token_budget(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", C.token_estimate(F.col("text")).alias("tokens"))
    return embedding.token_batches(turns, ["conv_id"], ["turn"], "tokens", 60, 3).select("conv_id", "turn", "batch_index")


def _pack_sql(stop: bool) -> str:
    fits = f"(NOT w.stop AND t.tokens <= 100 AND w.used + t.tokens + (CASE WHEN w.n > 0 AND t.total > 1 THEN 2 ELSE 0 END) <= 100)"
    return f"""WITH RECURSIVE {_TURNS}, walk AS (
SELECT conv_id, 0::BIGINT AS k, NULL::BIGINT AS turn, 0::BIGINT AS used, 0 AS n, false AS stop, NULL::VARCHAR AS decision FROM (SELECT DISTINCT conv_id FROM turns)
UNION ALL SELECT t.conv_id, t.k, t.turn, w.used + (CASE WHEN {fits} THEN t.tokens + (CASE WHEN w.n > 0 AND t.total > 1 THEN 2 ELSE 0 END) ELSE 0 END), w.n + (CASE WHEN {fits} THEN 1 ELSE 0 END), w.stop OR ({str(stop).lower()} AND NOT {fits} AND t.tokens <= 100), CASE WHEN {fits} THEN 'selected' WHEN t.tokens > 100 THEN 'IndividuallyOversized' ELSE 'BudgetExhausted' END
FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.k = w.k + 1),
placed AS (SELECT *, sum(CASE WHEN decision = 'selected' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) - 1 AS i, max(n) OVER (PARTITION BY conv_id) AS total, max(used) OVER (PARTITION BY conv_id) AS all_used FROM walk WHERE k > 0)
SELECT conv_id AS query_id, k::INTEGER AS rank, all_used AS tokens_used, CASE WHEN decision = 'selected' THEN 'selected' ELSE 'dropped' END AS status, CASE WHEN decision <> 'selected' THEN decision END AS drop_reason,
(CASE WHEN decision = 'selected' THEN CASE WHEN total <= 2 THEN i WHEN i % 2 = 0 THEN i // 2 ELSE total - 1 - i // 2 END END)::INTEGER AS pack_position FROM placed"""


def _packed(spark, sf_dir, stop):
    from pyspark.sql import Window

    turns = _table(spark, sf_dir, "conversations")
    ranked = turns.select(F.col("conv_id").alias("query_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"), C.token_estimate(F.col("text")).alias("token_count"))
    return retrieval.pack(ranked, PackingOptions(budget=120, reserved=20, separator_tokens=2, stop_at_misfit=stop)).select("query_id", "rank", "tokens_used", "status", "drop_reason", "pack_position")


@query(_pack_sql(False))
def pack_skip(spark, sf_dir):
    return _packed(spark, sf_dir, False)


@query(_pack_sql(True))
def pack_stop(spark, sf_dir):
    return _packed(spark, sf_dir, True)


@query("SELECT conv_id, turn, (CASE WHEN n <= 2 THEN i WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - i // 2 END)::INTEGER AS place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def lost_in_middle_order(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("conv_id")
    ranked = _table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(by.orderBy("turn")) - 1).alias("i"), F.count("*").over(by).cast("int").alias("n"))
    return ranked.select("conv_id", "turn", C.lost_in_middle(F.col("i"), F.col("n")).alias("place"))


@query("SELECT query_id, position, query FROM (SELECT conv_id AS query_id, turn AS position, role AS query, row_number() OVER (PARTITION BY conv_id, upper(role) ORDER BY turn) AS k FROM conversations WHERE trim(role) <> '') WHERE k = 1")
def query_dedupe_nocase(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return retrieval.distinct_queries(turns.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("position"), F.col("role").alias("query")))


@query("SELECT conv_id, md5(string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn) || chr(10)) AS history_md5 FROM conversations GROUP BY 1")
def conversation_history(spark, sf_dir):
    return grounding.conversation_history(_table(spark, sf_dir, "conversations")).select("conv_id", F.md5("history").alias("history_md5"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN trim(text) WHEN 1 THEN trim(text) || chr(10) || '``` not the last' WHEN 2 THEN ' ' || text || ' ' ELSE '```' || replace(text, chr(10), ' ') END AS inside FROM benchmark")
def strip_code_fences(spark, sf_dir):
    """Fenced; with a fence inside and words after the last; bare, which stays as it is; with a fence but no line end."""
    fenced = F.expr("CASE item_id % 4 WHEN 0 THEN '```json\\n' || text || '\\n```\\n' WHEN 1 THEN ' ```\\n' || text || '\\n``` not the last\\n``` and more' WHEN 2 THEN ' ' || text || ' ' ELSE '```' || replace(text, '\\n', ' ') END")
    return _table(spark, sf_dir, "benchmark").select("item_id", C.strip_code_fence(fenced).alias("inside"))


#: Messages with codes, glued and of other lengths too, and with phrases that tell of a passing error or only seem to.
_MESSAGE = "CASE event_id % 9 WHEN 0 THEN 'HTTP ' || (400 + event_id % 200) || ' for ' || event_type WHEN 1 THEN 'model embed-' || (495 + event_id % 10) || 'd' WHEN 2 THEN 'code 5000' WHEN 3 THEN 'Rate limit reached' WHEN 4 THEN 'Request was throttled' WHEN 5 THEN 'connection timed out, temporarily' WHEN 6 THEN 'Bad Gateway' WHEN 7 THEN 'the Internal Server Error page' ELSE 'resource unavailable' END"


@query("SELECT event_id, regexp_matches(message, '(^|[^0-9A-Za-z])(429|5[0-9][0-9])($|[^0-9A-Za-z])') OR regexp_matches(lower(message), 'rate limit|too many requests|throttl|internal server error|service unavailable|bad gateway|gateway timeout') AS transient FROM (SELECT event_id, {_MESSAGE} AS message FROM events)".replace("{_MESSAGE}", _MESSAGE))
def transient_classifier(spark, sf_dir):
    message = F.expr(_MESSAGE)
    return _table(spark, sf_dir, "events").select("event_id", C.is_transient(message).alias("transient"))


@query("SELECT page_id, (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1)::INTEGER AS chunk_index FROM (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host FROM pages)")
def hosted_passage_ordinal(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("host"))
    return stores.passage_ordinals(pages, "host", ["page_id"]).select("page_id", "chunk_index")


@query("SELECT item_id, 'data:text/plain;base64,' || base64(encode(text)) AS uri FROM benchmark")
def document_data_uri(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", C.text_data_uri(F.col("text")).alias("uri"))


@query("SELECT conv_id AS request_id, md5(string_agg(text, '' ORDER BY turn)) AS answer_md5 FROM conversations GROUP BY 1")
def stream_assembly(spark, sf_dir):
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.col("text").alias("delta"))))
    lines = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), line.alias("line"))
    return stores.assemble_answers(stores.sse_data(lines)).select("request_id", F.md5("answer").alias("answer_md5"))


@query()
def chunk_recursive(spark, sf_dir):
    return chunking.recursive_chunks(stores.documents(_table(spark, sf_dir, "documents")), ChunkOptions())


@query()
def chunk_semantic(spark, sf_dir):
    return chunking.semantic_chunks(stores.documents(_table(spark, sf_dir, "documents")), OfflineProvider(), SemanticOptions(max_chars=1 << 20))


@query("""SELECT event_id, event_type, value, coalesce(len(json_keys(props)), 0)::INTEGER + 2 - (CASE WHEN json_exists(props, '$.meta') THEN 1 ELSE 0 END) - (CASE WHEN json_exists(props, '$.value') THEN 1 ELSE 0 END) AS n_keys FROM events""")
def json_deep_merge(spark, sf_dir):
    """What the merged objects hold: both sides' keys, those of the second over the first."""
    from .functions.python_columns import json_deep_merge as merge

    extra = F.to_json(F.struct(F.struct(F.col("event_type")).alias("meta"), F.col("value")))
    merged = _table(spark, sf_dir, "events").select("event_id", merge(F.col("props"), extra).alias("m"))
    return merged.select("event_id", F.get_json_object("m", "$.meta.event_type").alias("event_type"), F.get_json_object("m", "$.value").cast("double").alias("value"), F.json_object_keys("m").alias("k")).select("event_id", "event_type", "value", F.size("k").alias("n_keys"))


@query("""SELECT item_id, text || ' and more' AS clean, 1 AS n, 0 AS start_offset, length(text)::INTEGER AS end_offset, text AS cited, 0 AS doc_index FROM benchmark""")
def citation_markers(spark, sf_dir):
    from .functions.python_columns import citations

    marked = F.concat(F.lit("«cite:0»"), F.col("text"), F.lit("«/cite» and «cite:9»more«/cite»"))
    return _table(spark, sf_dir, "benchmark").select("item_id", citations(marked, F.lit(1)).alias("c")).select("item_id", "c.clean", F.size("c.citations").alias("n"), F.col("c.citations")[0]["start"].alias("start_offset"), F.col("c.citations")[0]["end"].alias("end_offset"), F.col("c.citations")[0]["text"].alias("cited"), F.col("c.citations")[0]["doc_index"].alias("doc_index"))


@query()
def ingest_offline(spark, sf_dir):
    return rag.ingest(stores.documents(_table(spark, sf_dir, "documents")), OfflineProvider(), ChunkOptions(), EmbedOptions())


@query()
def ask_offline(spark, sf_dir):
    chunks = rag.ingest(stores.documents(_table(spark, sf_dir, "documents")), OfflineProvider())
    questions = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return rag.ask(questions, chunks, OfflineProvider(), RetrievalOptions(5), PackingOptions(1024))


@query("""WITH a AS (SELECT item_id AS query_id, text, array_to_string(list_slice(string_split_regex(trim(text), '\\s+'), 1, 40), ' ') AS answer FROM benchmark)
SELECT query_id, 0 AS position, text AS query FROM a UNION ALL SELECT query_id, 1, answer FROM a WHERE answer <> text AND trim(answer) <> ''""")
def query_expansion(spark, sf_dir):
    questions = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return grounding.transform_queries(questions, OfflineProvider(), "Give search queries, one a line.", grounding.expanded(3), 0.7)


@query()
def rerank_offline(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    ranked = turns.select(F.col("conv_id").alias("query_id"), F.lit("the of and").alias("query"), F.col("turn").cast("int").alias("rank"), "text")
    return retrieval.rerank(ranked, OfflineProvider()).select("query_id", "rank", "rerank_pos", "relevance")


@query("SELECT conv_id AS request_id, turn AS seq, coalesce(sum(length(text) + 3) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start_offset, (sum(length(text) + 3) OVER (PARTITION BY conv_id ORDER BY turn))::INTEGER AS end_offset FROM conversations")
def block_offsets(spark, sf_dir):
    """Each block ends in a space and a character beyond the basic plane, which is two units."""
    blocks = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"), F.concat("text", F.lit(" 😀")).alias("text"))
    return grounding.block_offsets(blocks).drop("text")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE '\"' || event_type || '\"' END AS arguments FROM events")
def tool_arguments(spark, sf_dir):
    given = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", C.tool_arguments(given).alias("arguments"))


@query(f"""WITH {_LISTS}, every AS (SELECT * FROM lists WHERE list_id = 0 OR query_id % 100 = 0), n AS (SELECT query_id, count(DISTINCT list_id) AS n FROM every GROUP BY 1),
fused AS (SELECT query_id, vec_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM every GROUP BY ALL)
SELECT query_id, vec_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM fused JOIN n USING (query_id) WHERE n > 1
UNION ALL SELECT query_id, vec_id, round(score, 6), rank::INTEGER FROM ranked JOIN n USING (query_id) WHERE n = 1 AND rank <= {K}""")
def union_of_retrievers(spark, sf_dir):
    """Half of the questions have two lists, which are fused; the others one, which keeps its scores."""
    queries, items = _query_vectors(spark, sf_dir), _items(spark, sf_dir)
    near = retrieval.retrieve(queries, items, ["vec_id"], RetrievalOptions(K)).withColumn("list_id", F.lit(0))
    second = _two_lists(spark, sf_dir).where("list_id = 1 AND query_id % 100 = 0").withColumn("score", F.lit(0.0))
    found = retrieval.union_lists([near, second.select(*near.columns)], ["vec_id"])
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("SELECT conv_id AS query_id, turn, role, CASE WHEN k = 1 AND role = 'system' THEN text || chr(10) || chr(10) || 'ctx ' || conv_id ELSE text END AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) UNION ALL SELECT conv_id, min(turn) - 1, 'system', 'ctx ' || conv_id FROM conversations GROUP BY 1 HAVING count(*) FILTER (role = 'system') = 0")
def grounding_messages(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), "turn", "role", "text")
    contexts = turns.select("query_id").distinct().select("query_id", F.concat(F.lit("ctx "), F.col("query_id").cast("string")).alias("context"))
    return grounding.grounded_messages(turns, contexts)


@query("""SELECT conv_id AS query_id, CASE WHEN turn % 2 = 0 AND length(text) >= 5 THEN 1 ELSE 0 END AS start_offset, CASE WHEN turn % 2 = 0 AND length(text) >= 5 THEN 5 ELSE 0 END AS end_offset, CASE WHEN turn % 2 = 0 AND length(text) >= 5 THEN substr(text, 2, 4) ELSE '' END AS cited,
CASE turn % 3 WHEN 0 THEN 'doc_a' WHEN 1 THEN 'doc_b' ELSE 'elsewhere' END AS document_id FROM conversations""")
def annotation_citations(spark, sf_dir):
    """By index, by the file's name in another case, and not at all; every other range is out of bounds."""
    turns = _table(spark, sf_dir, "conversations")
    pick = lambda a, b, c: F.when(F.col("turn") % 3 == 0, a).when(F.col("turn") % 3 == 1, b).otherwise(c)
    none = F.lit(None)
    notes = turns.select(F.col("conv_id").alias("query_id"), F.col("text").alias("content"), F.lit("file_citation").alias("type"), pick(none, none, F.lit("elsewhere")).cast("string").alias("file_id"), pick(none, F.lit("DOC_B"), none).cast("string").alias("filename"), pick(F.lit(0), none, F.lit(7)).cast("int").alias("doc_index"), F.lit(1).alias("start_index"), F.when(F.col("turn") % 2 == 0, 5).otherwise(1).alias("end_index"))
    docs = turns.select(F.col("conv_id").alias("query_id")).distinct().select("query_id", F.posexplode(F.array(F.lit("doc_a"), F.lit("doc_b"))).alias("position", "id"))
    return grounding.annotation_citations(notes, docs).withColumnsRenamed({"start": "start_offset", "end": "end_offset"})


@query()
def converse_offline(spark, sf_dir):
    """Benchmark questions through two retrievers, with expansion, reranking, packing and a call each."""
    provider = OfflineProvider()
    chunks = rag.ingest(stores.documents(_table(spark, sf_dir, "documents")), provider)
    questions = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    find = rag.vector_retriever(chunks, provider)
    steps = [grounding.transformer(provider, "Give search queries, one a line.", grounding.expanded(2))]
    return rag.converse(questions, [find, find], provider, rag.AskOptions(5, rerank=True, rerank_top=3, packing=PackingOptions(1024)), transformers=steps)


_COVER = "SELECT doc_id::VARCHAR AS document_id, 0 AS first, length(text)::INTEGER AS last, true AS joined, true AS within FROM documents WHERE length(text) > 0"


def _covers(chunks: DataFrame, size: int) -> DataFrame:
    """Of each document: where its chunks begin and end, whether they leave no gap, are numbered in turn, and keep to the size."""
    own = F.array_sort(F.collect_list(F.struct("chunk_index", "start_offset", "end_offset")))
    grouped = chunks.groupBy("document_id").agg(own.alias("c"), F.max(C.utf16_length(F.col("text"))).alias("most"), F.min((C.utf16_length(F.col("text")) == F.col("end_offset") - F.col("start_offset")).cast("int")).alias("exact"))
    meet = F.forall(F.sequence(F.lit(0), F.size("c") - 1), lambda k: (F.get("c", k)["chunk_index"] == k) & ((k == 0) | (F.get("c", k)["start_offset"] <= F.get("c", k - 1)["end_offset"])))
    return grouped.select("document_id", F.get("c", F.lit(0))["start_offset"].alias("first"), F.element_at("c", -1)["end_offset"].alias("last"), (meet & (F.col("exact") == 1)).alias("joined"), (F.col("most") <= size).alias("within"))


@query(_COVER)
def chunk_recursive_cover(spark, sf_dir):
    return _covers(chunk_recursive(spark, sf_dir), 1024)


@query(_COVER + " AND regexp_matches(text, '[^ \\t-\\r]')")
def chunk_semantic_cover(spark, sf_dir):
    return _covers(chunk_semantic(spark, sf_dir), 1 << 20)


@query("SELECT page_id % 50 AS query_id, 'f' || (page_id % 7) AS document_id, (row_number() OVER (PARTITION BY page_id % 50, page_id % 7 ORDER BY page_id) - 1)::INTEGER AS chunk_index, length(url)::INTEGER AS end_offset, (row_number() OVER (PARTITION BY page_id % 50 ORDER BY (page_id % 13)::DOUBLE / 13 DESC, page_id))::INTEGER AS rank, 'u' || (page_id % 3) AS kind FROM pages WHERE page_id % 11 <> 0")
def file_search_results(spark, sf_dir):
    """Pages stand for passages, a call each; some calls didn't complete."""
    passage = F.struct(F.concat(F.lit("f"), (F.col("page_id") % 7).cast("string")).alias("file_id"), F.lit("n").alias("filename"), F.col("url").alias("text"), ((F.col("page_id") % 13) / 13).alias("score"), F.create_map(F.lit("kind"), F.concat(F.lit("u"), (F.col("page_id") % 3).cast("string"))).alias("attributes"))
    calls = _table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("query_id"), F.col("page_id").alias("call"), F.when(F.col("page_id") % 11 == 0, "failed").otherwise("completed").alias("status"), F.array(passage).alias("results"))
    return stores.file_search_results(calls).select("query_id", "document_id", "chunk_index", "end_offset", "rank", F.element_at("metadata", "kind").alias("kind"))


@query("SELECT conv_id AS query_id, CASE WHEN turn % 2 = 0 AND length(text) >= 4 THEN 2 ELSE 0 END AS start_offset, CASE WHEN turn % 2 = 0 AND length(text) >= 4 THEN 4 ELSE 0 END AS end_offset, CASE WHEN turn % 2 = 0 AND length(text) >= 4 THEN substr(text, 3, 2) ELSE '' END AS cited, 'https://' || role AS source_id, role AS title FROM conversations WHERE turn % 3 <> 0")
def web_citations(spark, sf_dir):
    notes = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("text").alias("content"), F.when(F.col("turn") % 3 == 0, "file_citation").otherwise("url_citation").alias("type"), F.concat(F.lit("https://"), "role").alias("url"), F.col("role").alias("title"), F.lit(2).alias("start_index"), F.when(F.col("turn") % 2 == 0, 4).otherwise(1 << 30).alias("end_index"))
    return grounding.web_citations(notes).withColumnsRenamed({"start": "start_offset", "end": "end_offset"})


@query("SELECT event_id, event_type, user_id::VARCHAR AS user_id, CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END AS even, CASE WHEN event_id % 4 = 0 THEN (event_id // 4)::VARCHAR ELSE (event_id / 4)::VARCHAR END AS quarter FROM events")
def metadata_canonical(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", (F.col("event_id") % 2 == 0).alias("even"), (F.col("event_id") / 4).alias("quarter"))
    found = stores.canonical_metadata(rows, ["event_type", "user_id", "even", "quarter"])
    return found.select("event_id", *(F.element_at("metadata", c).alias(c) for c in ("event_type", "user_id", "even", "quarter")))
