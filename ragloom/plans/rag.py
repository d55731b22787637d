"""Composed plans: ingestion, and answering a table of questions at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import token_estimate
from ..functions.python_columns import citations
from ..operators.chunking import fixed_chunks
from ..operators.embedding import embed_chunks
from ..operators.grounding import Transformer, context_block, rewrite_with_history, transform_in_turn
from ..operators.retrieval import pack, rerank, retrieve, union_lists
from ..options import ChunkOptions, EmbedOptions, PackingOptions, RetrievalOptions
from ..providers import Provider

KEYS = ["document_id", "chunk_index"]

#: A retriever: queries (query_id, query) and options to ranked chunks (query_id, document_id, chunk_index, text, score,
#: rank). One that can't take a provider's own query raises ValueError.
Retriever = Callable[[DataFrame, RetrievalOptions], DataFrame]
#: A chunker: documents (document_id, text) to chunks.
Chunker = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class AskOptions:
    """top_k holds where `retrieval` sets none; the reranker keeps all that it is given unless `rerank_top` is set."""

    top_k: int | None = 10
    retrieval: RetrievalOptions | None = None
    rerank: bool = False
    rerank_top: int | None = None
    fusion_k: float = 60.0
    packing: PackingOptions | None = field(default_factory=PackingOptions)
    temperature: float | None = None

    def for_retrieval(self) -> RetrievalOptions:
        given = self.retrieval
        if given is None:
            return RetrievalOptions(self.top_k)
        return given if given.top_k is not None else RetrievalOptions(self.top_k, given.min_score, given.metadata, given.provider_query)


def ingest(docs: DataFrame, provider: Provider, chunking: ChunkOptions = ChunkOptions(), embedding: EmbedOptions = EmbedOptions(), chunker: Chunker | None = None) -> DataFrame:
    return embed_chunks(chunker(docs) if chunker else fixed_chunks(docs, chunking), provider, embedding)


def vector_retriever(chunks: DataFrame, provider: Provider) -> Retriever:
    """The nearest of the embedded chunks by cosine. Chunks are read once; write them to a table first, lest each retrieval embeds them anew."""

    def find(queries: DataFrame, options: RetrievalOptions) -> DataFrame:
        def vectors(batches):
            for batch in batches:
                batch["query_vector"] = provider.embed(batch["query"].tolist(), "query")
                yield batch

        kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.select("query_id", "query").mapInPandas(vectors, f"query_id {kind}, query string, query_vector array<float>")
        # counted before the vectors are made, which a provider is paid for
        return retrieve(asked, chunks.where("is_success"), KEYS, options, queries.count(), ["text"])

    return find


def _retrieved(retrievers: list[Retriever], queries: DataFrame, options: AskOptions) -> DataFrame:
    """Ranked chunks of each question, from all retrievers for all its variants (query_id, position, query)."""
    wanted, lists = options.for_retrieval(), []
    plain = RetrievalOptions(wanted.top_k, wanted.min_score, wanted.metadata)
    named = queries.select(F.struct("query_id", "position").alias("query_id"), "query")
    for k, find in enumerate(retrievers):
        try:
            found = find(named, wanted)
        except ValueError:
            if wanted.provider_query is None or len(retrievers) == 1:
                raise
            found = find(named, plain)  # of several retrievers, those that don't know the extension go without
        lists.append(found.select("query_id.query_id", (F.col("query_id.position") * len(retrievers) + k).alias("list_id"), "rank", *KEYS, "text", F.col("score").cast("double").alias("score")))
    return union_lists(lists, [*KEYS, "text"], options.fusion_k, queries.groupBy("query_id").agg((F.count("*") * len(retrievers)).alias("n_lists")))


def converse(questions: DataFrame, retrievers: list[Retriever], provider: Provider, options: AskOptions = AskOptions(), history: DataFrame | None = None, transformers: list[Transformer] = [], chat: bool = True) -> DataFrame:  # noqa: B006
    """Questions (query_id, query), answered: rewrite, transform, retrieve, fuse, rerank, pack, chat, cite.

    history: (query_id, turn, role, text) of the questions that have one; their first search query is rewritten with it.
    Returns query_id, query, rewritten_query, search_queries, chunks (those packed, in the order of the context: document_id,
    chunk_index, score), n_dropped, answer and citations (start, end, text, doc_index), error_message.
    A failed reranking leaves the order; a failed chat gives the empty answer and its error. Without chat only chunks return.
    """
    asked = questions.select("query_id", "query")
    asked = rewrite_with_history(asked, history, provider) if history is not None else asked.withColumn("rewritten_query", F.lit(None).cast("string"))
    asked = asked.persist()  # variants are made by paid calls and used more than once
    current = asked.select("query_id", F.coalesce("rewritten_query", "query").alias("query"))
    searched = transform_in_turn(current, transformers).persist() if transformers else current.select("query_id", F.lit(0).alias("position"), "query")
    ranked = _retrieved(retrievers, searched, options)
    if options.rerank:
        first = searched.where("position = 0").select("query_id", F.col("query").alias("query"))
        again = rerank(ranked.join(first, "query_id").select("query_id", "query", "rank", *KEYS, "text", "score"), provider, options.rerank_top)
        ranked = again.select("query_id", (F.col("rerank_pos") + 1).alias("rank"), *KEYS, "text", F.when(F.isnan("relevance"), F.col("score")).otherwise(F.col("relevance")).alias("score"))
    counted = ranked.select("query_id", "rank", token_estimate(F.col("text")).alias("token_count"), *KEYS, "text", "score")
    packed = pack(counted, options.packing or PackingOptions(1 << 40, lost_in_middle=False))
    selected = F.col("status") == "selected"
    chunk = F.struct("pack_position", *KEYS, "score")
    kept = packed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.when(selected, chunk))), lambda x: F.struct(*(x[c].alias(c) for c in (*KEYS, "score")))).alias("chunks"), F.count(F.when(~selected, 1)).alias("n_dropped"))
    queries = searched.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "query"))), lambda x: x["query"]).alias("search_queries"))
    ready = asked.join(queries, "query_id", "left").join(kept, "query_id", "left").join(context_block(packed), "query_id", "left")
    ready = ready.withColumn("chunks", F.coalesce("chunks", F.array().cast(kept.schema["chunks"].dataType))).fillna({"n_dropped": 0})
    if not chat:
        return ready.drop("context").withColumn("answer", F.lit(""))

    def answers(batches):
        for batch in batches:
            said, failed = [], []
            for q, c in zip(batch["query"], batch["context"], strict=True):
                try:
                    said.append(provider.chat([*([("system", c)] if c else []), ("user", q)], options.temperature))
                    failed.append(None)
                except Exception as e:  # noqa: BLE001 - told in its column
                    said.append("")
                    failed.append(str(e) or "Chat completion failed.")
            batch["raw"], batch["error_message"] = said, failed
            yield batch[["query_id", "raw", "error_message"]]

    kind = questions.schema["query_id"].dataType.simpleString()
    told = ready.select("query_id", "query", "context").mapInPandas(answers, f"query_id {kind}, raw string, error_message string")
    cited = told.join(ready.drop("context"), "query_id").withColumn("c", citations(F.col("raw"), F.size("chunks")))
    return cited.select("query_id", "query", "rewritten_query", "search_queries", "chunks", "n_dropped", F.col("c.clean").alias("answer"), F.col("c.citations").alias("citations"), "error_message")


def ask(questions: DataFrame, chunks: DataFrame, provider: Provider, retrieval: RetrievalOptions = RetrievalOptions(), packing: PackingOptions = PackingOptions()) -> DataFrame:
    """query_id, query, context, answer, n_selected for questions (query_id, query) over embedded chunks: one search, one call."""

    def answers(batches):
        for batch in batches:
            batch["answer"] = [provider.chat([("system", c), ("user", q)]) for q, c in zip(batch["query"], batch["context"], strict=True)]
            yield batch

    kind = questions.schema["query_id"].dataType.simpleString()
    texts = vector_retriever(chunks, provider)(questions, retrieval)
    packed = pack(texts.select("query_id", "rank", token_estimate(F.col("text")).alias("token_count"), "document_id", "text"), packing)
    n = packed.groupBy("query_id").agg(F.count(F.when(F.col("status") == "selected", 1)).alias("n_selected"))
    ready = questions.select("query_id", "query").join(context_block(packed), "query_id", "left").join(n, "query_id", "left").fillna({"context": "", "n_selected": 0})
    return ready.select("query_id", "query", "context", "n_selected").mapInPandas(answers, f"query_id {kind}, query string, context string, n_selected long, answer string")
