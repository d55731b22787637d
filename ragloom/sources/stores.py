"""Sources and sinks: documents from tables, files and streams; vector stores as tables; captured event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import data_uri, utf16_length
from ..operators.retrieval import metadata_equals
from ..operators.retrieval import top_k as top_k_of


def documents(table: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return table.select(F.col(id_col).cast("string").alias("document_id"), F.col(text_col).alias("text"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document for each file; its id is the whole path, as files of different folders may have one name."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("document_id"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Replies of a service that were kept as JSON lines; those that don't parse have nulls and are kept in `_corrupt`."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def canonical_metadata(row: DataFrame, columns: list[str]) -> DataFrame:
    """metadata: the columns as a map of texts, for equality: booleans as True and False, numbers without needless zeros, nulls left out."""
    kinds = dict(row.dtypes)
    as_text = lambda c: F.initcap(F.col(c).cast("string")) if kinds[c] == "boolean" else F.regexp_replace(F.col(c).cast("string"), r"^(-?\d+)\.0$", "$1") if kinds[c] in ("float", "double") else F.col(c).cast("string")
    every = F.map_from_entries(F.array(*(F.struct(F.lit(c).alias("k"), as_text(c).alias("v")) for c in columns)))
    return row.withColumn("metadata", F.map_filter(every, lambda _, v: v.isNotNull()))


def file_search_results(calls: DataFrame, top_k: int | None = None, min_score: float | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """Passages that a hosted search returned, as ranked chunks.

    calls: query_id, call, status, results (array of file_id, filename, text, score, attributes map). Calls that aren't
    completed give nothing. chunk_index counts a file's passages in the order of the reply; offsets count UTF-16 units.
    All passages stay by default; filters and k are applied here again, whatever the service did.
    """
    flat = calls.where("status = 'completed'").select("query_id", "call", F.posexplode("results").alias("place", "r"))
    within = Window.partitionBy("query_id", "r.file_id").orderBy("call", "place")
    named = F.map_concat(F.map_filter(F.coalesce("r.attributes", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("file_id", "filename")), F.create_map(F.lit("file_id"), F.coalesce(F.try_element_at("r.attributes", F.lit("file_id")), F.col("r.file_id")), F.lit("filename"), F.coalesce(F.try_element_at("r.attributes", F.lit("filename")), F.col("r.filename"))))
    chunks = flat.select("query_id", "call", "place", F.col("r.file_id").alias("document_id"), (F.row_number().over(within) - 1).alias("chunk_index"), F.lit(0).alias("start_offset"), utf16_length(F.col("r.text")).alias("end_offset"), F.col("r.text").alias("text"), named.alias("metadata"), F.col("r.score").cast("double").alias("score"))
    if metadata:
        chunks = chunks.where(metadata_equals(F.col("metadata"), metadata))
    return top_k_of(chunks, top_k, ["call", "place"], min_score).drop("call", "place")


def image_uris(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", data_uri(F.col("path"), F.col("content")).alias("uri"))


class VectorStore:
    """A table of files' chunks with embeddings: create, append, look up, list, delete; adding commits as one job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def count(self) -> int:
        return self.rows().count()

    def files(self, after: str | None = None, limit: int = 20) -> DataFrame:
        """A page of document ids, those after a key."""
        ids = self.rows().select("document_id").distinct()
        return (ids.where(F.col("document_id") > after) if after else ids).orderBy("document_id").limit(limit)

    def file(self, document_id: str) -> DataFrame:
        """The chunks of a file."""
        return self.rows().where(F.col("document_id") == document_id)

    def delete_files(self, ids: list[str]) -> None:
        """Writes the table anew without the files' chunks; under another name first, so that a lost job loses nothing."""
        kept, new = self.rows().where(~F.col("document_id").isin(ids)), f"{self.name}_new"
        self.spark.sql(f"DROP TABLE IF EXISTS {new}")
        kept.write.saveAsTable(new)
        self.drop()
        self.spark.sql(f"ALTER TABLE {new} RENAME TO {self.name.split('.')[-1]}")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    @staticmethod
    def names(spark: SparkSession, pattern: str = "*") -> list[str]:
        """Names of the tables of the current database."""
        return sorted(t.name for t in spark.catalog.listTables(pattern=pattern) if not t.isTemporary)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def passage_ordinals(passages: DataFrame, file_col: str, order: list[str]) -> DataFrame:
    """chunk_index of each passage within its file, by its place in the response."""
    return passages.withColumn("chunk_index", F.row_number().over(Window.partitionBy(file_col).orderBy(*order)) - 1)


def sse_data(lines: DataFrame) -> DataFrame:
    """request_id, seq, data of captured event-stream lines (request_id, seq, line), up to the first [DONE]."""
    data = lines.where(F.col("line").startswith("data:")).select("request_id", "seq", F.trim(F.substring("line", 6, 1 << 30)).alias("data"))
    done = F.min(F.when(F.col("data") == "[DONE]", F.col("seq"))).over(Window.partitionBy("request_id"))
    return data.withColumn("done", done).where(F.col("done").isNull() | (F.col("seq") < F.col("done"))).where("data <> ''").drop("done")


def assemble_answers(events: DataFrame) -> DataFrame:
    """request_id, answer: the deltas (JSON with `delta`) of each request in order; malformed events are skipped."""
    parsed = events.withColumn("delta", F.get_json_object("data", "$.delta")).where(F.col("delta").isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct("seq", "delta")))
    return parsed.groupBy("request_id").agg(F.array_join(F.transform(ordered, lambda x: x["delta"]), "").alias("answer"))
