"""The corpus pipeline: each stage is one training-data operator, applied to all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.bpe_trie import bpe_digests
from ragloom.llm.common import cut, new_shared_path
from ragloom.llm.language_id import document_languages
from ragloom.llm.minhash_neardup import near_duplicates
from ragloom.llm.queries import MIX_SEED, vocabulary
from ragloom.llm.source_mixing import mix_sources

#: Percentage of common shingles from which documents are near duplicates.
NEAR_PERCENT = 80
#: Ids (8 bytes each) up to which a list of them is broadcast.
BROADCAST_IDS = 1_000_000


def _plain(docs: DataFrame) -> DataFrame:
    """The columns under names of our own, so that no two can be taken for one another."""
    return docs.toDF(*(f"_c{k}" for k in range(len(docs.columns))))


def _named(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.select(*(F.col(f"_c{k}").alias(n) for k, n in enumerate(names)))


def _without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is not among the ids (a checkpoint); rows without a key stay.

    The ids are broadcast if they are counted to be few, so that the texts needn't be shuffled.
    """
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is accepted as being in one of the languages of the labelled documents; each row by its own text.

    Texts without letters (null and empty ones too), in no known language, or of a doubtful one go. Rows without an id
    are judged like all others, and so are repeated rows. An empty table gives an empty one. Columns may clash.
    """
    names = docs.columns
    used = {n: F.col(f"_c{names.index(n)}") for n in ("doc_id", "lang", "text", "source")}
    # rows that agree in all that decides are decided alike, so a hash of it, 128 bits wide, names them; nothing is written
    parts = [x for c in used.values() for x in (c.isNull(), c)]
    rows = _plain(docs).withColumn("_row", F.concat_ws(":", *(F.xxhash64(F.lit(k), *parts) for k in (1, 2))))
    found = document_languages(rows.select(*(c.alias(n) for n, c in used.items()), "_row"), "_row")
    return _named(_without(rows, cut(found.where(~F.col("accepted")).select("_row").distinct()), "_row"), names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id.

    Of the rows of one id the longest text stays, of equally long ones the least; of rows that differ in other columns
    only, any one. Documents without words are in no group and stay, and so do rows without an id. An empty table gives
    an empty one. Columns may clash.
    """
    names = docs.columns
    key, text = (f"_c{names.index(n)}" for n in ("doc_id", "text"))
    plain = _plain(docs)
    found = near_duplicates(plain.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), NEAR_PERCENT)
    rest = _without(plain, cut(found.where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key))), key)
    repeated = cut(plain.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key))
    if repeated.isEmpty():
        return _named(rest, names)
    best = Window.partitionBy(key).orderBy(F.desc_nulls_last(F.length(text)), text)
    once = rest.join(repeated, key, "left_semi").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    return _named(_without(rest, repeated, key).unionByName(once), names)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at equal weight, the size kept: documents are repeated, or left out, by their source's rate.

    Nulls, ties, empty tables and clashing columns as in mix_sources.
    """
    return mix_sources(docs, seed=MIX_SEED)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of ids and of the decoded text, of each row; null and empty texts have no tokens."""
    return bpe_digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("bpe_tokens", bpe_tokens)]

#: Neither the language model, nor connected components, nor byte-pair encoding can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_shared_path(spark, "stage")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
