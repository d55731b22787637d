"""Queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import page_languages

    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


#: Seed of the production mix, in which every source has the same weight and the size stays.
MIX_SEED = 20_240_607


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"), seed=MIX_SEED, details=True)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media_png import media_columns, media_features

    return media_features(media_columns(table(spark, sf_dir, "documents")))


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_trie import bpe_digests

    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_neardup import vector_near_duplicates

    return vector_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9, recall=0.99)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    named = [op1_license_scan, op2_minhash_neardup, op3_token_counts, op4_lm_scoring, op5_language_id, op6_source_mixing, op7_media_columns, op8_bpe_roundtrip, op9_html_extract, op10_embedding_neardup, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from .license_scan import oracle
    from .source_mixing import oracle as mix_oracle

    return {"op1_license_scan": oracle(), "op6_source_mixing": mix_oracle(MIX_SEED)}
