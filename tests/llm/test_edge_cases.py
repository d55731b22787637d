"""Every operator and pipeline stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ragloom.llm.bpe_trie import bpe_digests
from ragloom.llm.embedding_neardup import vector_near_duplicates
from ragloom.llm.html_extract import extract_main_text
from ragloom.llm.kneser_ney import train_and_score
from ragloom.llm.language_id import document_languages, page_languages
from ragloom.llm.license_scan import license_matches
from ragloom.llm.media_png import media_columns, media_features
from ragloom.llm.minhash_neardup import near_duplicates
from ragloom.llm.queries import vocabulary
from ragloom.llm.source_mixing import mix_sources
from ragloom.llm.token_counts import token_counts

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word and more of it, again " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b", None),
    (3, None, "en", "a", 0), (4, "", None, None, 0), (5, " \n\t ", "fr", "", 4), (6, "one two", "en", "a", 7),
    (7, LONG, "en", "b", len(LONG)), (8, "x" * 200_000, None, "c", 0), (None, "a text without an id that is long enough", "en", "a", 1), (9, "été 😀 日本 Released under the MIT License.", "fr", "c", 9),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Under the default settings, by which names that differ in case only are ambiguous."""
    rows = spark.createDataFrame(ROWS, COLUMNS)
    extra = rows.select("*", F.lit(1).alias("x1"), F.lit("x").alias("x2"), F.lit(2).alias("x3"), F.lit(3).alias("x4"), F.lit(4).alias("x5"))
    return extra.toDF(*rows.columns, "TEXT", "id", "n_tokens", "rank", "DOC_ID")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


EVERY = {
    "token_counts": lambda d: token_counts(d, vocabulary("piece_bpe_32k.model")),
    "token_counts_json": lambda d: token_counts(d, vocabulary("byte_bpe_50k.json")),
    "media": lambda d: media_features(media_columns(d)),
    "bpe": lambda d: bpe_digests(d, vocabulary("byte_bpe_50k.json")),
    "near_duplicates": near_duplicates,
    "language": document_languages,
    "score": train_and_score,
}


@pytest.mark.parametrize("name", EVERY)
def test_a_row_for_each_row(name, docs, empty):
    assert EVERY[name](empty).count() == 0
    rows = EVERY[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    twice = [r for r in rows if r["doc_id"] == 1]
    assert twice[0] == twice[1]


def test_near_duplicates(docs):
    rows = by_id(near_duplicates(docs))
    assert {(r["component_id"], r["kept"]) for r in rows[1]} == {(1, True)}
    assert rows[2][0]["component_id"] == 1 and not rows[2][0]["kept"]
    for k in (3, 4, 5):
        assert (rows[k][0]["n_shingles"], rows[k][0]["component_id"], rows[k][0]["kept"]) == (0, k, True)
    assert rows[6][0]["n_shingles"] == 1
    assert all(r["component_id"] is None and not r["kept"] for r in rows[None])


def test_scores(docs):
    rows = by_id(train_and_score(docs))
    assert rows[3][0]["n_tokens"] == rows[4][0]["n_tokens"] == 1
    assert all(r["held_out"] for r in rows[None]) and all(r["score"] <= 0 for k in rows.values() for r in k)


def test_languages(docs):
    rows = by_id(document_languages(docs))
    assert not rows[3][0]["accepted"] and not rows[4][0]["accepted"] and rows[1][0]["accepted"]


def test_licenses(docs, empty):
    assert license_matches(empty).count() == 0
    got = by_id(license_matches(docs))
    assert set(got) == {9} and got[9][0]["license"] == "notice MIT" and got[9][0]["containment"] == 1.0


def test_short_notices(spark):
    """A template under five words is found as a run of words, in long texts and short ones, and nowhere else."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    fixed = [(-1, "ALL RIGHTS reserved."), (-2, "all rights"), (-3, "All the rights reserved"), (-4, None), (-5, "x " * 40 + "all rights reserved"), (-6, "fall rights reserved a b c")]
    docs = docs.unionByName(spark.createDataFrame(fixed, docs.schema))
    want = {r["doc_id"] for r in docs.collect() if re.search(r"(?i)(?<![^\W_])all[\W_]+rights[\W_]+reserved(?![^\W_])", r["text"] or "")}
    found = license_matches(docs).collect()
    got = [r for r in found if r["license"] == "notice rights reserved"]
    assert {r["doc_id"] for r in got} == want and len(got) == len(want) > 2
    assert all((r["n_template"], r["n_shared"], r["containment"]) == (1, 1, 1.0) for r in got)


def test_many_copies_of_two_near_texts(spark):
    """Copies of a row don't meet each other's, and of rows of one id the longest text stays."""
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(words[:50] if i == 1 else words[:51])) for i in (1, 2) for _ in range(400)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).distinct().collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1)}
    twice = spark.createDataFrame([(1, "short text here", "en", "a", 1), (1, "a longer text of the same id", "en", "a", 1)], COLUMNS)
    assert [r["text"] for r in corpus_pipeline.near_dedup(spark, twice, "").collect()] == ["a longer text of the same id"]


def test_mixing(docs, empty):
    assert mix_sources(empty).count() == 0
    mixed = mix_sources(docs, seed=3)
    assert mixed.columns == docs.columns
    names = [*docs.columns, "mix_count", "mix_copy", "mix_key"]
    copies = mix_sources(docs, {"a": 0.0, "b": 1.0, "c": 0.0, "": 0.0}, 400.0, 1, details=True)
    rows = copies.collect()
    assert copies.columns == names and {r["source"] for r in rows} == {"b"} and 330 < len(rows) < 470
    assert len({(r[0], r["mix_copy"]) for r in rows}) == len(rows)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", "<p>One, two, three and four words.</p>"), (1, "http://a.example/x", "<p>One, two, three and four words.</p>"), (2, None, None), (3, "", ""), (None, "u", "<p>cut off <b"), (4, "http://b", "<div>" * 3000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit(0))
    rows = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    assert rows[1]["text"] == "One, two, three and four words." and rows[2]["text"] == rows[3]["text"] == "" and rows[4]["n_chars"] == 4
    assert extract_main_text(pages.where("page_id = 77")).count() == 0
    labelled = spark.createDataFrame(ROWS, COLUMNS)
    assert page_languages(pages, labelled).count() == 6 and page_languages(pages.limit(0), labelled.limit(0)).count() == 0
    assert {r["lang"] for r in page_languages(pages, labelled.limit(0)).collect()} == {"und"}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0]), (4, None), (5, [nan, 1.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, []), (9, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [0.0, 1e-30, 0.0]), (11, [0.95, 0.31, 0.0])]
    rows = {}
    for r in vector_near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))).collect():
        rows.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert rows[1] == [(3, 1, True)] * 2 and rows[2] == [(3, 1, False)] and rows[11] == [(3, 1, False)]
    for k in (3, 4, 5, 6, 7, 8, 9, 10):
        assert rows[k] == [(0, k, True)]
    assert rows[None] == [(0, None, False)]
    assert vector_near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages(stage, spark, docs, empty):
    _, f = corpus_pipeline.STAGES[stage]
    assert f(spark, empty, "").count() == 0
    out = f(spark, docs, "")
    rows = out.collect()
    if stage < 3:
        assert out.columns == docs.columns
    if stage == 1:
        ids = [r["doc_id"] for r in rows]
        assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9] and ids.count(None) == 2


def test_language_stage_decides_by_row(spark):
    """A rejected row leaves without an id too, and takes no other row of its id with it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = docs.first()["doc_id"]
    junk = [(k, "漢字" * 60, None, "s", 120) for k in (one, None)]
    out = corpus_pipeline.language_id(spark, docs.unionByName(spark.createDataFrame(junk, COLUMNS)), "")
    assert out.where("text like '漢字漢字%'").count() == 0
    assert out.where(F.col("doc_id") == one).count() == 1 and out.count() == docs.count()


def test_stages_meet_in_parquet(spark, monkeypatch):
    """What a stage reads are Parquet files that the one before has written."""
    read = []

    def stage(spark, docs, sf_dir):
        read.append(docs.inputFiles())
        return docs

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(f and all("parquet" in x for x in f) for f in read) and not set(read[1]) & set(read[0] + read[2])
