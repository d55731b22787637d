"""Language identification by Bayesian evidence fusion.

For each language the log-likelihood of the text (hashed byte trigrams of its letters), of the declared markup
language and of the address suffix, and a prior for the host are added; the language of the greatest sum is given with
its posterior probability.

* Trigram tables are fitted on a sample of labelled texts: PER_LANGUAGE a language at most, those of the least hashed
  ids, of each language that is a label. Trigrams of one text depend on each other, so a text counts for
  EFFECTIVE independent ones at most.
* What a declaration or a suffix says is learnt from the table itself: how often it goes with each language that the
  text alone suggests, smoothed by STRENGTH rows of a default (for declarations RELIABLE of them agree; for suffixes
  as in the whole table).
* A host's prior is its counts of languages, smoothed by STRENGTH rows of its domain's distribution, which is smoothed
  by that of the whole table. A row's own text doesn't count in its own prior.

All counts are grouped aggregations over all rows.

Defined results: a text without letters has no evidence of its own; it is not accepted, its language is the one that
the other evidence suggests. A language of posterior under CONFIDENT isn't accepted. A text that a uniform model of prior odds ODD_PRIOR explains better than every language is `und`,
  not accepted.
Null or unknown declarations and hosts are no evidence. Of equal sums the first language in alphabetical order wins.
Without labelled texts, everything is `und`. Repeated rows give repeated rows and count repeatedly. A null id stays null.
An empty table gives no rows. Long texts are read whole. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SUB_BATCH_BYTES, cut, pick, ship, text_slices

PER_LANGUAGE = 400
BUCKETS = 1 << 15
EFFECTIVE = 200
SMOOTH = 0.05
STRENGTH = 20.0
RELIABLE = 0.9
#: Prior odds of the uniform model against a language.
ODD_PRIOR = 1e-4
#: Posterior probability from which a language is accepted.
CONFIDENT = 0.5
#: Largest table of counts by key that is broadcast.
BROADCAST_KEYS = 10_000


def _letters() -> np.ndarray:
    """Bytes as they enter trigrams: ASCII letters and bytes of longer characters; all else is a space."""
    out = np.full(256, 32, np.uint8)
    for b in [*range(65, 91), *range(97, 123), *range(128, 256)]:
        out[b] = b | 32 if b < 128 else b
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of letters, and their number for each text."""
    raw = [t.lower().encode() for t in texts]
    data = _letters()[np.frombuffer(b"  ".join(raw) + b"  ", np.uint8)]
    ends = np.cumsum([len(x) + 2 for x in raw])
    wide = data.astype(np.uint32)
    code = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
    space = (data == 32).astype(np.uint8)
    keep = np.flatnonzero((space[:-2] + space[2:] < 2) & (space[1:-1] == 0))
    counts = np.diff(np.searchsorted(keep, np.concatenate([[0], ends])))
    return (code[keep] * np.uint32(0x9E3779B1) >> np.uint32(32 - 15)).astype(np.int64), counts


class TextModel:
    """Log-probabilities of trigram buckets, a row for each language and a last one for the uniform model."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTH
        rows = np.log(smooth / smooth.sum(1, keepdims=True)) if len(counts) else np.zeros((0, BUCKETS))
        self.table = np.concatenate([rows, np.full((1, BUCKETS), -np.log(BUCKETS))]).astype(np.float64)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log-likelihoods (texts by languages and the uniform model) and numbers of trigrams."""
        bucket, n = trigrams(texts)
        sums = np.zeros((len(texts), len(self.table)))
        some = np.flatnonzero(n)
        if len(some):
            starts = (np.cumsum(n) - n)[some]
            for k, row in enumerate(self.table):
                sums[some, k] = np.add.reduceat(row[bucket], starts)
        return np.round(sums * (np.minimum(n, EFFECTIVE) / np.maximum(n, 1))[:, None], 6), n


def fit_text_model(labelled: DataFrame) -> TextModel:
    """labelled: id, lang, text. Only ids and labels are ranked; the texts of the sample are read by their ids."""
    ship(labelled.sparkSession)
    usable = labelled.where(F.col("lang").isNotNull() & (F.col("lang") != "") & F.col("text").isNotNull() & F.col("id").isNotNull())
    languages = sorted(r["lang"] for r in usable.select("lang").distinct().collect())  # as many rows as languages
    if not languages:
        return TextModel([], np.zeros((0, BUCKETS)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = usable.where(F.col("lang").isin(languages)).select("id", "lang").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PER_LANGUAGE)
    sample = usable.join(F.broadcast(cut(ids.select("id", "lang").distinct())), ["id", "lang"])  # PER_LANGUAGE rows a language at most
    index = {x: k for k, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for part in text_slices(batches, "text"):
            bucket, n = trigrams(part.column(1).to_pylist())
            owner = np.repeat([index[x] for x in part.column(0).to_pylist()], n)
            counts += np.bincount(owner * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
        k, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[k, bucket])], names=["k", "bucket", "n"])

    counts = np.zeros((len(languages), BUCKETS), np.int64)
    sums = sample.select("lang", "text").mapInArrow(run, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toPandas()  # BUCKETS rows a language at most
    counts[found["k"], found["bucket"]] = found["n"]
    return TextModel(languages, counts)


def host_of(url: Column) -> Column:
    """Lower case, without scheme, user, port and www; empty if there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.regexp_replace(host, r"^www\.|\.$", ""), F.lit(""))


def _attach(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Left join to a table of counts by key: broadcast if it is checked to be small, else by a shuffle that can be split."""
    counts = cut(counts)
    return rows.join(F.broadcast(counts) if counts.count() <= BROADCAST_KEYS else counts, key, "left")


def _counts(languages: list[str], prefix: str) -> list[Column]:
    return [F.sum(F.when(F.col("guess") == k, 1).otherwise(0)).alias(f"{prefix}{k}") for k in range(len(languages))]


def identify(rows: DataFrame, model: TextModel, to_text: Callable[[str], str] | None = None) -> DataFrame:
    """lang, confidence, accepted, n_trigrams beside id, host and declared of each row.

    rows: id, text, declared, host (a domain name or any name of a source). to_text: applied to each text on the
    workers first, for instance to extract it from markup.
    """
    ship(rows.sparkSession)
    languages = model.languages
    size = len(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SUB_BATCH_BYTES):
            texts = part.column(1).to_pylist()
            sums, n = model.score([to_text(t) for t in texts] if to_text else texts)
            guess = np.where(n > 0, sums[:, :-1].argmax(1), -1) if size else np.full(len(texts), -1)
            odd = (n > 0) & (sums[:, :-1].max(1, initial=-np.inf) <= sums[:, -1] + np.log(ODD_PRIOR))
            likely = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * size), pa.array(np.ascontiguousarray(sums[:, :-1]).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), likely, pa.array(np.where(odd, -1, guess).astype(np.int32)), pa.array(odd), pa.array(n)], names=["id", "declared", "host", "likely", "guess", "odd", "n_trigrams"])

    plain = rows.select("id", "text", F.lower(F.regexp_extract(F.coalesce("declared", F.lit("")), r"^\s*([A-Za-z]+)", 1)).alias("declared"), F.coalesce("host", F.lit("")).alias("host"))
    kind = plain.schema["id"].dataType.simpleString()
    scored = plain.mapInArrow(run, f"id {kind}, declared string, host string, likely array<double>, guess int, odd boolean, n_trigrams long")
    scored = scored.withColumn("suffix", F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise(""))
    scored = cut(scored.withColumn("domain", F.substring_index("host", ".", -2)))
    if not size:
        return scored.select("id", "host", "declared", F.lit("und").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"), "n_trigrams")
    ks = range(size)
    whole = scored.agg(*_counts(languages, "t")).first()
    total = [(whole[f"t{k}"] or 0) + 1.0 for k in ks]
    share = [t / sum(total) for t in total]

    hosts = cut(scored.where("host != ''").groupBy("host", "domain").agg(*_counts(languages, "h")))
    domains = hosts.groupBy("domain").agg(*(F.sum(f"h{k}").alias(f"m{k}") for k in ks))
    hosts = _attach(hosts, domains, "domain").drop("domain")
    declarations = scored.where("declared != ''").groupBy("declared").agg(*_counts(languages, "d"))
    suffixes = scored.where("suffix != ''").groupBy("suffix").agg(*_counts(languages, "s"))
    every = cut(suffixes).agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in ks)).first()
    with_suffix = sum(every[f"s{k}"] or 0 for k in ks)
    joined = _attach(_attach(_attach(scored, hosts, "host"), declarations, "declared"), suffixes, "suffix")

    own = [F.when(F.col("guess") == k, 1.0).otherwise(0.0) for k in ks]
    less = lambda name, k: F.coalesce(F.col(f"{name}{k}").cast("double"), own[k]) - own[k]
    all_of = lambda name: sum((less(name, k) for k in ks), F.lit(0.0))
    sums = []
    for k in ks:
        by_domain = (less("m", k) + STRENGTH * share[k]) / (all_of("m") + STRENGTH)
        by_host = F.when(F.col("host") == "", F.lit(share[k])).otherwise((less("h", k) + STRENGTH * by_domain) / (all_of("h") + STRENGTH))
        agrees = F.when(F.col("declared") == languages[k].lower(), RELIABLE).otherwise((1 - RELIABLE) / max(1, size))
        by_declared = F.when(F.col("declared").isin([x.lower() for x in languages]), (less("d", k) + STRENGTH * agrees) / (total[k] + STRENGTH)).otherwise(1.0)
        any_suffix = (all_of("s") + 1.0) / (with_suffix + 1.0)
        by_suffix = F.when(F.col("suffix") == "", 1.0).otherwise((less("s", k) + STRENGTH * any_suffix) / (total[k] + STRENGTH))
        sums.append(F.round(F.get("likely", F.lit(k)) + F.log(by_host) + F.log(by_declared) + F.log(by_suffix), 6))
    fused = joined.select("id", "host", "declared", "odd", "n_trigrams", F.array(*sums).alias("sums"))
    fused = fused.withColumn("most", F.array_max("sums"))
    best = F.get(F.array(*(F.lit(x) for x in languages)), (F.array_position("sums", F.col("most")) - 1).cast("int"))
    posterior = 1 / F.aggregate("sums", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("most")))
    return fused.select("id", "host", "declared", F.when(F.col("odd"), F.lit("und")).otherwise(best).alias("lang"), F.when(F.col("odd"), 0.0).otherwise(F.round(posterior, 6)).alias("confidence"), (~F.col("odd") & (F.col("n_trigrams") > 0) & (posterior >= CONFIDENT)).alias("accepted"), "n_trigrams")


def page_languages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """page_id, host, declared, lang, confidence, accepted, n_trigrams of each page (page_id, url, html).

    labelled: documents (doc_id, lang, text) to fit the text model on. The declared language is that of the html
    element; the text is the page's main text.
    """
    from .html_extract import main_text

    declared = F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").alias("id"), F.col("html").alias("text"), declared.alias("declared"), host_of(F.col("url")).alias("host"))
    return identify(rows, fit_text_model(pick(labelled, "doc_id", "lang", "text").toDF("id", "lang", "text")), main_text).withColumnRenamed("id", "page_id")


def document_languages(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, lang, confidence, accepted, n_trigrams of each document; its source is the host, its lang the declaration.

    key: the column that names a row in the result. The sample of labelled texts is always taken by doc_id.
    """
    plain = pick(docs, "doc_id", "lang", "text", "source", key).toDF("id", "lang", "text", "source", "key")
    rows = plain.select(F.col("key").alias("id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    return identify(rows, fit_text_model(plain.select("id", "lang", "text"))).withColumnRenamed("id", key).drop("host", "declared")
