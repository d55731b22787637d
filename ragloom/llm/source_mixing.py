"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

Each document is repeated as often as a Poisson variable of its source's mean repetition rate says. The variable is
found by inverting the distribution at a uniform number made of a hash of seed and id, so it depends on nothing else:
runs, partitions and retries agree. The copies then are shuffled globally, by ranges of a further hash.

The rate of a source is its share of the target times the size of the output, over what the source holds. Sizes are
counted in rows (or any amount column). Weights need not add up to one; sources without a weight get `default_weight`,
by default the mean of the given ones, or equal shares if none are given.

Rates up to SPLIT are inverted by one walk down the distribution; a larger rate is the sum of independent variables of
at most SPLIT each, so its terms don't vanish in double precision.

Defined results: a row without source belongs to the source named by the empty string; a row without id or with an
empty text is repeated like any other (null ids share one draw); repeated rows get equal counts; a weight or rate of
zero drops its source; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SPLIT = 8.0
#: Steps of the walk: a Poisson variable of mean SPLIT exceeds this with probability under 1e-16, less than a double tells.
STEPS = 48
#: Largest table of sources that is broadcast.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def poisson_at(u: Column, rate: Column) -> Column:
    """The least n whose cumulative probability is u or more; for rates up to SPLIT.

    P(0) + ... + P(n) is summed in the order of n, so that other engines can repeat it to the last bit.
    """
    start = F.struct(F.lit(0).alias("n"), F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k.cast("double")
        return F.when(acc["sum"] >= u, acc).otherwise(F.struct(k.alias("n"), p.alias("p"), (acc["sum"] + p).alias("sum")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["n"]


def replication_count(key: Column, rate: Column, seed: int) -> Column:
    """How often a row is repeated: a Poisson variable of that rate, fixed by seed and key."""
    pieces = F.greatest(F.ceil(rate / SPLIT), F.lit(1)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), pieces), lambda k: poisson_at(uniform(F.lit(seed), key, k), rate / pieces))
    return F.when(rate > 0, F.aggregate(draws, F.lit(0), lambda a, x: a + x)).otherwise(0)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, default_weight: float | None = None, source_col: str = "source", amount: Column | None = None) -> DataFrame:
    """source, size, weight, rate of each source of the table; total: size of the output, by default that of the input."""
    if weights and min(weights.values()) < 0 or (default_weight or 0) < 0 or (total or 0) < 0:
        raise ValueError("weights and total must not be negative")
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.sum(F.lit(1) if amount is None else amount).cast("double").alias("size"))
    usual = default_weight if default_weight is not None else sum(weights.values()) / len(weights) if weights else 1.0
    given = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)) if weights else None
    weight = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(float(usual))) if weights else F.lit(float(usual))
    sizes = cut(sizes.withColumn("weight", weight.cast("double")))
    whole = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    out = float(total if total is not None else whole["size"] or 0)
    rate = F.when(F.col("size") > 0, F.col("weight") / (whole["weight"] or 1.0) * out / F.col("size")).otherwise(0.0)
    return sizes.withColumn("rate", rate)


def with_copies(docs: DataFrame, rates: DataFrame, seed: int, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All columns of docs, each row once a copy, and the columns mix_copy (from 1), mix_rate, mix_count."""
    rates = cut(rates.select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate")))
    small = rates.count() <= BROADCAST_SOURCES
    joined = docs.join(F.broadcast(rates) if small else rates, F.coalesce(docs[source_col], F.lit("")) == F.col("mix_source")).drop("mix_source")
    counted = joined.withColumn("mix_count", replication_count(docs[id_col], F.col("mix_rate"), seed))
    return counted.where("mix_count > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_count"))))


def shuffled(copies: DataFrame, seed: int, id_col: str = "doc_id") -> DataFrame:
    """Global shuffle: rows in the order of mix_key, a hash of seed, id and copy, by ranges over all partitions."""
    key = F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(copies[id_col].cast("string"), F.lit("")), F.col("mix_copy").cast("string"))), 1, 16)
    keyed = copies.withColumn("mix_key", key)
    n = int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the hash is uniform, so fixed ranges of its first bits are even, without a pass that samples the rows
    part = (F.conv(F.substring("mix_key", 1, 7), 16, 10).cast("long") * n / (1 << 28)).cast("int")
    return keyed.repartitionById(n, part).sortWithinPartitions("mix_key")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", details: bool = False) -> DataFrame:
    """The mixed and shuffled table, with the columns of docs alone; details: and with mix_count, mix_copy and mix_key."""
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))
    own_id, own_source = f"c{names.index(id_col)}", f"c{names.index(source_col)}"
    copies = with_copies(plain, source_rates(plain, weights, total, source_col=own_source), seed, own_id, own_source)
    extra = ["mix_count", "mix_copy", "mix_key"] if details else []
    return shuffled(copies, seed, own_id).select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)), *extra)


def oracle(seed: int) -> str:
    """DuckDB SQL for the equal-weight mix of `documents` at its own size, rows in any order.

    The distribution of each source is tabulated; a draw is the number of entries under its uniform number.
    """
    number = "(('0x' || substr(md5({}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
    draw = number.format(f"'{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || k")
    return f"""
WITH RECURSIVE sizes AS (SELECT coalesce(source, '') AS mix_source, count(*)::DOUBLE AS size FROM documents GROUP BY 1),
rates AS (SELECT mix_source, 1.0 / (SELECT count(*)::DOUBLE FROM sizes) * (SELECT sum(size) FROM sizes) / size AS rate FROM sizes),
pieces AS (SELECT mix_source, rate, greatest(ceil(rate / {SPLIT}), 1)::INTEGER AS pieces, rate / greatest(ceil(rate / {SPLIT}), 1) AS r FROM rates),
walk(mix_source, r, k, p, total) AS (
  SELECT mix_source, r, 0, exp(-r), exp(-r) FROM pieces
  UNION ALL SELECT mix_source, r, k + 1, p * r / (k + 1), total + p * r / (k + 1) FROM walk WHERE k + 1 < {STEPS}),
tables AS (SELECT mix_source, list(total ORDER BY k) AS totals FROM walk GROUP BY 1),
draws AS (
  SELECT d.*, t.totals, generate_series(1, p.pieces) AS ks
  FROM documents d JOIN pieces p ON coalesce(d.source, '') = p.mix_source JOIN tables t USING (mix_source)),
counted AS (
  SELECT * EXCLUDE (totals, ks), list_sum(list_transform(ks, lambda k: len(list_filter(totals, lambda t: t < {draw}))))::INTEGER AS mix_count FROM draws),
copies AS (SELECT *, unnest(generate_series(1, mix_count))::INTEGER AS mix_copy FROM counted WHERE mix_count > 0)
SELECT doc_id, text, lang, source, n_chars, mix_count, mix_copy,
  substr(md5('order{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || mix_copy), 1, 16) AS mix_key
FROM copies
"""
