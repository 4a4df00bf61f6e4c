"""Mixing sources to target weights, by Poisson replication.

A source of n documents that should fill a share w of the result has the mean
repetition rate w * total / n.  Every document draws its count from a Poisson
distribution of that mean by inverting the distribution at a uniform number
hashed from the seed and the document, is repeated that often, and all copies
are shuffled by a second hash.  A mean above PART is drawn as the sum of equal
parts of at most PART each, with a hash of its own for each part, so that no
distribution is long.  The same input gives the same mixture however it
is partitioned, and a lost task draws the same counts again.

Edge cases: a null source is a source of its own (named null in weights by
None); a source without a weight gets none of the result; a null doc_id draws
by its text; repeated ids draw alike; an empty table gives an empty result.
All columns of the input stay: the operator's own (copy, shuffle_key) get
underscores until their names are free.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, joined, let, read

#: A table of at most so many sources is broadcast (at most 130 numbers and a name
#: each); with more, only sources that hold a thousandth of all rows are.
BROADCAST_SOURCES = 10_000
SEED, POWER, PART = 20, 0.5, 32


def cumulative(rate: Column) -> Column:
    """P(count <= k) for k = 0, 1, ... until what is left is below 1e-12."""
    top = F.ceil(rate + F.sqrt(rate) * 12 + 30).cast("int")

    def step(acc: Column, k: Column) -> Column:
        ln_p = acc["ln_p"] + F.when(k == 0, F.lit(0.0)).otherwise(F.ln(rate) - F.ln(F.greatest(k, F.lit(1)).cast("double")))
        total = acc["sum"] + F.exp(ln_p)
        return F.struct(ln_p.alias("ln_p"), total.alias("sum"), F.concat(acc["out"], F.array(F.round(total, 12))).alias("out"))

    zero = F.struct((-rate).alias("ln_p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), top), zero, step, lambda a: a["out"])).otherwise(F.array(F.lit(1.0)))


def uniform(*parts: Column) -> Column:
    """In [0, 1): the first 52 bits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None, total: int | None, power: float = POWER) -> DataFrame:
    """(source, n, rate, parts, cdf), cdf of a part of the rate.  Without weights,
    a source's weight is its size to the given power, which raises small sources."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(power)))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(w)
        weighed = sizes.withColumn("w", w)
    all_w, all_n = weighed.agg(F.sum("w"), F.sum("n")).first()
    rate = F.round(F.col("w") / F.lit(all_w) * F.lit(all_n if total is None else total) / F.col("n"), 9) if all_w else F.lit(0.0)
    rated = weighed.select("source", "n", rate.alias("rate"))
    parts = rated.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    return parts.withColumn("cdf", cumulative(F.col("rate") / F.col("parts")))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """docs, each row as often as drawn, in shuffled order, with copy (from 0)
    and shuffle_key."""
    source, cdf, parts, n, copy, order = (fresh(docs, x) for x in ("mix_source", "mix_cdf", "mix_parts", "mix_times", "copy", "shuffle_key"))
    label = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias(source)
    table = rates(docs, weights, total).select(label, F.col("cdf").alias(cdf), F.col("parts").alias(parts), "n")
    named = docs.select("*", label)
    few = docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    met = named.join(F.broadcast(table.drop("n")), source) if few else joined(named, table, source, docs.count())
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))

    def drawn(part: Column) -> Column:
        u = uniform(F.lit(f"{seed}:count"), part.cast("string"), name)
        return let(u, lambda x: F.size(F.filter(cdf, lambda c: c <= x)))

    times = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda sum_, part: sum_ + drawn(part))
    repeated = met.withColumn(n, times).drop(cdf, source, parts).where(F.col(n) > 0)
    copies = repeated.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    keyed = copies.withColumn(order, F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), name, F.col(copy).cast("string"))))
    return keyed.repartition(order).sortWithinPartitions(order)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (
  SELECT source, round(pow(n::DOUBLE, {POWER}) / (SELECT sum(pow(n::DOUBLE, {POWER})) FROM s) * (SELECT sum(n) FROM s) / n, 9) AS rate FROM s
), q AS (
  SELECT source, greatest(ceil(rate / {PART}), 1)::INTEGER AS parts, rate / greatest(ceil(rate / {PART}), 1) AS part FROM r
), c AS (
  SELECT source, round(sum(exp(-part + k * ln(part) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k), 12) AS cdf
  FROM q, (SELECT unnest(range(0, {PART + 12 * 6 + 30})) AS k) WHERE k <= ceil(part + 12 * sqrt(part) + 30)
), d AS (
  SELECT row_number() OVER () AS rid, *, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS name FROM documents
), u AS (
  SELECT d.rid, d.source, ('0x' || substr(md5('{SEED}:count:' || j || ':' || name), 1, 13))::UBIGINT::DOUBLE / {1 << 52} AS u
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source, unnest(range(1, parts + 1)) AS t(j)
), t AS (
  SELECT rid, count(*) AS times FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u GROUP BY rid
)
SELECT doc_id, text, lang, source, n_chars, k::INTEGER AS copy, md5('{SEED}:order:' || name || ':' || k) AS shuffle_key
FROM (SELECT d.*, unnest(range(0, times)) AS k FROM d JOIN t USING (rid))
"""
