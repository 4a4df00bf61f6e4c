"""Explicit supports: every possible row, or the distinct rows of public data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domain import Domain, EncodedData, column
from ..functions import noise
from ..plans.workload import QuerySpace
from .marginals import filled, sums

MOST_CELLS = 1 << 32
#: Draws of one range that meet in a task, at most.
SLICE = 1_000_000
#: The column of a support's cells.
CELLS = "__cells"


def full_support(spark: SparkSession, domain: Domain, most: int = MOST_CELLS) -> DataFrame:
    """(support_id, codes): the product of all attributes, the last one fastest."""
    n = domain.size()
    if n > most:
        raise ValueError(f"{n} rows are more than {most}")
    codes, stride = [], n
    for a, size in domain.config.items():
        stride //= size
        codes.append(F.pmod(F.floor(F.col("id") / stride), F.lit(size)).cast("int").alias(a))
    return spark.range(n).select(F.col("id").alias("support_id"), *codes)


def public_support(public: EncodedData) -> DataFrame:
    """(codes, w): the distinct rows of public data with their frequencies."""
    own = [column(a) for a in public.domain.attrs]
    counts = public.df.groupBy(*own).agg(F.sum(public.mass()).alias("c"))
    whole = public.df.agg(F.sum(public.mass()).alias("n"))
    return counts.join(F.broadcast(whole)).select(*own, (F.col("c") / F.col("n")).alias("w"))


def support_distribution(support: DataFrame, data: EncodedData) -> DataFrame:
    """The support with w: the data's frequencies among the support's rows, 0 for
    rows that the data lacks; rows outside the support count for nothing."""
    attrs = list(data.domain.attrs)
    counts = data.df.groupBy(*[column(a) for a in attrs]).agg(F.sum(data.mass()).alias("__c"))
    met = support.join(counts, attrs, "left").withColumn("__c", F.coalesce("__c", F.lit(0.0)))
    whole = met.agg(F.sum("__c").alias("__n"))
    return met.join(F.broadcast(whole)).withColumn("w", F.when(F.col("__n") > 0, F.col("__c") / F.col("__n")).otherwise(0.0)).drop("__c", "__n")


def uniform(support: DataFrame, n: int) -> DataFrame:
    return support.withColumn("w", F.lit(1.0 / n))


def support_answers(weighted: DataFrame, space: QuerySpace, weight: str = "w") -> DataFrame:
    """(query_id, ans): sums of weights by cell, not normalised."""
    return filled(sums(EncodedData(weighted, space.domain, weight), space), space.n_queries)


def query_matrix(space: QuerySpace, spark: SparkSession) -> DataFrame:
    """(query_id, required): for each attribute the value that a query asks for,
    -1 where it asks for none."""
    place = {a: i for i, a in enumerate(space.domain.attrs)}
    table = spark.createDataFrame([(w.wid, [place[a] for a in w.attrs]) for w in space.workloads], "wid int, idx array<int>")
    rows = space.queries(spark).join(F.broadcast(table), "wid")
    required = F.transform(F.sequence(F.lit(0), F.lit(len(place) - 1)), lambda i: F.coalesce(F.get("vals", F.array_position("idx", i).cast("int") - 1), F.lit(-1)))
    return rows.select("query_id", F.when(F.size("idx") > 0, required).alias("required"))


def indexed(support: DataFrame, space: QuerySpace) -> DataFrame:
    """The support with the query that counts each row in every workload, -1 where
    none does: found once, looked up in every pass."""
    return support.withColumn(CELLS, F.array(*[F.coalesce(w.cell(), F.lit(-1).cast("bigint")) for w in space.workloads]))


def running(weighted: DataFrame, key: str = "support_id", weight: str = "w") -> tuple[DataFrame, list[float]]:
    """(key, weight, r, hi) and edges: rows in ranges r of the key, with the
    running sum of weights up to and including each row; edges are the sums before
    each range, and the whole.  Weights are added up within ranges and then over
    the ranges, so no task holds the whole table."""
    parts = int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low, high = weighted.agg(F.min(key), F.max(key)).first()
    low, high = low or 0, high or 0
    width = max(1, -(-(high - low + 1) // parts))
    ranged = weighted.select(key, F.col(weight).cast("double").alias(weight), F.floor((F.col(key) - low) / width).cast("int").alias("r"))
    totals = {x["r"]: x["t"] for x in ranged.groupBy("r").agg(F.sum(weight).alias("t")).collect()}  # at most one row for each shuffle partition
    edges = [0.0]
    for r in range(parts):
        edges.append(edges[-1] + totals.get(r, 0.0))
    before = F.get(F.array(*[F.lit(float(x)) for x in edges]), F.col("r"))
    inner = Window.partitionBy("r").orderBy(key)
    return ranged.withColumn("hi", before + F.sum(weight).over(inner)), edges


def sample_support(weighted: DataFrame, n: int, seed: int = 0, key: str = "support_id", slice_: int = SLICE) -> DataFrame:
    """(draw, key): n rows drawn with replacement by weight.  A draw's number is
    hashed from the seed and the draw; it finds its range of keys by the ranges'
    edges, and there its row by search in the range's running sums.  Draws of one
    range are cut into slices, so a heavy row's draws are spread."""
    rows, edges = running(weighted, key)
    spark, whole = weighted.sparkSession, edges[-1]
    u = F.col("u") * F.lit(whole)
    table = F.array(*[F.lit(float(x)) for x in edges[1:]])
    steps = [1 << k for k in reversed(range(max(len(edges), 1).bit_length()))]
    range_of = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda lo, s: lo + F.when(F.coalesce(F.get(table, lo + s - 1) <= u, F.lit(False)), s).otherwise(0))
    draws = spark.range(n).select(F.col("id").alias("draw"), noise.uniform(seed, F.col("id")).alias("u")).select("draw", u.alias("u"), range_of.alias("r"))
    slices = draws.groupBy("r").agg(F.ceil(F.count(F.lit(1)) / slice_).cast("int").alias("slices"))  # at most one row for each range
    dealt = draws.join(F.broadcast(slices), "r").select("draw", "u", "r", F.pmod(F.xxhash64("draw"), F.col("slices")).cast("int").alias("part"))
    spread = rows.join(F.broadcast(slices), "r").select("r", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("part"), F.col(key).alias("k"), "hi")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        k, hi = right["k"].to_numpy(), right["hi"].to_numpy()
        order = np.argsort(k, kind="stable")
        at = np.searchsorted(np.round(hi[order], 12), np.round(left["u"].to_numpy(), 12), "right") if len(k) else np.empty(0, int)
        return pa.table({"draw": left["draw"] if len(k) else left["draw"].slice(0, 0), key: pa.array(k[order][np.minimum(at, len(k) - 1)] if len(k) else np.empty(0, np.int64))})

    return dealt.groupBy("r", "part").cogroup(spread.groupBy("r", "part")).applyInArrow(find, f"draw bigint, `{key}` bigint")
