"""Errors of answers, worst queries, best runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(true: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, true, found, score): score is the absolute difference."""
    t, f = true.select("query_id", F.col("ans").alias("true")), found.select("query_id", F.col("ans").alias("found"))
    return t.join(f, "query_id").withColumn("score", F.abs(F.col("true") - F.col("found")))


def errors(true: DataFrame, found: DataFrame) -> DataFrame:
    """One row: error_max, error_mean, error_mean_squared."""
    s = F.col("score")
    return differences(true, found).agg(F.max(s).alias("error_max"), F.avg(s).alias("error_mean"), (F.sum(s * s) / F.count(s)).alias("error_mean_squared"))


def top_errors(true: DataFrame, found: DataFrame, k: int = 1) -> DataFrame:
    """The k largest differences; equal ones by query."""
    d = differences(true, found).withColumn("score", F.round("score", 9))
    return d.orderBy(F.desc("score"), "query_id").limit(k)


def excluding(scores: DataFrame, past: DataFrame) -> DataFrame:
    """Scores of queries that aren't among past (query_id)."""
    return scores.join(past, "query_id", "left_anti")


def above(scores: DataFrame, factor: float) -> DataFrame:
    """Scores of at least factor times the largest."""
    top = scores.agg(F.max("score").alias("__top"))
    return scores.join(F.broadcast(top)).where(F.col("score") >= factor * F.col("__top")).drop("__top")


def best_runs(results: DataFrame, config: Sequence[str], error: str = "error_max", rounds: bool = True) -> DataFrame:
    """For each configuration the run of least error (nulls in it count as a
    value of their own); with rounds, T times the number of workloads."""
    if rounds:
        results = results.withColumn("rounds", (F.col("T") * F.col("workload")).cast("int"))
    whole = F.struct(error, *[c for c in results.columns if c != error])
    return results.groupBy(*config).agg(F.min_by(whole, F.col(error)).alias("b")).select("b.*").select(*results.columns)
