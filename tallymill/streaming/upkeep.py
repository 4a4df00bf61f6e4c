"""Answers kept up to date over a stream: counting queries add up, so each new
row adds to the cells that it falls in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..domain import column
from ..plans.workload import QuerySpace
from ..sources.answers import AnswerStore


def _cells(rows: DataFrame, space: QuerySpace, *keep: str) -> DataFrame:
    hits = F.explode(F.array(*[w.cell() for w in space.workloads])).alias("query_id")
    return rows.select(*[column(k) for k in keep], hits).where("query_id IS NOT NULL")


def running_counts(rows: DataFrame, space: QuerySpace) -> DataFrame:
    """(query_id, n) over all rows so far (output modes update and complete)."""
    return _cells(rows, space).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(rows: DataFrame, space: QuerySpace, time: str, width: str, late: str) -> DataFrame:
    """(window, query_id, n); rows later than ``late`` behind the newest are
    dropped and finished windows leave the state."""
    marked = rows.withWatermark(time, late)
    return _cells(marked, space, time).groupBy(F.window(time, width), "query_id").agg(F.count(F.lit(1)).alias("n"))


def into_store(rows: DataFrame, store: AnswerStore, name: str, checkpoint: str, **trigger):
    """Starts a query that adds each batch of raw rows to a store of answers, where
    it is counted by the passes that tables are counted by.  A batch that is
    written again after a failure takes its first writing's place."""
    return rows.writeStream.foreachBatch(lambda batch, i: store.add_rows(batch, f"{name}:{i}")).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
