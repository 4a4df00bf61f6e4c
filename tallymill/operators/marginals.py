"""Answers to all queries of a space, in one pass over the rows.

Strategies (the answers are the same):

inline   query ids as one literal array for each row; whole-stage code, good
         while the array is short
arrow    counts for each task by numpy: cuboids that cover the workloads are
         counted, then rolled up to these (plans/lattice.py); each task sends one
         row for each cell that it met, so the shuffle doesn't depend on the row
         count.  Cuboids of more than DENSE_CELLS cells together take several
         passes

Every strategy adds up before it shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import EncodedData, column
from ..plans.lattice import Cuboid, plan
from ..plans.workload import QuerySpace, Workload

INLINE_WORKLOADS, DENSE_CELLS = 3, 1 << 23
#: Workloads up to which a query's workload is found among literals.
LITERALS = 64


class Sums:
    """Weights summed by cell: in a table of all n cells, or, if these are too
    many, by sorting what has come in and sending it on."""

    def __init__(self, n: int, dense: int = DENSE_CELLS) -> None:
        self.n, self.total = n, np.zeros(n) if n <= dense else None
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray, weights: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
        self.held.append((ids, weights))
        self.size += len(ids)
        if self.size >= (max(self.n // 4, 1 << 18) if self.total is not None else 1 << 21):
            yield from self._flush(name)

    def _flush(self, name: str) -> Iterator[pa.RecordBatch]:
        if self.held:
            ids, weights = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.size = [], 0
            if self.total is not None:
                self.total += np.bincount(ids, weights, minlength=self.n)
            else:
                own, place = np.unique(ids, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.bincount(place, weights))], names=["query_id", name])

    def rest(self, name: str) -> Iterator[pa.RecordBatch]:
        """What hasn't been sent yet and is in no table."""
        yield from self._flush(name)

    def batches(self, name: str) -> Iterator[pa.RecordBatch]:
        """What hasn't been sent yet."""
        yield from self.rest(name)
        if self.total is not None:
            met = np.flatnonzero(self.total)
            yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(self.total[met])], names=["query_id", name])


def cell_ids(batch: pa.RecordBatch, workloads: Sequence[Workload]) -> np.ndarray:
    """workloads x rows: the query that counts each row, -1 where a code is
    missing or outside its domain."""
    out = np.empty((len(workloads), batch.num_rows), np.int64)
    codes = {a: batch.column(a).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for w in workloads for a in w.attrs}
    good = {(a, n): (codes[a] >= 0) & (codes[a] < n) for w in workloads for a, n in zip(w.attrs, w.sizes)}
    bad = {k: None if v.all() else ~v for k, v in good.items()}
    for k, w in enumerate(workloads):
        at = out[k]
        at[:] = w.offset
        for a, stride in zip(w.attrs, w.strides):
            at += codes[a] * stride if stride != 1 else codes[a]
        for a, n in zip(w.attrs, w.sizes):
            if bad[a, n] is not None:
                at[bad[a, n]] = -1
    return out


def flat(cells: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells of all workloads in a row, each with its row's weight; none of -1."""
    ids, w = cells.ravel(), np.tile(weights, len(cells))
    ok = ids >= 0
    return (ids, w) if ok.all() else (ids[ok], w[ok])


def sums(data: EncodedData, space: QuerySpace, strategy: str = "auto", dense: int = DENSE_CELLS) -> DataFrame:
    """(query_id, ans) of the cells that rows fall in, ans the sum of weights."""
    if strategy == "auto":
        strategy = "inline" if len(space.workloads) <= INLINE_WORKLOADS else "arrow"
    rows = data.df.select(*[column(a) for a in space.attrs], data.mass().alias("__w"))
    if strategy == "inline":
        cells = rows.select("__w", F.explode(F.array(*[w.cell() for w in space.workloads])).alias("query_id"))
        return cells.where("query_id IS NOT NULL").groupBy("query_id").agg(F.sum("__w").alias("ans"))
    if strategy != "arrow":
        raise ValueError(strategy)
    out = None
    for together in plan(space.workloads, dense) or [[]]:
        part = _counted(rows, together, dense)
        out = part if out is None else out.unionByName(part)
    return out


def _counted(rows: DataFrame, cuboids: Sequence[Cuboid], dense: int) -> DataFrame:
    """The sums of some cuboids' workloads, by one pass."""
    starts = [0, *accumulate(c.n_cells for c in cuboids)]
    attrs = list(dict.fromkeys(a for c in cuboids for a in c.attrs))

    def rolled(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Of cells that were met."""
        ids, sums = part.column(0).to_numpy(), part.column(1).to_numpy()
        cuts = np.searchsorted(ids, starts)
        for c, first, a, b in zip(cuboids, starts, cuts, cuts[1:]):
            for found in c.rolled_some(ids[a:b] - first, sums[a:b]) if b > a else ():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "ans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Sums(starts[-1], dense)
        for batch in batches:
            if batch.num_rows and cuboids:
                codes = {a: batch.column(a).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for a in attrs}
                codes = codes or {"": np.zeros(batch.num_rows, np.int64)}
                cells = np.concatenate([first + c.cells(codes) for c, first in zip(cuboids, starts)])
                for part in held.add(cells, np.tile(batch.column("__w").to_numpy(zero_copy_only=False), len(cuboids)), "ans"):
                    yield from rolled(part)
        for part in held.rest("ans"):
            yield from rolled(part)
        if held.total is not None and held.total.any():
            found = [x for c, first in zip(cuboids, starts) for x in c.rolled(held.total[first : first + c.n_cells])]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["query_id", "ans"])

    found = rows.select(*[column(a) for a in attrs], "__w").mapInArrow(run, "query_id bigint, ans double")
    return found.groupBy("query_id").agg(F.sum("ans").alias("ans"))


def filled(found: DataFrame, n_queries: int, value: str = "ans") -> DataFrame:
    """One row for every query; 0 where nothing was found."""
    ids = found.sparkSession.range(n_queries).select(F.col("id").alias("query_id"))
    return ids.join(found, "query_id", "left").select("query_id", F.coalesce(value, F.lit(0.0)).alias("ans"))


def answers(data: EncodedData, space: QuerySpace, density: str | None = "valid", strategy: str = "auto") -> DataFrame:
    """(query_id, ans) for every query.  density: 'valid' divides by the weight
    of a workload's rows whose codes are all in the domain, 'all' by the weight
    of all rows, None by nothing."""
    whole = data.df.agg(F.sum(data.mass()).alias("__all")) if density == "all" else None
    return finished(sums(data, space, strategy), space, density, whole)


def finished(found: DataFrame, space: QuerySpace, density: str | None, whole: DataFrame | None = None) -> DataFrame:
    """answers from the sums of the cells that rows fall in; whole is one row with
    the weight of all rows, __all."""
    dense = filled(found, space.n_queries)
    if density is None:
        return dense
    if density == "all":
        return dense.join(F.broadcast(whole)).select("query_id", F.when(F.col("__all") > 0, F.col("ans") / F.col("__all")).otherwise(0.0).alias("ans"))
    if density != "valid":
        raise ValueError(density)
    by = dense.withColumn("wid", workload_column(space))
    totals = by.groupBy("wid").agg(F.sum("ans").alias("__all"))
    return by.join(F.broadcast(totals), "wid").select("query_id", F.when(F.col("__all") > 0, F.col("ans") / F.col("__all")).otherwise(0.0).alias("ans"))


def workload_column(space: QuerySpace, query_id: str = "query_id") -> Column:
    """The workload of a query id: by halving over the literal offsets, or, among
    many workloads, by search in Arrow batches."""
    if len(space.workloads) > LITERALS:
        starts = space.starts

        @F.pandas_udf("int")
        def search(ids: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(starts, ids.to_numpy(), "right") - 1)

        return search(F.col(query_id))
    starts = F.array(*[F.lit(w.offset).cast("bigint") for w in space.workloads])
    steps = [1 << k for k in reversed(range(max(1, len(space.workloads).bit_length())))]
    halve = lambda lo, s: lo + F.when(F.coalesce(F.get(starts, lo + s) <= F.col(query_id), F.lit(False)), s).otherwise(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def by_workload(found: DataFrame, space: QuerySpace) -> DataFrame:
    """(wid, answers): each workload's answers in the order of its cells."""
    rows = found.withColumn("wid", workload_column(space))
    return rows.groupBy("wid").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "ans"))), lambda x: x["ans"]).alias("answers"))


def aggregate_answers(found: DataFrame, bridge: DataFrame) -> DataFrame:
    """(agg_id, ans): sums of member cells; bridge is (agg_id, query_id)."""
    return bridge.join(found, "query_id").groupBy("agg_id").agg(F.sum("ans").alias("ans"))


def random_bridge(space: QuerySpace, seed: int = 0, most: int = 9) -> list[tuple[int, int]]:
    """One random set of at most ``most`` cells for each workload."""
    rng = np.random.RandomState(seed)
    out = []
    for i, w in enumerate(space.workloads):
        k = rng.randint(1, min(most, w.n_cells) + 1)
        out += [(i, int(w.offset + c)) for c in sorted(rng.choice(w.n_cells, k, replace=False))]
    return out


def joint_sum(p: np.ndarray, w: Workload, at: Mapping[str, int], block: int = 256) -> np.ndarray:
    """A workload's cells, each the sum over rows of the product of its places.
    Rows go in blocks, so that no table is larger than a block of rows by the
    workload's cells."""
    own = np.zeros(w.n_cells)
    for s in range(0, len(p), block):
        part = p[s : s + block]
        joint = np.ones((len(part), 1))
        for a, n in zip(w.attrs[:-1], w.sizes[:-1]):
            joint = (joint[:, :, None] * part[:, None, at[a] : at[a] + n]).reshape(len(part), -1)
        if w.attrs:  # the last attribute by a matrix product, summed over rows at once
            own += (joint.T @ part[:, at[w.attrs[-1]] : at[w.attrs[-1]] + w.sizes[-1]]).ravel()
        else:
            own += len(part)
    return own


def soft_answers(p: np.ndarray, space: QuerySpace, wids: Sequence[int] | None = None, block: int = 256) -> np.ndarray:
    """Answers of probabilistic rows: p is rows x one-hot places; a cell's answer
    is the mean over rows of the product of its places.  wids: only these
    workloads are answered, the others' cells are 0."""
    at, out = space.domain.offsets(), np.zeros(space.n_queries)
    for w in space.workloads if wids is None else (space.workloads[k] for k in wids):
        out[w.offset : w.offset + w.n_cells] = joint_sum(p, w, at, block) / len(p)
    return out


def soft_answers_of_rows(rows: DataFrame, space: QuerySpace, dense: int = DENSE_CELLS) -> DataFrame:
    """(query_id, ans), soft_answers over rows (k, attr, value, p): each k's places
    meet in one row, as many as the domain has; then tasks contract their rows for
    all workloads of a pass and send one sum for each cell."""
    at, width = space.domain.offsets(), sum(space.domain.shape)
    starts = F.create_map(*[F.lit(x) for a, n in at.items() for x in (a, n)])
    sizes = F.create_map(*[F.lit(x) for a, n in space.domain.config.items() for x in (a, n)])
    known = F.col("value").between(0, F.element_at(sizes, F.col("attr")) - 1)
    entry = F.when(known, F.struct((F.element_at(starts, F.col("attr")) + F.col("value")).cast("int").alias("at"), F.col("p").cast("double").alias("p")))
    vectors = rows.groupBy("k").agg(F.collect_list(entry).alias("v")).select("v")
    packed, size = [[]], 0
    for w in space.workloads:
        if packed[-1] and size + w.n_cells > dense:
            packed, size = [*packed, []], 0
        packed[-1].append(w)
        size += w.n_cells
    out = None
    for own in packed:
        part = vectors.mapInArrow(_contracting(own, at, width), "query_id bigint, s double, n bigint")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id").agg((F.sum("s") / F.sum("n")).alias("ans"))


def _contracting(workloads: Sequence[Workload], at: Mapping[str, int], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [np.zeros(w.n_cells) for w in workloads], 0
        for batch in batches:
            if batch.num_rows:
                lists = batch.column("v")
                flat, row = lists.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                p = np.zeros((batch.num_rows, width))
                np.add.at(p, (row, flat.field("at").to_numpy()), flat.field("p").to_numpy(zero_copy_only=False))
                for own, w in zip(total, workloads):
                    own += joint_sum(p, w, at)
                n += batch.num_rows
        if n:
            for own, w in zip(total, workloads):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(w.offset, w.offset + w.n_cells)), pa.array(own), pa.array(np.full(w.n_cells, n))], names=["query_id", "s", "n"])

    return run
