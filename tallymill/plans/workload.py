"""Workloads of marginal queries and the numbering of their cells.

A workload is a set of attributes; its queries are the cells of their joint
table.  Attributes within a workload and workloads among themselves are sorted,
duplicates stay, and cells are numbered with the last attribute fastest:

    query_id = offset of the workload + sum of value * stride
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from itertools import accumulate, combinations
from math import prod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import Domain, column

WORKLOAD_SCHEMA = "wid int, attrs array<string>, idx array<int>, sizes array<int>, strides array<bigint>, n_cells bigint, offset bigint"


def all_workloads(domain: Domain, k: int) -> list[tuple[str, ...]]:
    return list(combinations(domain.attrs, k))


def random_workloads(domain: Domain, n: int, k: int, seed: int = 0, most_cells: int | None = None) -> list[tuple[str, ...]]:
    """n of the k-way workloads without replacement, by NumPy's legacy
    generator; most_cells leaves out larger ones first."""
    every = [w for w in all_workloads(domain, k) if most_cells is None or domain.size(w) <= most_cells]
    chosen = np.random.RandomState(seed).choice(len(every), min(n, len(every)), replace=False)
    return [every[i] for i in chosen]


def count_queries(domain: Domain, workloads: Iterable[Sequence[str]]) -> int:
    return sum(domain.size(w) for w in workloads)


@dataclass(frozen=True)
class Workload:
    wid: int
    attrs: tuple[str, ...]
    sizes: tuple[int, ...]
    offset: int

    @property
    def n_cells(self) -> int:
        return prod(self.sizes)

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(prod(self.sizes[i + 1 :]) for i in range(len(self.sizes)))

    def valid(self) -> Column:
        ok = F.lit(True)
        for a, n in zip(self.attrs, self.sizes):
            ok = ok & column(a).between(0, n - 1)
        return ok

    def cell(self) -> Column:
        """The query that a row falls in; null if a code is outside its domain
        or missing."""
        at = F.lit(self.offset).cast("bigint")
        for a, s in zip(self.attrs, self.strides):
            at = at + column(a) * F.lit(s).cast("bigint")
        return F.when(self.valid(), at)

    def decode(self, query_id: Column) -> Column:
        return F.array(*[F.pmod(F.floor((query_id - self.offset) / s), F.lit(n)).cast("int") for s, n in zip(self.strides, self.sizes)])


class QuerySpace:
    """All queries of a list of workloads over a domain."""

    def __init__(self, domain: Domain, workloads: Iterable[str | Sequence[str]], ordered: bool = True) -> None:
        named = [(w,) if isinstance(w, str) else tuple(w) for w in workloads]
        named = sorted(tuple(sorted(w)) for w in named) if ordered else named
        cells = [domain.size(w) for w in named]
        starts = [0, *accumulate(cells)]
        self.domain, self.n_queries, self.starts = domain, starts[-1], np.array(starts[:-1], np.int64)
        self.workloads = [Workload(i, w, tuple(domain[a] for a in w), starts[i]) for i, w in enumerate(named)]

    def __reduce__(self):
        """A task gets the workloads as two arrays, attribute numbers in a row and
        how many each workload has, not as objects."""
        place = {a: i for i, a in enumerate(self.domain.attrs)}
        flat = np.array([place[a] for w in self.workloads for a in w.attrs], np.int32)
        return _unpacked, (self.domain, flat, np.array([len(w.attrs) for w in self.workloads], np.int32))

    @property
    def attrs(self) -> list[str]:
        used = {a for w in self.workloads for a in w.attrs}
        return [a for a in self.domain.attrs if a in used]

    def table(self, spark: SparkSession) -> DataFrame:
        """The workloads as rows."""
        rows = [(w.wid, list(w.attrs), list(self.domain.axes(w.attrs)), list(w.sizes), list(w.strides), w.n_cells, w.offset) for w in self.workloads]
        return spark.createDataFrame(rows, WORKLOAD_SCHEMA)

    def queries(self, spark: SparkSession) -> DataFrame:
        """(query_id, wid, vals): every cell, decoded by its strides."""
        t = self.table(spark).select("wid", "sizes", "strides", "offset", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_cells") - 1)).alias("cell"))
        vals = F.zip_with("sizes", "strides", lambda n, s: F.pmod(F.floor(F.col("cell") / s), n.cast("bigint")).cast("int"))
        return t.select((F.col("offset") + F.col("cell")).alias("query_id"), "wid", vals.alias("vals"))

    def workload_of(self, query_id: int) -> Workload:
        if not 0 <= query_id < self.n_queries:
            raise IndexError(query_id)
        return self.workloads[int(np.searchsorted(self.starts, query_id, "right")) - 1]

    def values(self, query_id: int) -> dict[str, int]:
        w = self.workload_of(query_id)
        return {a: (query_id - w.offset) // s % n for a, s, n in zip(w.attrs, w.strides, w.sizes)}

    def describe(self, query_id: int) -> str:
        return " | ".join(f"{a}={v}" for a, v in self.values(query_id).items())

    def lookup(self, values: Mapping[str, int]) -> int | None:
        """The first query with these values; None if there is none."""
        asked = tuple(sorted(values))
        for w in self.workloads:
            if w.attrs == asked:
                if all(0 <= values[a] < n for a, n in zip(w.attrs, w.sizes)):
                    return w.offset + sum(values[a] * s for a, s in zip(w.attrs, w.strides))
                return None
        return None

    def matches(self, query_id: int) -> Column:
        """Whether a row is counted by a query."""
        ok = F.lit(True)
        for a, v in self.values(query_id).items():
            ok = ok & (column(a) == v)
        return F.coalesce(ok, F.lit(False))

    def positions(self, query_id: int) -> list[int]:
        """The query's places in a one-hot row."""
        at = self.domain.offsets()
        return [at[a] + v for a, v in self.values(query_id).items()]

    def filter_workloads(self, wids: Iterable[int]) -> QuerySpace:
        """A space of the workloads asked for, numbered anew."""
        keep = set(wids)
        return QuerySpace(self.domain, [w.attrs for w in self.workloads if w.wid in keep], ordered=False)

    def query_mask(self, wids: Iterable[int]) -> list[int]:
        """The queries, in this space's numbers, of the workloads asked for."""
        keep = set(wids)
        return [q for w in self.workloads if w.wid in keep for q in range(w.offset, w.offset + w.n_cells)]

    def sensitivity(self, n: int) -> float:
        return 1.0 / n


def _unpacked(domain: Domain, flat: np.ndarray, lengths: np.ndarray) -> QuerySpace:
    names = [domain.attrs[i] for i in flat.tolist()]
    ends = np.cumsum(lengths).tolist()
    return QuerySpace(domain, [tuple(names[b - n : b]) for n, b in zip(lengths.tolist(), ends)], ordered=False)
