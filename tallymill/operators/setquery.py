"""Counts of conjunctions of IN-lists, over rows and over probabilistic rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..domain import Domain, EncodedData, column

SetQuery = Mapping[str, Sequence]
#: Rows that meet the queries' tables at once; sums that a task holds before it sends them.
BLOCK, MOST = 1024, 1 << 22
#: Queries up to which one pass of conditional sums is used.
INLINE = 16
#: Queries for each class from which sums along an attribute are used.
FEWER = 4


def canonical(query: SetQuery) -> tuple:
    """Equal for queries that allow the same values; empty lists are wildcards."""
    return tuple(sorted((a, tuple(sorted(set(vs)))) for a, vs in query.items() if len(vs)))


def distinct(queries: Iterable[SetQuery]) -> list[dict[str, tuple]]:
    """Without repetitions, in the order of first appearance."""
    return [dict(key) for key in dict.fromkeys(canonical(q) for q in queries)]


def attribute_sets(queries: Iterable[SetQuery]) -> list[tuple[str, ...]]:
    """The attribute sets that queries restrict, by length, then by name."""
    return sorted({tuple(a for a, _ in canonical(q)) for q in queries}, key=lambda w: (len(w), w))


def predicate(query: SetQuery) -> Column:
    ok = F.lit(True)
    for a, vs in query.items():
        if len(vs):
            ok = ok & column(a).isin(list(vs))
    return F.coalesce(ok, F.lit(False))


class SetSpace:
    """A list of set queries over a domain, in a form that numpy evaluates: for
    each attribute a table of which value is allowed by which query."""

    def __init__(self, domain: Domain, queries: Sequence[SetQuery]) -> None:
        self.domain, self.asked = domain, [dict(canonical(q)) for q in queries]
        self.attrs = [a for a in domain.attrs if any(a in q for q in self.asked)]

    @property
    def n_queries(self) -> int:
        return len(self.asked)

    def tables(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """attribute: sorted values that any query names, and their allowed
        queries (values + 1 x queries; the last row is for all other values)."""
        out = {}
        for a in self.attrs:
            values = np.array(sorted({v for q in self.asked for v in q.get(a, ())}))
            allowed = np.zeros((len(values) + 1, len(self.asked)), bool)
            for k, q in enumerate(self.asked):
                allowed[np.searchsorted(values, np.array(q[a])) if a in q else slice(None), k] = True
            out[a] = values, allowed
        return out

    def masks(self) -> dict[str, np.ndarray]:
        """attribute: codes x queries, 1 where a code is allowed."""
        return {a: np.array([[1.0 if a not in q or v in q[a] else 0.0 for q in self.asked] for v in range(self.domain[a])]) for a in self.attrs}


def set_answers(data: EncodedData, queries: Sequence[SetQuery], density: bool = True, by: Sequence[str] = (), strategy: str = "auto") -> DataFrame:
    """(qid, ans), or (by..., qid, ans) for every group of by that has rows;
    density divides by the weight of all rows, or of the group.

    inline   one pass with a conditional sum for each query, for few queries
    tables   rows are counted by the values of the queries' attributes first; each
             different row then finds the queries that count it by one look-up for
             each attribute.  A task sends one row for each query and group
    bands    if the queries ask for bands of one attribute (ages, say) within a few
             classes of the others: the rows of a class are summed up along the
             attribute, and a band is the difference of two such sums, so the work
             is in rows times classes, plus cells"""
    n, by = len(queries), list(by)
    bands = banded(queries) if strategy in ("auto", "bands") else None
    if strategy == "auto":
        strategy = "inline" if n <= INLINE and not by else "bands" if bands and FEWER * len(bands.classes) <= n else "tables"
    if strategy == "bands" and bands is None:
        raise ValueError("no attribute is asked for in bands by all queries")
    found = _inline(data, queries) if strategy == "inline" else _bands(data, bands, by) if strategy == "bands" else _tables(data, SetSpace(data.domain, queries), by)
    own = [column(b) for b in by]
    ans = F.when(F.col("t") > 0, F.col("s") / F.col("t")).otherwise(0.0) if density else F.col("s")
    whole = found.select(*own, "qid", ans.alias("ans"))
    if by:
        return whole
    ids = data.df.sparkSession.range(n).select(F.col("id").cast("int").alias("qid"))
    return ids.join(whole, "qid", "left").select("qid", F.coalesce("ans", F.lit(0.0)).alias("ans"))


def _inline(data: EncodedData, queries: Sequence[SetQuery]) -> DataFrame:
    w = data.mass()
    parts = [F.struct(F.lit(i).alias("qid"), F.coalesce(F.sum(F.when(predicate(q), w)), F.lit(0.0)).alias("s")) for i, q in enumerate(queries)]
    parts = F.array(*parts) if parts else F.array().cast("array<struct<qid:int,s:double>>")
    return data.df.agg(parts.alias("r"), F.coalesce(F.sum(w), F.lit(0.0)).alias("t")).select(F.explode("r").alias("r"), "t").select("r.qid", "r.s", "t")


def _tables(data: EncodedData, space: SetSpace, by: list[str]) -> DataFrame:
    """(by..., qid, s, t): sums of weights by query, and of a group's rows."""
    tables, n = space.tables(), space.n_queries
    counts = data.df.groupBy(*[column(a) for a in dict.fromkeys([*by, *space.attrs])]).agg(F.sum(data.mass()).alias("__n"))
    fields = [data.df.schema[b] for b in by]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def sent(total: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for key, sums in total.items():
            columns = [*[pa.array([v] * n, kind) for v, kind in zip(key, kinds)], pa.array(np.arange(n, dtype=np.int32)), pa.array(sums[:-1]), pa.array(np.full(n, sums[-1]))]
            yield pa.RecordBatch.from_arrays(columns, names=[*by, "qid", "s", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            weights, places = batch.column("__n").to_numpy(zero_copy_only=False), _places(batch, tables)
            keys = list(zip(*[batch.column(b).to_pylist() for b in by])) if by else [()] * batch.num_rows
            groups = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            names, which = list(groups), np.array([groups[k] for k in keys], int)
            order = np.argsort(which, kind="stable")
            for s in range(0, len(order), BLOCK):
                rows = order[s : s + BLOCK]
                met = np.ones((len(rows), n + 1), bool)
                for a, (_, allowed) in tables.items():
                    met[:, :n] &= allowed[places[a][rows]]
                for g, first, last in _runs(which[rows]):
                    sums = weights[rows[first:last]] @ met[first:last]
                    total[names[g]] = total[names[g]] + sums if names[g] in total else sums
            if len(total) * (n + 1) > MOST:
                yield from sent(total)
                total = {}
        yield from sent(total)

    schema = StructType([*fields, StructField("qid", IntegerType()), StructField("s", DoubleType()), StructField("t", DoubleType())])
    # every task that has rows of a group sends all its queries, so the sums of t agree
    return counts.mapInArrow(run, schema).groupBy(*[column(b) for b in by], "qid").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


@dataclass(frozen=True)
class Banded:
    """Queries as (class, first, end) along an attribute; a class is what they ask
    of the others, and first None means any value, missing ones too."""

    axis: str
    classes: list[dict[str, tuple]]
    queries: list[tuple[int, int | None, int | None]]


def banded(queries: Sequence[SetQuery]) -> Banded | None:
    """The attribute that leaves the fewest classes, of those that every query
    leaves free or asks for in one run of integers; None if there is none."""
    asked, best = [dict(canonical(q)) for q in queries], None
    for axis in sorted({a for q in asked for a in q}):
        runs = [q.get(axis) for q in asked]
        if not all(r is None or (all(isinstance(v, int) for v in r) and r[0] >= 0 and r[-1] - r[0] == len(r) - 1) for r in runs):
            continue
        rest = [tuple((a, v) for a, v in q.items() if a != axis) for q in asked]
        place = {c: k for k, c in enumerate(dict.fromkeys(rest))}
        if best is None or len(place) < len(best.classes):
            best = Banded(axis, [dict(c) for c in place], [(place[c], r and r[0], r and r[-1] + 1) for c, r in zip(rest, runs)])
    return best


def _places(batch: pa.RecordBatch, tables: Mapping[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """Each row's place among the values that queries name, by attribute."""
    out = {}
    for a, (values, _) in tables.items():
        valid = batch.column(a).is_valid().to_numpy(zero_copy_only=False)
        own = batch.column(a).fill_null(values[0].item()).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(values, own), len(values) - 1)
        out[a] = np.where((values[at] == own) & valid, at, len(values))
    return out


def _bands(data: EncodedData, bands: Banded, by: list[str]) -> DataFrame:
    """As _tables."""
    space, n = SetSpace(data.domain, bands.classes), len(bands.queries)
    tables, size = space.tables(), max((end for _, _, end in bands.queries if end), default=0)
    counts = data.df.groupBy(*[column(a) for a in dict.fromkeys([*by, bands.axis, *space.attrs])]).agg(F.sum(data.mass()).alias("__n"))
    if by:  # a group has as many rows as its codes allow
        counts = counts.repartition(*[column(b) for b in by]).sortWithinPartitions(*[column(b) for b in by])
    fields = [data.df.schema[b] for b in by]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    of_class = [[(k, first, end) for k, (c, first, end) in enumerate(bands.queries) if c == own] for own in range(len(bands.classes))]

    def answered(keys: list[tuple], group: np.ndarray, met: np.ndarray, at: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        sums, whole = np.zeros((len(keys), n)), np.bincount(group, w, minlength=len(keys))
        for own, asked in enumerate(of_class):
            hit = met[:, own]
            along = np.zeros((len(keys), size + 1))  # [:, v + 1] of value v, then summed up
            inside = hit & (at >= 0)
            np.add.at(along, (group[inside], at[inside] + 1), w[inside])
            along = along.cumsum(axis=1)
            every = np.bincount(group[hit], w[hit], minlength=len(keys))
            for k, first, end in asked:
                sums[:, k] = every if first is None else along[:, end] - along[:, first]
        columns = [pa.array([v for v in values for _ in range(n)], kind) for values, kind in zip(zip(*keys), kinds)]
        columns += [pa.array(np.tile(np.arange(n, dtype=np.int32), len(keys))), pa.array(sums.ravel()), pa.array(np.repeat(whole, n))]
        return pa.RecordBatch.from_arrays(columns, names=[*by, "qid", "s", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            w, places = batch.column("__n").to_numpy(zero_copy_only=False), _places(batch, tables)
            met = np.ones((batch.num_rows, len(bands.classes)), bool)
            for a, (_, allowed) in tables.items():
                met &= allowed[places[a]]
            code = batch.column(bands.axis).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.where((code >= 0) & (code < size), code, -1)
            keys = list(zip(*[batch.column(b).to_pylist() for b in by])) if by else [()] * batch.num_rows
            groups = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            which, names, step = np.array([groups[k] for k in keys]), list(groups), max(1, (1 << 20) // n)
            for first in range(0, len(names), step):
                own = (which >= first) & (which < first + step)
                yield answered(names[first : first + step], which[own] - first, met[own], at[own], w[own])

    schema = StructType([*fields, StructField("qid", IntegerType()), StructField("s", DoubleType()), StructField("t", DoubleType())])
    return counts.mapInArrow(run, schema).groupBy(*[column(b) for b in by], "qid").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))


def _runs(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, last) of each run of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(sorted_)) + 1).tolist(), len(sorted_)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(sorted_[a]), a, b


def relation(spark: SparkSession, queries: Sequence[SetQuery]) -> DataFrame:
    rows = [(q, a, int(v)) for q, query in enumerate(queries) for a, vs in canonical(query) for v in vs]
    return spark.createDataFrame(rows, "qid int, attr string, value int")


def soft_set_answers_sql(rows: DataFrame, queries: Sequence[SetQuery]) -> DataFrame:
    """(qid, ans) over probabilistic rows (k, attr, value, p): the mean over k of
    the product, over a query's attributes, of the allowed values' sum of p."""
    spark = rows.sparkSession
    table = relation(spark, queries)  # the query list, whose size is not the data's
    sums = rows.join(F.broadcast(table), ["attr", "value"]).groupBy("k", "qid", "attr").agg(F.sum("p").alias("p"))
    need = spark.createDataFrame([(i, len(canonical(q))) for i, q in enumerate(queries)], "qid int, need int")
    products = sums.groupBy("k", "qid").agg(F.product("p").alias("p"), F.count(F.lit(1)).alias("n"))
    met = products.join(F.broadcast(need), "qid").where("n = need").groupBy("qid").agg(F.sum("p").alias("p"))
    n_rows = rows.agg(F.countDistinct("k").alias("n_rows"))
    share = F.when(F.col("need") == 0, 1.0).otherwise(F.coalesce("p", F.lit(0.0)) / F.col("n_rows"))
    return need.join(met, "qid", "left").join(F.broadcast(n_rows)).select("qid", share.alias("ans"))


def soft_set_answers(p: np.ndarray, space: SetSpace) -> np.ndarray:
    """The same over rows x one-hot places."""
    at, out = space.domain.offsets(), np.ones((len(p), space.n_queries))
    for a, mask in space.masks().items():
        out *= p[:, at[a] : at[a] + space.domain[a]] @ mask
    return out.mean(axis=0)


def soft_set_gradient(p: np.ndarray, space: SetSpace, up: np.ndarray) -> np.ndarray:
    """The loss's gradient by p, from its gradient by the answers."""
    at, masks, out = space.domain.offsets(), space.masks(), np.zeros_like(p)
    sums = {a: p[:, at[a] : at[a] + space.domain[a]] @ mask for a, mask in masks.items()}
    for a, mask in masks.items():
        others = np.ones((len(p), space.n_queries))
        for b, x in sums.items():
            if b != a:
                others *= x
        out[:, at[a] : at[a] + space.domain[a]] = (others * up / len(p)) @ mask.T
    return out
