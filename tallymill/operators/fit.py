"""Reweighted histograms fitted to answers: multiplicative weights and entropy
projection, with exact or with private selection and measurement.

A fitted histogram is its starting weights and one eta for each query that was
moved: a row's weight is w0 * exp(sum of the etas of the queries that count it).
Answers stand beside the true ones in a table.  A round moves a few queries, so
only the rows that these count are read again, and what they add to the sums of
all cells is added to it; after REFRESH rounds it is summed anew.

Inner projections need the measured queries only, so they run on the support's
quotient: rows that the same measured queries count have one common factor and
are one class.  A round's projections then are one pass over the support, however
many there are.  Single rows reach the driver, the answers of single measured
queries (one for each round before) and at most CLASSES classes; with more of
these, each projection is a pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workload import QuerySpace
from ..storage import stored
from . import privacy
from .marginals import DENSE_CELLS, Sums, cell_ids, filled, flat, workload_column
from .support import CELLS, indexed

EDGE = 1e-6
#: Rounds, and moved queries, after which the answers are summed anew.
REFRESH, TOLD = 16, 64
#: Classes of a quotient, and measured queries, that one process iterates over.
CLASSES = 1 << 18
PAST = "i bigint, query_id bigint, measured double"


def projection_step(measured: float, current: float) -> float:
    """The eta that brings a query's answer from current to measured at once."""
    a, b = (min(max(x, EDGE), 1 - EDGE) for x in (measured, current))
    return math.log(a * (1 - b) / ((1 - a) * b))


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of numbers as literals, which need no task."""
    kinds = [part.split() for part in schema.split(", ")]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(k).alias(n) for n, k in kinds])
    values = ", ".join("(" + ", ".join(f"CAST('{x!r}' AS {k})" for x, (_, k) in zip(r, kinds)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(n for n, _ in kinds)})")


class _Etas:
    """Etas by query; a cell of -1 has none."""

    def __init__(self, etas: dict[int, float], n: int) -> None:
        self.q = np.array(sorted(etas), np.int64)
        self.eta = np.array([etas[q] for q in self.q.tolist()], np.float64)
        self.n = n

    def powers(self, cells: np.ndarray) -> np.ndarray:
        """The sum of etas of each row's cells (workloads x rows)."""
        if not len(self.q):
            return np.zeros(cells.shape[1])
        if self.n <= DENSE_CELLS:
            table = np.zeros(self.n + 1)
            table[self.q] = self.eta
            return table[cells].sum(axis=0)
        at = np.minimum(np.searchsorted(self.q, cells), len(self.q) - 1)
        return np.where(self.q[at] == cells, self.eta[at], 0.0).sum(axis=0)


class Histogram:
    """support: codes and w.  index: whether the support is stored with the query
    that counts each row in every workload (8 bytes each); without, a pass finds
    these anew from the codes, which is faster unless workloads are long."""

    def __init__(self, support: DataFrame, space: QuerySpace, index: bool = False) -> None:
        self.space, self.etas = space, {}
        self.snapshots: list[dict[int, float]] = []
        self.log: list[dict[str, float]] = []
        own = support.drop(CELLS)
        self.support = stored(indexed(own, space) if index else own)

    @property
    def spark(self) -> SparkSession:
        return self.support.sparkSession

    def update(self, query: int, eta: float) -> None:
        self.etas[query] = self.etas.get(query, 0.0) + eta

    def snapshot(self) -> None:
        """Counts the weights as they are now in the average."""
        self.snapshots.append(dict(self.etas))

    def _pass(self, use, schema: str, keep: bool = False, where: Column | None = None) -> DataFrame:
        """use(cells, w0, batch) for every batch, then use(None) at the end."""
        support = self.support if where is None else self.support.where(where)
        space, rows = self.space, support if keep else support.select(*([CELLS] if CELLS in self.support.columns else [F.col(f"`{a}`") for a in self.space.attrs]), "w")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = use()
            for batch in batches:
                if batch.num_rows:
                    if CELLS in batch.schema.names:
                        cells = batch.column(CELLS).flatten().to_numpy().reshape(batch.num_rows, -1).T
                    else:
                        cells = cell_ids(batch, space.workloads)
                    yield from work(cells, batch.column("w").to_numpy(), batch)
            yield from work(None, None, None)

        return rows.mapInArrow(run, schema)

    def sums(self) -> DataFrame:
        """(query_id, s) of every query that counts a row; -1 is the whole."""
        etas, n = _Etas(self.etas, self.space.n_queries), self.space.n_queries

        def use():
            held, whole = Sums(n), 0.0

            def work(cells, w0, _):
                nonlocal whole
                if cells is None:
                    yield from held.batches("s")
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([whole])], names=["query_id", "s"])
                    return
                w = w0 * np.exp(etas.powers(cells))
                whole += float(w.sum())
                yield from held.add(*flat(cells, w), "s")

            return work

        return self._pass(use, "query_id bigint, s double").groupBy("query_id").agg(F.sum("s").alias("s"))

    def change(self, before: dict[int, float], moves: dict[int, float]) -> DataFrame:
        """(query_id, s): what the sums gain, and the whole under -1, if moves are
        added to these etas; only rows that a moved query counts are read."""
        etas, more, n = _Etas(before, self.space.n_queries), _Etas(moves, self.space.n_queries), self.space.n_queries
        where = F.lit(False)
        for q in moves:
            where = where | self.space.matches(q)

        def use():
            held, whole = Sums(n), 0.0

            def work(cells, w0, _):
                nonlocal whole
                if cells is None:
                    yield from held.batches("s")
                    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([whole])], names=["query_id", "s"])
                    return
                w = w0 * np.exp(etas.powers(cells)) * np.expm1(more.powers(cells))
                whole += float(w.sum())
                yield from held.add(*flat(cells, w), "s")

            return work

        return self._pass(use, "query_id bigint, s double", where=where)

    def classes(self, queries: np.ndarray, wids: list[int]) -> DataFrame:
        """(hits, w): the weight of the rows that the same of these sorted queries,
        of these workloads, count.  hits are the places of the counting queries,
        one 32-bit integer for each workload, -1 for none."""
        etas, own, kind = _Etas(self.etas, self.space.n_queries), np.array(wids), np.dtype((np.void, 4 * len(wids)))

        def use():
            def work(cells, w0, _):
                if cells is not None:
                    some = cells[own]
                    at = np.minimum(np.searchsorted(queries, some), len(queries) - 1)
                    hits = np.where(queries[at] == some, at, -1).T.astype("<i4", order="C").view(kind).ravel()
                    found, which = np.unique(hits, return_inverse=True)
                    w = np.bincount(which, w0 * np.exp(etas.powers(cells)), minlength=len(found))
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in found], pa.binary()), pa.array(w)], names=["hits", "w"])

            return work

        return self._pass(use, "hits binary, w double").groupBy("hits").agg(F.sum("w").alias("w"))

    def answers(self, average: bool = False) -> DataFrame:
        """(query_id, ans) of every query, of the weights or their average."""
        hist = Histogram(self.weights(average), self.space) if average else self
        held = stored(hist.sums())
        whole = held.where("query_id = -1").first()["s"]
        return filled(held.where("query_id >= 0").select("query_id", (F.col("s") / F.lit(whole)).alias("ans")), self.space.n_queries)

    def current_of(self, past: DataFrame, queries: np.ndarray, wids: list[int]) -> DataFrame:
        """past (with query_id) with ans, the answers of these sorted queries, of
        these workloads only; one row for each query and task is shuffled."""
        etas, space = _Etas(self.etas, self.space.n_queries), self.space
        own = np.array(wids)

        def use():
            total, whole = np.zeros(len(queries)), 0.0

            def work(cells, w0, _):
                nonlocal total, whole
                if cells is None:
                    yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(total), pa.array(np.full(len(queries), whole))], names=["q", "s", "t"])
                    return
                w = w0 * np.exp(etas.powers(cells))
                some = cells[own]
                at = np.minimum(np.searchsorted(queries, some), len(queries) - 1)
                hit = queries[at] == some
                whole += float(w.sum())
                total += np.bincount(at[hit], np.broadcast_to(w, some.shape)[hit], minlength=len(queries))

            return work

        found = self._pass(use, "q bigint, s double, t double").groupBy("q").agg((F.sum("s") / F.sum("t")).alias("ans"))
        return past.join(found, F.col("query_id") == F.col("q")).drop("q")

    def current(self, queries: list[int]) -> list[float]:
        """Answers to a few queries."""
        own = np.unique(queries)
        rows = self.spark.createDataFrame([(int(q),) for q in own], "query_id bigint")
        found = {r["query_id"]: r["ans"] for r in self.current_of(rows, own, sorted({self.space.workload_of(int(q)).wid for q in own})).collect()}  # as many as asked for
        return [found[q] for q in queries]

    def _weighed(self, sets: list[dict[int, float]]) -> DataFrame:
        """The support with w the mean of the normalised weights by each set of etas."""
        tables = [_Etas(e, self.space.n_queries) for e in sets]

        def totals():
            whole = np.zeros(len(tables))

            def work(cells, w0, _):
                nonlocal whole
                if cells is None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tables))), pa.array(whole)], names=["k", "t"])
                else:
                    whole += [float((w0 * np.exp(e.powers(cells))).sum()) for e in tables]
                    yield from ()

            return work

        whole = {r["k"]: r["t"] for r in self._pass(totals, "k bigint, t double").groupBy("k").agg(F.sum("t").alias("t")).collect()}  # one row for each round
        names = [c for c in self.support.columns if c != CELLS]

        def weigh():
            def work(cells, w0, batch):
                if cells is not None:
                    w = sum(w0 * np.exp(e.powers(cells)) / whole[k] for k, e in enumerate(tables)) / len(tables)
                    yield pa.RecordBatch.from_arrays([pa.array(w) if c == "w" else batch.column(c) for c in names], names=names)

            return work

        return self._pass(weigh, self.support.select(*[F.col(f"`{c}`") for c in names]).schema, keep=True)

    def weights(self, average: bool = False) -> DataFrame:
        """The support with normalised w; average: the mean over the rounds."""
        return self._weighed(self.snapshots if average and self.snapshots else [self.etas])

    def save(self, path: str) -> None:
        self.weights().write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, space: QuerySpace) -> Histogram:
        return cls(spark.read.parquet(path), space)


@dataclass
class Chooser:
    """Selects the next query and measures it.  Without a budget the worst query
    is taken with its exact answer; with one, the exponential and the Gaussian
    mechanism spend alpha and 1 - alpha of eps0."""

    n: int | None = None
    eps0: float | None = None
    alpha: float = 0.5
    seed: int = 0
    single: bool = True
    rows: list[tuple[int, int, float]] = field(default_factory=list)
    tables: list[DataFrame] = field(default_factory=list)
    wids: list[int] = field(default_factory=list)
    seen: dict[int, float] = field(default_factory=dict)

    def past(self, spark: SparkSession) -> DataFrame:
        """(i, query_id, measured); i tells the order of measuring."""
        out = _local(spark, self.rows, PAST)
        for t in self.tables:
            out = out.unionByName(t)
        return out

    def step(self, scored: DataFrame, round_: int, repeat: bool, space: QuerySpace, log: list) -> tuple[int, float, float] | None:
        """(query, measured, answer) of the query measured in this round, or of the
        first one of its workload; None if none is open.  scored has query_id, true
        and found.  Errors go to log, the answers of single past queries to seen."""
        scored = scored.withColumn("score", F.abs(F.col("true") - F.col("found")))
        past, q = sorted({x for _, x, _ in self.rows}), F.col("query_id")
        open_ = F.lit(True)
        if not repeat:
            open_ = ~q.isin(past) if past else open_
            for w in (space.workloads[k] for k in self.wids if not self.single):
                open_ = open_ & ~q.between(w.offset, w.offset + w.n_cells - 1)
        s = F.col("score")
        errors = [F.max(s).alias("error_max"), F.avg(s).alias("error_mean"), F.avg(s * s).alias("error_mean_squared")]
        noisy = F.lit(0.0) if self.eps0 is None else privacy.gumbel_score(s, self.alpha * self.eps0, 1 / (self.n or 1), f"{self.seed}:s:{round_}", F.col("query_id"))
        key = F.round(s if self.eps0 is None else noisy, 9)
        best = F.max(F.when(open_, F.struct(key.alias("x"), (-F.col("query_id")).alias("k"), "query_id", "true", "found")))
        seen = F.collect_list(F.when(q.isin(past), F.struct("query_id", "found"))) if past else F.array()
        row = scored.agg(*errors, best.alias("b"), seen.alias("seen")).first()
        self.seen = {r["query_id"]: r["found"] for r in row["seen"]}  # one for each round before, at most
        log.append({"round": round_} | {e: row[e] for e in ("error_max", "error_mean", "error_mean_squared")})
        if row["b"] is None:
            return None
        if self.eps0 is None:
            return row["b"]["query_id"], row["b"]["true"], row["b"]["found"]
        if self.single:
            q = row["b"]["query_id"]
            of = _local(scored.sparkSession, [(q, row["b"]["true"])], "query_id bigint, ans double")
            m = self._noisy(of, 1 / self.n, round_).first()["ans"]
            self.rows.append((round_, q, m))
            self.seen[q] = row["b"]["found"]
            self.wids.append(space.workload_of(q).wid)
            return q, m, row["b"]["found"]
        by = privacy.workload_scores(scored.where(open_).withColumn("wid", workload_column(space)))
        wid = privacy.exponential(by, self.alpha * self.eps0, 1 / self.n, f"{self.seed}:s:{round_}", key="wid").first()["wid"]
        w = space.workloads[wid]
        cells = scored.where(q.between(w.offset, w.offset + w.n_cells - 1)).select("query_id", F.col("true").alias("ans"))
        i = (F.lit(round_ << 44) + F.col("query_id")).alias("i")
        self.tables.append(stored(self._noisy(cells, privacy.workload_sensitivity(self.n), round_).select(i, "query_id", F.col("ans").alias("measured"))))
        self.wids.append(wid)
        return w.offset, math.nan, math.nan

    def queries(self, space: QuerySpace) -> np.ndarray:
        """The measured queries, sorted."""
        if self.single:
            return np.unique([q for _, q, _ in self.rows])
        return np.concatenate([np.arange(w.offset, w.offset + w.n_cells) for w in (space.workloads[k] for k in sorted(set(self.wids)))])

    def _noisy(self, values: DataFrame, sensitivity: float, round_: int) -> DataFrame:
        return privacy.clipped(privacy.gaussian(values, (1 - self.alpha) * self.eps0, sensitivity, f"{self.seed}:m:{round_}"))


def _off() -> Column:
    return F.round(F.abs(F.col("measured") - F.col("ans")), 9)


def _worst(rows: DataFrame):
    """The measured query that is most wrong, as a row; of equally wrong ones the
    first measured."""
    return rows.agg(F.max(F.struct(_off().alias("off"), (-F.col("i")).alias("k"), "query_id", "measured", "ans")).alias("b")).first()["b"]


class Standing:
    """The answers of a histogram beside the true ones.  base holds the sums of
    some rounds ago; table is base with what the moves since then add, so plans
    are as long in every round."""

    def __init__(self, hist: Histogram, true: DataFrame) -> None:
        self.hist, self.true = hist, true.select("query_id", F.col("ans").alias("true"))
        self.base = self.table = None
        self._sum_anew()

    def _with(self, left: DataFrame, more: DataFrame) -> DataFrame:
        rows = left.unionByName(more.select("query_id", F.lit(0.0).alias("true"), "s"))
        return rows.groupBy("query_id").agg(F.sum("true").alias("true"), F.sum("s").alias("s")).persist()

    def _sum_anew(self) -> None:
        self.close()
        self.base = self._with(self.true.select("query_id", "true", F.lit(0.0).alias("s")), self.hist.sums())
        self.table, self.since, self.etas, self.age = self.base, {}, dict(self.hist.etas), 0
        self.whole = self._whole()

    def _whole(self) -> float:
        return self.table.agg(F.sum(F.when(F.col("query_id") == -1, F.col("s")))).first()[0]

    def scored(self) -> DataFrame:
        return self.table.where("query_id >= 0").select("query_id", "true", (F.col("s") / F.lit(self.whole)).alias("found"))

    def move(self, moves: dict[int, float], whole: float | None = None) -> None:
        """Adds etas to the histogram and brings the answers up to date.  whole:
        the sum of weights after that, where it is known."""
        for q, eta in moves.items():
            self.hist.update(q, eta)
            self.since[q] = self.since.get(q, 0.0) + eta
        self.age += 1
        if self.age >= REFRESH or len(self.since) > TOLD:
            return self._sum_anew()
        if self.table is not self.base:
            self.table.unpersist()
        self.table = self._with(self.base, self.hist.change(self.etas, self.since))
        self.whole = self._whole() if whole is None else whole

    def close(self) -> None:
        for held in {id(x): x for x in (self.base, self.table) if x is not None}.values():
            held.unpersist()


def _sum(moves: list[tuple[int, float]]) -> dict[int, float]:
    out: dict[int, float] = {}
    for q, eta in moves:
        out[q] = out.get(q, 0.0) + eta
    return out


def multiplicative_weights(hist: Histogram, true: DataFrame, rounds: int, chooser: Chooser, recycle: bool = False) -> Histogram:
    """Each round measures one query and moves by half the error of the worst
    query measured so far; recycle also moves by all past queries of at least
    half the worst error, by the answers from before the round."""
    now = Standing(hist, true)
    for t in range(rounds):
        chosen = chooser.step(now.scored(), t, chooser.eps0 is None, hist.space, hist.log)
        if chosen is None:
            break
        if chooser.eps0 is None:
            q, m, a = chosen
            past = [(m, q, a, 0.0, t)]
        elif chooser.single:
            past = [(m, q, chooser.seen[q], round(abs(m - chooser.seen[q]), 9), i) for i, q, m in chooser.rows]
        else:
            past = _measured(chooser, now, recycle)
        worst = max(past, key=lambda r: (r[3], -r[4]))
        moves = [worst] + ([r for r in past if 0.5 * worst[3] <= r[3]] if recycle and chooser.eps0 is not None else [])
        etas = _sum([(q, (m - a) / 2) for m, q, a, _, _ in moves])
        whole = now.whole * (1 + math.expm1(etas[worst[1]]) * worst[2]) if len(etas) == 1 else None
        if t + 1 < rounds:
            now.move(etas, whole)
        else:
            for q, eta in etas.items():
                hist.update(q, eta)
        hist.snapshot()
    now.close()
    return hist


def _measured(chooser: Chooser, now: Standing, recycle: bool) -> list[tuple]:
    """(measured, query, answer, off, i) of the worst measured query, and for
    recycling of all of at least half its error, where workloads were measured."""
    rows = chooser.past(now.table.sparkSession).join(now.scored().withColumnRenamed("found", "ans"), "query_id")
    worst = _worst(rows)
    some = rows.where(F.lit(0.5 * worst["off"]) <= _off()).select("measured", "query_id", "ans", _off().alias("off"), "i").collect() if recycle else []  # of the rounds so far
    return [tuple(r) for r in some] or [(worst["measured"], worst["query_id"], worst["ans"], worst["off"], -worst["k"])]


def _projected(hist: Histogram, past: DataFrame, queries: np.ndarray, wids: list[int], iterations: int, most: int) -> tuple[dict[int, float], float | None]:
    """The etas of a number of projections, each of the measured query that is most
    wrong then, and the whole after them."""
    held = hist.classes(queries, wids).limit(most + 1).toArrow() if len(queries) <= most else None
    if held is None or held.num_rows > most:
        kept, out = dict(hist.etas), []
        for _ in range(iterations):
            worst = _worst(hist.current_of(past, queries, wids))
            out.append((worst["query_id"], projection_step(worst["measured"], worst["ans"])))
            hist.update(*out[-1])
        hist.etas = kept
        return _sum(out), None
    asked = past.toArrow()  # at most one row for each query and round
    place = np.searchsorted(queries, asked["query_id"].to_numpy())
    measured, order = asked["measured"].to_numpy(), asked["i"].to_numpy()
    hits = np.frombuffer(b"".join(held["hits"].to_pylist()), "<i4").reshape(-1, len(wids))
    row, own = np.nonzero(hits >= 0)[0], hits[hits >= 0]
    w, out = held["w"].to_numpy().copy(), []
    for _ in range(iterations):
        found = (np.bincount(own, w[row], minlength=len(queries)) / w.sum())[place]
        off = np.round(np.abs(measured - found), 9)
        worst = min(np.flatnonzero(off == off.max()), key=lambda k: order[k])
        eta = projection_step(float(measured[worst]), float(found[worst]))
        w[row[own == place[worst]]] *= math.exp(eta)
        out.append((int(queries[place[worst]]), eta))
    return _sum(out), float(w.sum())


def entropy_projection(hist: Histogram, true: DataFrame, rounds: int, chooser: Chooser, iterations: int = 1, most: int = CLASSES) -> Histogram:
    """Each round measures; then the worst measured query is projected onto its
    measurement, a fixed number of times."""
    now = Standing(hist, true)
    for t in range(rounds):
        chosen = chooser.step(now.scored(), t, chooser.eps0 is None, hist.space, hist.log)
        if chosen is None:
            break
        if chooser.eps0 is None:
            q, m, a = chosen
            etas = {q: projection_step(m, a)}
            whole = now.whole * (1 + math.expm1(etas[q]) * a)
        else:
            etas, whole = _projected(hist, chooser.past(hist.spark), chooser.queries(hist.space), sorted(set(chooser.wids)), iterations, most)
        if t + 1 < rounds:
            now.move(etas, whole)
        else:
            for q, eta in etas.items():
                hist.update(q, eta)
        hist.snapshot()
    now.close()
    return hist
