"""Fitted histograms and product models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fit, models
from ..operators import marginals as m
from ..operators import setquery as sq
from ..operators import support as sup
from ..plans.workload import QuerySpace
from .marginal import DISTR, EVEN, FULL, ODD, SMALL, SW, dense_sql, gumbel_sql, normal_sql, uniform_sql, wid_sql
from .register import domain, encoded, fixed, query, relation_sql

ROUNDS, EPS0, ALPHA, SEED = 3, 0.05, 0.5, 7
CELLS = [" + ".join([str(w.offset), *[f"{a} * {x}" for a, x in zip(w.attrs, w.strides)]]) for w in SW.workloads]
HIT = "({})".format(" OR ".join(f"q{i} = u.query_id" for i in range(len(CELLS))))


def _sql(rule: str, private: bool, start: str, source: str, where: str = "TRUE", rounds: int = ROUNDS, recycle: bool = False, average: bool = False, single: bool = True, iterations: int = 1) -> str:
    """Rounds written out.  start: a query for (status, priority, orderyear, w)."""
    step = "(u.m - u.sy) / 2"
    if rule == "project":
        a, b = "least(1 - 1e-6, greatest(1e-6, u.m))", "least(1 - 1e-6, greatest(1e-6, u.sy))"
        step = f"ln({a} * (1 - {b}) / ((1 - {a}) * {b}))"
    keep = f"status, priority, orderyear, {', '.join(f'q{i}' for i in range(len(CELLS)))}"
    n = "(SELECT count(*) FROM e)"
    out = [f"e AS ({relation_sql(source, where)})", f"t AS MATERIALIZED ({dense_sql(SW, 'e', by=n)})", f"w0 AS MATERIALIZED (SELECT *, {', '.join(f'{c} AS q{i}' for i, c in enumerate(CELLS))} FROM ({start}))"]
    w = 0

    def answered(name: str, of: str) -> str:
        cells = " UNION ALL ".join(f"SELECT q{i} AS q, w FROM {of}" for i in range(len(CELLS)))
        return f"{name} AS MATERIALIZED (SELECT t.query_id, t.ans AS tr, coalesce(s, 0) AS sy FROM t LEFT JOIN (SELECT q, sum(w) AS s FROM ({cells}) GROUP BY q) ON q = t.query_id)"

    ends = []
    for r in range(rounds):
        out.append(answered(f"a{r}", f"w{w}"))
        if private:
            past = f" WHERE query_id NOT IN (SELECT query_id FROM p{r - 1})" if r else ""
            spread = (1 if single else 2**0.5) / ((1 - ALPHA) * EPS0)
            noisy = f"least(1.0, greatest(0.0, tr + {normal_sql(f'{SEED}:m:{r}', 'query_id')} * {spread} / {n}))"
            choice = lambda key: f"round(score * {ALPHA * EPS0} * {n} + {gumbel_sql(f'{SEED}:s:{r}', key)}, 9) DESC, {key}"
            if single:
                pick = f"SELECT {r} AS i, query_id, {noisy} AS m FROM (SELECT *, abs(tr - sy) AS score FROM a{r}{past} ORDER BY {choice('query_id')} LIMIT 1)"
            else:
                of = wid_sql(SW, "query_id")
                wid = f"(SELECT wid FROM (SELECT {of} AS wid, max(abs(tr - sy)) AS score FROM a{r}{past} GROUP BY 1) ORDER BY {choice('wid')} LIMIT 1)"
                pick = f"SELECT {r} * 1000000 + query_id AS i, query_id, {noisy} AS m FROM a{r} WHERE {of} = {wid}"
            out.append(f"p{r} AS MATERIALIZED ({f'SELECT * FROM p{r - 1} UNION ALL ' if r else ''}({pick}))")
        for k in range(iterations):
            now = f"a{r}"
            if k:
                now = f"a{r}_{k}"
                out.append(answered(now, f"w{w}"))
            if not private:
                move = f"SELECT query_id, tr AS m, sy FROM {now} ORDER BY round(abs(tr - sy), 9) DESC, query_id LIMIT 1"
            else:
                off = f"SELECT p.query_id, p.m, a.sy, p.i, round(abs(p.m - a.sy), 9) AS d FROM p{r} p JOIN {now} a USING (query_id)"
                move = f"SELECT query_id, m, sy FROM (SELECT * FROM ({off}) ORDER BY d DESC, i LIMIT 1)"
                if recycle:
                    move += f" UNION ALL SELECT query_id, m, sy FROM ({off}) WHERE d >= 0.5 * (SELECT max(d) FROM ({off}))"
            out.append(f"u{r}_{k} AS MATERIALIZED (SELECT u.query_id, {step} AS eta FROM ({move}) u)")
            power = f"(SELECT coalesce(sum(eta), 0) FROM u{r}_{k} u WHERE {HIT})"
            out.append(f"w{w + 1} AS MATERIALIZED (SELECT {keep}, x / sum(x) OVER () AS w FROM (SELECT {keep}, w * exp({power}) AS x FROM w{w}))")
            w += 1
        ends.append(w)
    last = f"SELECT status, priority, orderyear, w FROM w{w}"
    if average:
        every = " UNION ALL ".join(f"SELECT status, priority, orderyear, w FROM w{k}" for k in ends)
        last = f"SELECT status, priority, orderyear, sum(w) / {rounds} AS w FROM ({every}) GROUP BY ALL"
    return f"WITH {', '.join(out)} SELECT status, priority, orderyear, round(w, 8) AS w FROM ({last})"


UNIFORM = f"SELECT status, priority, orderyear, 1.0::DOUBLE / 105 AS w FROM ({FULL})"
PUBLIC = f"SELECT status, priority, orderyear, count(*) / (SELECT count(*) FROM orders WHERE {EVEN})::DOUBLE AS w FROM ({relation_sql('ord', EVEN)}) GROUP BY ALL"


def _uniform(spark: SparkSession) -> fit.Histogram:
    whole = domain("ord", *SMALL)
    return fit.Histogram(sup.uniform(sup.full_support(spark, whole), whole.size()), SW)


def _public(spark: SparkSession, d: str) -> fit.Histogram:
    return fit.Histogram(sup.public_support(encoded(spark, d, "ord", SMALL, EVEN)), SW)


def _weights(hist: fit.Histogram, average: bool = False) -> DataFrame:
    return hist.weights(average).select(*SMALL, F.round("w", 8).alias("w"))


def _true(spark: SparkSession, d: str, where: str = "TRUE") -> tuple[DataFrame, int]:
    data = encoded(spark, d, "ord", SMALL, where)
    return fit.stored(m.answers(data, SW)), data.records


def _private(n: int, single: bool = True) -> fit.Chooser:
    return fit.Chooser(n=n, eps0=EPS0, alpha=ALPHA, seed=SEED, single=single)


@query(_sql("weights", False, UNIFORM, "ord"))
def mw_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _weights(fit.multiplicative_weights(_uniform(spark), _true(spark, d)[0], ROUNDS, fit.Chooser()))


@query(_sql("project", False, UNIFORM, "ord"))
def ep_rounds(spark: SparkSession, d: str) -> DataFrame:
    return _weights(fit.entropy_projection(_uniform(spark), _true(spark, d)[0], ROUNDS, fit.Chooser()))


@query(_sql("weights", True, UNIFORM, "ord"))
def mwem_rounds(spark: SparkSession, d: str) -> DataFrame:
    true, n = _true(spark, d)
    return _weights(fit.multiplicative_weights(_uniform(spark), true, ROUNDS, _private(n)))


@query(_sql("weights", True, UNIFORM, "ord", rounds=5, recycle=True))
def mwem_recycled(spark: SparkSession, d: str) -> DataFrame:
    """Past queries of half the worst error or more move too."""
    true, n = _true(spark, d)
    return _weights(fit.multiplicative_weights(_uniform(spark), true, 5, _private(n), recycle=True))


@query(_sql("weights", True, UNIFORM, "ord", average=True))
def mwem_averaged(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the rounds' weights."""
    true, n = _true(spark, d)
    return _weights(fit.multiplicative_weights(_uniform(spark), true, ROUNDS, _private(n)), average=True)


@query(_sql("project", True, UNIFORM, "ord"))
def pep_rounds(spark: SparkSession, d: str) -> DataFrame:
    true, n = _true(spark, d)
    return _weights(fit.entropy_projection(_uniform(spark), true, ROUNDS, _private(n)))


@query(_sql("weights", True, PUBLIC, "ord", ODD))
def pmw_pub_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Starts from public frequencies; answers and their count are private."""
    true, n = _true(spark, d, ODD)
    return _weights(fit.multiplicative_weights(_public(spark, d), true, ROUNDS, _private(n)))


@query(_sql("project", True, PUBLIC, "ord", ODD, iterations=2))
def pep_pub_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Entropy projection from public frequencies."""
    true, n = _true(spark, d, ODD)
    return _weights(fit.entropy_projection(_public(spark, d), true, ROUNDS, _private(n), iterations=2))


@query(_sql("project", True, UNIFORM, "ord", rounds=2, single=False, iterations=5))
def pep_workload(spark: SparkSession, d: str) -> DataFrame:
    """Whole workloads measured, several projections a round."""
    true, n = _true(spark, d)
    return _weights(fit.entropy_projection(_uniform(spark), true, 2, _private(n, single=False), iterations=5))


@query(
    f"WITH {DISTR}, c AS (SELECT support_id, round(sum(w) OVER (ORDER BY support_id), 12) AS hi FROM w), u AS (SELECT range AS draw, round({uniform_sql(str(SEED), 'range')}, 12) AS u FROM range(10000)) "
    "SELECT draw, status, priority, orderyear FROM (SELECT draw, min(support_id) AS support_id FROM u JOIN c ON hi > u GROUP BY draw) JOIN f USING (support_id)"
)
def hist_sample(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn from a histogram."""
    data = encoded(spark, d, "ord", SMALL)
    weighted = sup.support_distribution(sup.full_support(spark, data.domain), data)
    drawn = sup.sample_support(fit.stored(weighted.select("support_id", "w")), 10_000, SEED)
    return drawn.join(sup.full_support(spark, data.domain), "support_id").select("draw", *SMALL)


def _vector(spark: SparkSession, d: str, where: str = "TRUE") -> tuple[np.ndarray, int]:
    """True answers of the small space as a vector."""
    true, n = _true(spark, d, where)
    table, out = true.toArrow(), np.zeros(SW.n_queries)
    out[table["query_id"].to_numpy()] = table["ans"].to_numpy()
    return out, n


def _fitted(spark: SparkSession, d: str, style: str, network: bool) -> DataFrame:
    true, n = _vector(spark, d)
    whole = domain("ord", *SMALL)
    model = models.ResidualModel(whole, 100, 16, seed=1) if network else models.FixedModel(whole, 100, seed=1)
    log = models.fit_private(model, SW, true, n, EPS0, models.FitConfig(style=style, rounds=3, max_iters=60, lr=0.02 if network else 0.1))
    return spark.createDataFrame([(r["round"], r["error_max"], r["error_mean"]) for r in log], "round int, error_max double, error_mean double")


@fixed()
def gem_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, "gem", True)


@fixed()
def rap_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, "rap", False)


@fixed()
def iter_fit(spark: SparkSession, d: str) -> DataFrame:
    return _fitted(spark, d, "iter", False)


@fixed()
def nondp_fit(spark: SparkSession, d: str) -> DataFrame:
    true, _ = _vector(spark, d)
    model = models.FixedModel(domain("ord", *SMALL), 100, seed=1)
    log = models.fit_exact(model, SW, true, 150, lr=0.1)
    return spark.createDataFrame([(i, x) for i, x in enumerate(log)], "step int, error_max double")


@fixed()
def gem_public(spark: SparkSession, d: str) -> DataFrame:
    """A network fitted without noise to public rows, then privately to others."""
    public, _ = _vector(spark, d, EVEN)
    true, n = _vector(spark, d, ODD)
    model = models.ResidualModel(domain("ord", *SMALL), 100, 16, seed=1)
    models.fit_exact(model, SW, public, 60, lr=0.02)
    log = models.fit_private(model, SW, true, n, EPS0, models.FitConfig(style="gem", rounds=3, max_iters=60, lr=0.02))
    return spark.createDataFrame([(r["round"], r["error_max"], r["error_mean"]) for r in log], "round int, error_max double, error_mean double")


@fixed()
def set_fit(spark: SparkSession, d: str) -> DataFrame:
    """A product model fitted to set queries."""
    asked = [{"status": [0, 1], "orderyear": [2, 3, 4]}, {"priority": [0]}, {"priority": [1, 2], "status": [2]}, {"orderyear": [1]}]
    data = encoded(spark, d, "ord", SMALL)
    space = sq.SetSpace(data.domain, asked)
    true = np.array([r["ans"] for r in sq.set_answers(data, asked).orderBy("qid").collect()])  # one row for each query
    model = models.FixedModel(data.domain, 100, seed=1)
    log = models.fit_exact(model, space, true, 150, lr=0.1)
    return spark.createDataFrame([(i, x) for i, x in enumerate(log)], "step int, error_max double")


YEARS, COLUMNS = domain("ord", *SMALL)["orderyear"], [("status", 3), ("priority", 5), ("orderyear", 7)]
SHARES = " UNION ALL ".join(f"SELECT orderyear AS k, {i} AS a, {c} AS v, count(*) / sum(count(*)) OVER (PARTITION BY orderyear) AS p FROM e GROUP BY orderyear, {c}" for i, (c, _) in enumerate(COLUMNS))
DRAWN = ", ".join(
    f"(SELECT least(count(*), {n - 1}) FROM cdf WHERE cdf.k = range % {YEARS} AND cdf.a = {i} AND cdf.c <= {uniform_sql(str(SEED), f"range || ':{i}'")})::INTEGER AS {c}" for i, (c, n) in enumerate(COLUMNS)
)


@query(
    f"WITH e AS ({relation_sql('ord')}), s AS ({SHARES}), g AS (SELECT k, a, v FROM range({YEARS}) x(k), (VALUES {', '.join(f'({i}, {v})' for i, (_, n) in enumerate(COLUMNS) for v in range(n))}) y(a, v)), "
    f"cdf AS (SELECT k, a, v, round(sum(coalesce(p, 0)) OVER (PARTITION BY k, a ORDER BY v), 12) AS c FROM g LEFT JOIN s USING (k, a, v)) SELECT range AS id, {DRAWN} FROM range(10000)"
)
def product_sample(spark: SparkSession, d: str) -> DataFrame:
    """Rows drawn from a product model: one distribution of independent columns
    for each year, as in the orders."""
    data = encoded(spark, d, "ord", SMALL)
    space = QuerySpace(data.domain, [("orderyear", c) for c, _ in COLUMNS[:2]], ordered=False)
    p, at = np.zeros((YEARS, sum(data.domain.shape))), data.domain.offsets()
    for r in m.answers(data, space, density=None).collect():  # years by values
        values = space.values(r["query_id"])
        for a in ("status", "priority"):
            if a in values:
                p[values["orderyear"], at[a] + values[a]] = r["ans"]
    for a, n in COLUMNS[:2]:
        block = p[:, at[a] : at[a] + n]
        block /= np.maximum(block.sum(axis=1, keepdims=True), 1)
    p[np.arange(YEARS), at["orderyear"] + np.arange(YEARS)] = p[:, at["status"] : at["status"] + 3].sum(axis=1)
    return models.sample_rows(spark, p, data.domain, 10_000, seed=SEED)
