"""Marginals, set queries, supports, errors and mechanisms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domain import Domain, EncodedData
from ..operators import evaluate, models, privacy
from ..operators import marginals as m
from ..operators import setquery as sq
from ..operators import setrelation as sr
from ..operators import support as sup
from ..plans.workload import QuerySpace, all_workloads
from .register import LI, ORD, domain, encoded, fixed, frame, query, relation_sql, table

LI_ATTRS = ["returnflag", "linestatus", "discount", "tax", "linenumber"]
SMALL = ["status", "priority", "orderyear"]


def space(name: str, attrs: list[str], k: int) -> QuerySpace:
    d = domain(name, *attrs)
    return QuerySpace(d, all_workloads(d, k))


def cells_sql(s: QuerySpace, source: str, weight: str = "1.0") -> str:
    """query_id, s: sums of weights by cell."""
    parts = []
    for w in s.workloads:
        at = " + ".join([str(w.offset), *[f"{a} * {x}" for a, x in zip(w.attrs, w.strides)]])
        ok = " AND ".join(f"{a} BETWEEN 0 AND {n - 1}" for a, n in zip(w.attrs, w.sizes))
        parts.append(f"SELECT ({at})::BIGINT AS query_id, sum({weight})::DOUBLE AS s FROM {source} WHERE {ok} GROUP BY 1")
    return " UNION ALL ".join(parts)


def wid_sql(s: QuerySpace, q: str = "range") -> str:
    return "(CASE " + " ".join(f"WHEN {q} < {w.offset + w.n_cells} THEN {w.wid}" for w in s.workloads) + " END)::INTEGER"


def dense_sql(s: QuerySpace, source: str, weight: str = "1.0", by: str = "1") -> str:
    """query_id, ans: every cell, divided by a scalar expression."""
    return f"SELECT range::BIGINT AS query_id, coalesce(s, 0.0) / {by} AS ans FROM range({s.n_queries}) LEFT JOIN ({cells_sql(s, source, weight)}) ON range = query_id"


def _marginals(k: int):
    s = space("li", LI_ATTRS, k)
    sql = f"WITH e AS ({relation_sql('li')}) {dense_sql(s, 'e', by='(SELECT count(*) FROM e)')}"
    return s, sql


S1, Q1 = _marginals(1)
S2, Q2 = _marginals(2)
S3, Q3 = _marginals(3)


@query(Q1)
def marginals_1way(spark: SparkSession, d: str) -> DataFrame:
    return m.answers(encoded(spark, d, "li", LI_ATTRS), S1)


@query(Q2)
def marginals_2way(spark: SparkSession, d: str) -> DataFrame:
    return m.answers(encoded(spark, d, "li", LI_ATTRS), S2)


@query(Q3)
def marginals_3way(spark: SparkSession, d: str) -> DataFrame:
    return m.answers(encoded(spark, d, "li", LI_ATTRS), S3)


@query(Q3)
def marginals_3way_arrow(spark: SparkSession, d: str) -> DataFrame:
    return m.answers(encoded(spark, d, "li", LI_ATTRS), S3, strategy="arrow")


@query(Q3)
def marginals_3way_passes(spark: SparkSession, d: str) -> DataFrame:
    """In several passes, each of workloads of at most 500 cells together."""
    data = encoded(spark, d, "li", LI_ATTRS)
    counts = m.filled(m.sums(data, S3, "arrow", dense=500), S3.n_queries)
    return counts.join(F.broadcast(data.df.agg(F.count(F.lit(1)).alias("n")))).select("query_id", (F.col("ans") / F.col("n")).alias("ans"))


LI_ALL = list(domain("li").attrs)
S3_ALL = space("li", LI_ALL, 3)


@query(f"WITH e AS ({relation_sql('li')}) {dense_sql(S3_ALL, 'e', by='(SELECT count(*) FROM e)')}")
def marginals_3way_all(spark: SparkSession, d: str) -> DataFrame:
    """All 35 three-way tables of seven attributes."""
    return m.answers(encoded(spark, d, "li", LI_ALL), S3_ALL, strategy="arrow")


SW = space("ord", SMALL, 2)


@query(f"WITH e AS ({relation_sql('ord')}) SELECT query_id, round(ans, 2) AS ans FROM ({dense_sql(SW, 'e', 'o_totalprice')})")
def marginals_weighted(spark: SparkSession, d: str) -> DataFrame:
    found = m.answers(encoded(spark, d, "ord", SMALL, weight="o_totalprice"), SW, density=None)
    return found.select("query_id", F.round("ans", 2).alias("ans"))


@query(f"WITH e AS ({relation_sql('ord')}), a AS ({dense_sql(SW, 'e')}) SELECT {wid_sql(SW, 'query_id')} AS wid, array_to_string(list(ans::BIGINT ORDER BY query_id), ',') AS answers FROM a GROUP BY 1")
def marginals_by_workload(spark: SparkSession, d: str) -> DataFrame:
    found = m.by_workload(m.answers(encoded(spark, d, "ord", SMALL), SW, density=None), SW)
    return found.select("wid", F.array_join(F.transform("answers", lambda x: x.cast("bigint").cast("string")), ",").alias("answers"))


SD = space("doc", ["lang", "quality", "toxic", "length"], 2)


@query(f"WITH e AS ({relation_sql('doc')}) {dense_sql(SD, 'e', by='(SELECT count(*) FROM e)')}")
def marginals_missing(spark: SparkSession, d: str) -> DataFrame:
    """Missing codes (-1) are in no cell; all rows are in the denominator."""
    return m.answers(encoded(spark, d, "doc", list(SD.domain.attrs)), SD, density="all")


EV = space("ev", ["event_type", "hour", "value"], 2)


@query(f"WITH e AS ({relation_sql('ev')}) {dense_sql(EV, 'e', by='(SELECT count(*) FROM e)')}")
def marginals_events(spark: SparkSession, d: str) -> DataFrame:
    return m.answers(encoded(spark, d, "ev", list(EV.domain.attrs)), EV, density="all")


SJ = QuerySpace(domain("ord", *SMALL), [SMALL], ordered=False)


@query(f"WITH e AS ({relation_sql('ord')}) SELECT query_id AS cell, ans AS value FROM ({dense_sql(SJ, 'e')})")
def joint_histogram_dense(spark: SparkSession, d: str) -> DataFrame:
    return encoded(spark, d, "ord", SMALL).datavector()


@query(f"WITH e AS ({relation_sql('ord')}) SELECT query_id AS cell, ans AS value FROM ({dense_sql(SJ, 'e', by='(SELECT count(*) FROM e)')})")
def joint_density(spark: SparkSession, d: str) -> DataFrame:
    return encoded(spark, d, "ord", SMALL).datavector(density=True)


# Numbers hashed alike on both sides


def uniform_sql(seed: str, key: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 13))::UBIGINT::DOUBLE + 0.5) / {1 << 52})"


# Metadata as relations -----------------------------------------------------


def values_sql(rows: list[tuple], columns: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) if isinstance(v, float) else "NULL" if v is None else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


@fixed(values_sql([(w.wid, ",".join(w.attrs), w.n_cells, w.offset) for w in S2.workloads], "wid, attrs, n_cells, start_id"))
def workload_dim(spark: SparkSession, d: str) -> DataFrame:
    return S2.table(spark).select("wid", F.array_join("attrs", ",").alias("attrs"), "n_cells", F.col("offset").alias("start_id"))


def _enumeration_sql(s: QuerySpace) -> str:
    parts = []
    for w in s.workloads:
        vals = " || ',' || ".join(f"((i // {x}) % {n})" for x, n in zip(w.strides, w.sizes))
        parts.append(f"SELECT ({w.offset} + i)::BIGINT AS query_id, {w.wid}::INTEGER AS wid, {vals} AS vals FROM (SELECT unnest(range({w.n_cells})) AS i)")
    return " UNION ALL ".join(parts)


@fixed(_enumeration_sql(S2))
def query_enumeration(spark: SparkSession, d: str) -> DataFrame:
    return S2.queries(spark).select("query_id", "wid", F.array_join(F.transform("vals", lambda v: v.cast("string")), ",").alias("vals"))


@fixed(f"SELECT {S3.n_queries}::BIGINT AS n_queries, {len(S3.workloads)}::BIGINT AS n_workloads")
def workload_counts(spark: SparkSession, d: str) -> DataFrame:
    t = S3.table(spark)
    return t.agg(F.sum("n_cells").alias("n_queries"), F.count(F.lit(1)).alias("n_workloads"))


ASKED = [0, 7, 50, S3.n_queries - 1]


@fixed(
    "SELECT q::BIGINT AS query_id, w || '' AS described FROM (VALUES "
    + ", ".join(f"({q}, '" + " | ".join(f"{a}={v}" for a, v in S3.values(q).items()) + "')" for q in ASKED)
    + ") AS t(q, w)"
)
def query_describe(spark: SparkSession, d: str) -> DataFrame:
    """Described from the numbers alone."""
    rows = S3.queries(spark).where(F.col("query_id").isin(ASKED)).join(S3.table(spark).select("wid", "attrs"), "wid")
    pairs = F.zip_with("attrs", "vals", lambda a, v: F.concat(a, F.lit("="), v.cast("string")))
    return rows.select("query_id", F.concat_ws(" | ", pairs).alias("described"))


@query(f"WITH e AS ({relation_sql('li')}) SELECT DISTINCT ({S2.lookup({'returnflag': 0, 'tax': 0})} + returnflag * 9 + tax)::BIGINT AS query_id FROM e")
def query_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The query of each (returnflag, tax) in the rows."""
    w = S2.workload_of(S2.lookup({"returnflag": 0, "tax": 0}))
    return encoded(spark, d, "li", LI_ATTRS).df.select(w.cell().alias("query_id")).distinct()


@fixed(values_sql([(q, ",".join(map(str, sorted(S2.positions(q))))) for q in range(S2.n_queries)], "query_id, positions"))
def query_onehot(spark: SparkSession, d: str) -> DataFrame:
    """Places of each query's ones in a one-hot row."""
    at = S2.domain.offsets()
    starts = S2.table(spark).select("wid", F.transform("attrs", lambda a: F.element_at(F.create_map(*[x for k, v in at.items() for x in (F.lit(k), F.lit(v))]), a)).alias("starts"))
    places = F.array_sort(F.zip_with("starts", "vals", lambda s, v: s + v))
    return S2.queries(spark).join(starts, "wid").select("query_id", F.array_join(F.transform(places, lambda p: p.cast("string")), ",").alias("positions"))


KEPT = [1, 3, 4]
SF = S2.filter_workloads(KEPT)


@query(f"WITH e AS ({relation_sql('li')}) {dense_sql(SF, 'e', by='(SELECT count(*) FROM e)')}")
def filter_workloads(spark: SparkSession, d: str) -> DataFrame:
    return m.answers(encoded(spark, d, "li", LI_ATTRS), SF)


@query(f"WITH e AS ({relation_sql('li')}) SELECT query_id, ans FROM ({dense_sql(S2, 'e', by='(SELECT count(*) FROM e)')}) WHERE query_id % 7 = 3")
def filter_queries(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(S2.n_queries).where("id % 7 = 3").select(F.col("id").alias("query_id"))
    return m.answers(encoded(spark, d, "li", LI_ATTRS), S2).join(asked, "query_id", "left_semi")


BRIDGE = m.random_bridge(S2)


@query(f"WITH e AS ({relation_sql('li')}), a AS ({dense_sql(S2, 'e')}), b AS ({values_sql(BRIDGE, 'agg_id, query_id')}) SELECT agg_id, sum(ans) / (SELECT count(*) FROM e) AS ans FROM b JOIN a USING (query_id) GROUP BY agg_id")
def aggregate_queries(spark: SparkSession, d: str) -> DataFrame:
    data = encoded(spark, d, "li", LI_ATTRS)
    sums = m.aggregate_answers(m.answers(data, S2, density=None), spark.createDataFrame(BRIDGE, "agg_id int, query_id bigint"))
    return sums.join(F.broadcast(data.df.agg(F.count(F.lit(1)).alias("n")))).select("agg_id", (F.col("ans") / F.col("n")).alias("ans"))


WIDE = {**LI, **ORD}
WIDE_SPACE = (lambda w: QuerySpace(w, all_workloads(w, 3)))(Domain.fromdict({a: n for a, (_, n) in WIDE.items()}))
WIDE_SQL = f"SELECT {', '.join(f'{e} AS {a}' for a, (e, _) in WIDE.items())} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@query(f"WITH e AS MATERIALIZED ({WIDE_SQL}) {cells_sql(WIDE_SPACE, 'e').replace('AS s FROM', 'AS ans FROM')}")
def marginals_wide(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all 286 three-way marginals of the 13 attributes of lines, their
    orders and customers; cells that no line falls in are left out."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return m.sums(EncodedData(lines.selectExpr(*[f"{e} AS {a}" for a, (e, _) in WIDE.items()]), WIDE_SPACE.domain), WIDE_SPACE)


SETS = [{"status": [0, 1], "orderyear": [2, 3, 4]}, {"priority": [0]}, {"priority": [1, 2], "status": [2], "orderyear": [0, 6]}, {}, {"orderyear": [1]}]


def _where(q: dict) -> str:
    return " AND ".join(f"{a} IN ({', '.join(map(str, v))})" for a, v in q.items() if len(v)) or "TRUE"


def _sets_sql(queries: list[dict]) -> str:
    parts = [f"SELECT {i}::INTEGER AS qid, count(*) FILTER ({_where(q)}) / count(*)::DOUBLE AS ans FROM e" for i, q in enumerate(queries)]
    return f"WITH e AS ({relation_sql('ord')}) " + " UNION ALL ".join(parts)


@query(_sets_sql(SETS))
def set_queries(spark: SparkSession, d: str) -> DataFrame:
    return sq.set_answers(encoded(spark, d, "ord", SMALL), SETS)


@query(_sets_sql(SETS))
def set_queries_joined(spark: SparkSession, d: str) -> DataFrame:
    return sq.set_answers(encoded(spark, d, "ord", SMALL), SETS, strategy="tables")


@query(
    "WITH e AS (" + relation_sql("ord") + ") "
    + " UNION ALL ".join(f"SELECT status, {i}::INTEGER AS qid, (count(*) FILTER ({_where({a: v for a, v in q.items() if a != 'status'})}))::DOUBLE AS ans FROM e GROUP BY status" for i, q in enumerate({k: v for k, v in q.items() if k != "status"} for q in SETS))
)
def set_queries_by_group(spark: SparkSession, d: str) -> DataFrame:
    """The queries' other attributes within each status."""
    asked = [{k: v for k, v in q.items() if k != "status"} for q in SETS]
    return sq.set_answers(encoded(spark, d, "ord", SMALL), asked, density=False, by=["status"])


REPEATED = [SETS[0], {"orderyear": [4, 3, 2, 2], "status": [1, 0]}, SETS[1], {"priority": [0], "status": []}]


@query(_sets_sql(sq.distinct(REPEATED)))
def set_queries_dedup(spark: SparkSession, d: str) -> DataFrame:
    return sq.set_answers(encoded(spark, d, "ord", SMALL), sq.distinct(REPEATED))


SUPPLIERS_ASK = "SELECT DISTINCT s_nationkey AS nation, s_suppkey AS qid, s_suppkey % 5 AS p0, s_suppkey // 5 % 5 AS p1, s_suppkey % 7 AS y0, (s_suppkey + 3) % 7 AS y1, s_suppkey % 3 = 0 AS any_year FROM supplier"


@query(
    f"WITH e AS ({relation_sql('ord')}), q AS ({SUPPLIERS_ASK}), k AS (SELECT nation, min(qid) AS qid, least(p0, p1) AS a, greatest(p0, p1) AS b, CASE WHEN NOT any_year THEN least(y0, y1) END AS c, CASE WHEN NOT any_year THEN greatest(y0, y1) END AS d FROM q GROUP BY ALL), "
    "n AS (SELECT nation, count(*) AS n FROM e GROUP BY nation) "
    "SELECT k.nation::INTEGER AS nation, k.qid::BIGINT AS qid, count(e.nation) / coalesce(any_value(n.n), 1)::DOUBLE AS ans FROM k LEFT JOIN n ON n.nation = k.nation LEFT JOIN e ON e.nation = k.nation AND e.priority IN (a, b) AND (c IS NULL OR e.orderyear IN (c, d)) GROUP BY k.nation, k.qid"
)
def set_queries_of_table(spark: SparkSession, d: str) -> DataFrame:
    """Queries that a table asks: each supplier names two priorities and, two times
    in three, two years; equal ones of a nation are answered once, over its orders."""
    key = F.col("s_suppkey")
    asked = table(spark, d, "supplier").select(F.col("s_nationkey").cast("int").alias("nation"), key.cast("bigint").alias("qid")).distinct()
    k = F.col("qid")
    named = [("priority", k % 5), ("priority", F.floor(k / 5) % 5), ("orderyear", F.when(k % 3 != 0, k % 7)), ("orderyear", F.when(k % 3 != 0, (k + 3) % 7))]
    codes = asked.select("nation", "qid", F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), c.cast("int").alias("code")) for a, c in named])).alias("c"))
    values = codes.select("nation", "qid", "c.*").where("code IS NOT NULL")
    queries = sr.SetQueries.of_relation(values, domain("ord", "priority", "orderyear"), asked, ["nation"]).distinct()
    return sr.relation_answers(frame(spark, d, "ord"), queries, density=True).select("nation", "qid", F.coalesce("ans", F.lit(0.0)).alias("ans"))


# Supports ------------------------------------------------------------------

FULL = "SELECT i::BIGINT AS support_id, (i // 35)::INTEGER AS status, ((i // 7) % 5)::INTEGER AS priority, (i % 7)::INTEGER AS orderyear FROM (SELECT unnest(range(105)) AS i)"


@fixed(FULL)
def full_support(spark: SparkSession, d: str) -> DataFrame:
    return sup.full_support(spark, domain("ord", *SMALL))


@query(f"WITH e AS ({relation_sql('ord')}) SELECT status, priority, orderyear, count(*) / (SELECT count(*) FROM e)::DOUBLE AS w FROM e GROUP BY ALL")
def public_support(spark: SparkSession, d: str) -> DataFrame:
    return sup.public_support(encoded(spark, d, "ord", SMALL))


DISTR = f"f AS ({FULL}), e AS ({relation_sql('ord')}), w AS (SELECT f.*, coalesce(c, 0) / (SELECT count(*) FROM e)::DOUBLE AS w FROM f LEFT JOIN (SELECT status, priority, orderyear, count(*) AS c FROM e GROUP BY ALL) USING (status, priority, orderyear))"


@query(f"WITH {DISTR} SELECT * FROM w")
def support_distribution(spark: SparkSession, d: str) -> DataFrame:
    found = sup.support_distribution(full_support(spark, d), encoded(spark, d, "ord", SMALL))
    return found.select("support_id", *SMALL, "w")


@query(f"WITH {DISTR} SELECT query_id, round(ans, 9) AS ans FROM ({dense_sql(SW, 'w', 'w')})")
def support_answers(spark: SparkSession, d: str) -> DataFrame:
    weighted = sup.support_distribution(full_support(spark, d), encoded(spark, d, "ord", SMALL))
    return sup.support_answers(weighted, SW).select("query_id", F.round("ans", 9).alias("ans"))


MATCHED = SW.lookup({"orderyear": 2, "priority": 3})


@fixed(f"SELECT support_id, (CASE WHEN orderyear = 2 AND priority = 3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS matches FROM ({FULL})")
def support_match(spark: SparkSession, d: str) -> DataFrame:
    return full_support(spark, d).select("support_id", SW.matches(MATCHED).cast("double").alias("matches"))


@fixed(
    " UNION ALL ".join(
        f"SELECT ({w.offset} + i)::BIGINT AS query_id, "
        + " || ',' || ".join(f"((i // {w.strides[w.attrs.index(a)]}) % {w.sizes[w.attrs.index(a)]})" if a in w.attrs else "'-1'" for a in SMALL)
        + f" AS required FROM (SELECT unnest(range({w.n_cells})) AS i)"
        for w in SW.workloads
    )
)
def support_query_matrix(spark: SparkSession, d: str) -> DataFrame:
    return sup.query_matrix(SW, spark).select("query_id", F.array_join(F.transform("required", lambda v: v.cast("string")), ",").alias("required"))


# Soft rows -----------------------------------------------------------------

SOFT = Domain.fromdict({"a": 2, "b": 3})
SSOFT = QuerySpace(SOFT, [("a", "b"), ("b",)])
PROBS = [(k, a, v, (1 + (k * 7 + i * 3 + v) % 5) / sum(1 + (k * 7 + i * 3 + u) % 5 for u in range(n))) for k in range(4) for i, (a, n) in enumerate(SOFT.config.items()) for v in range(n)]
PSQL = values_sql(PROBS, "k, attr, value, p")


@fixed(
    f"WITH p AS ({PSQL}) SELECT ({SSOFT.lookup({'a': 0, 'b': 0})} + x.value * 3 + y.value)::BIGINT AS query_id, round(sum(x.p * y.p) / 4, 9) AS ans FROM p x JOIN p y USING (k) WHERE x.attr = 'a' AND y.attr = 'b' GROUP BY 1"
    f" UNION ALL SELECT ({SSOFT.lookup({'b': 0})} + value)::BIGINT, round(sum(p) / 4, 9) FROM p WHERE attr = 'b' GROUP BY 1"
)
def soft_marginals(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(PROBS, "k int, attr string, value int, p double")
    return m.soft_answers_of_rows(rows, SSOFT).select("query_id", F.round("ans", 9).alias("ans"))


SOFT_SETS = [{"priority": [0, 2], "orderyear": [1, 2, 3]}, {"priority": [4]}, {}, {"orderyear": [0, 6], "priority": [1, 2, 3]}]
SOFT_ROWS = " UNION ALL ".join(f"SELECT status AS k, '{a}' AS attr, {a} AS value, count(*) / sum(count(*)) OVER (PARTITION BY status) AS p FROM e GROUP BY status, {a}" for a in ("priority", "orderyear"))


def soft_rows(spark: SparkSession, d: str) -> DataFrame:
    """(k, attr, value, p): for each status the shares of priorities and years."""
    from pyspark.sql import Window

    df, out = encoded(spark, d, "ord", SMALL).df, None
    for a in ("priority", "orderyear"):
        counts = df.groupBy(F.col("status").alias("k"), F.col(a).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        part = counts.select("k", F.lit(a).alias("attr"), "value", (F.col("n") / F.sum("n").over(Window.partitionBy("k"))).alias("p"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"WITH e AS ({relation_sql('ord')}), p AS ({SOFT_ROWS}) "
    + " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS qid, round(avg(x), 9) AS ans FROM (SELECT k, 1.0::DOUBLE"
        + "".join(f" * coalesce(sum(p) FILTER (attr = '{a}' AND value IN ({', '.join(map(str, vs))})), 0)" for a, vs in q.items())
        + " AS x FROM p GROUP BY k)"
        for i, q in enumerate(SOFT_SETS)
    )
)
def soft_set_queries(spark: SparkSession, d: str) -> DataFrame:
    """Set queries over probabilistic rows."""
    return sq.soft_set_answers_sql(soft_rows(spark, d), SOFT_SETS).select("qid", F.round("ans", 9).alias("ans"))


SROWS = QuerySpace(domain("ord", "orderyear", "priority"), [("orderyear", "priority")], ordered=False)


@query(
    f"WITH e AS ({relation_sql('ord')}), p AS ({SOFT_ROWS}) SELECT (x.value * 5 + y.value)::BIGINT AS query_id, round(sum(x.p * y.p) / (SELECT count(DISTINCT k) FROM p), 9) AS ans FROM p x JOIN p y USING (k) WHERE x.attr = 'orderyear' AND y.attr = 'priority' GROUP BY 1"
)
def soft_marginals_of_rows(spark: SparkSession, d: str) -> DataFrame:
    """Marginals of the orders' shares by status."""
    return m.soft_answers_of_rows(soft_rows(spark, d), SROWS).select("query_id", F.round("ans", 9).alias("ans"))


# Shares of the orders' six attributes within 40 groups of orders: probabilistic
# rows for 50 workloads, of two, three and four attributes.
MANY_SPACE = (lambda w: QuerySpace(w, [x for k in (2, 3, 4) for x in all_workloads(w, k)]))(domain("ord"))
SHARES_SQL = " UNION ALL ".join(f"SELECT k, '{a}' AS attr, {a} AS value, count(*) / sum(count(*)) OVER (PARTITION BY k) AS p FROM g GROUP BY k, {a}" for a in MANY_SPACE.domain)


def _many_sql() -> str:
    parts = []
    for w in MANY_SPACE.workloads:
        at = " + ".join([str(w.offset), *[f"x{i}.value * {s}" for i, s in enumerate(w.strides)]])
        joins = "p x0" + "".join(f" JOIN p x{i} ON x{i}.k = x0.k AND x{i}.attr = '{a}'" for i, a in enumerate(w.attrs) if i)
        parts.append(f"SELECT {at} AS query_id, sum({' * '.join(f'x{i}.p' for i in range(len(w.attrs)))}) / (SELECT count(DISTINCT k) FROM p) AS s FROM {joins} WHERE x0.attr = '{w.attrs[0]}' GROUP BY 1")
    return f"WITH g AS (SELECT *, o_orderkey % 40 AS k FROM ({relation_sql('ord')})), p AS MATERIALIZED ({SHARES_SQL}) SELECT range::BIGINT AS query_id, round(coalesce(s, 0), 9) AS ans FROM range({MANY_SPACE.n_queries}) LEFT JOIN ({' UNION ALL '.join(parts)}) ON query_id = range"


@query(_many_sql())
def soft_marginals_many(spark: SparkSession, d: str) -> DataFrame:
    """All two-, three- and four-way marginals of those rows."""
    orders = frame(spark, d, "ord")
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in MANY_SPACE.domain]))
    counts = orders.select((F.col("o_orderkey") % 40).alias("k"), cells.alias("c")).groupBy("k", "c.attr", "c.value").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("k", "attr")))
    return m.soft_answers_of_rows(shares.select("k", "attr", "value", "p"), MANY_SPACE).select("query_id", F.round("ans", 9).alias("ans"))


# A model whose logits are logarithms of counts: one row for each status.
COUNTED = {"priority": 5, "orderyear": 7}
COUNT_SQL = " UNION ALL ".join(
    f"SELECT k, '{a}' AS attr, {i} AS place, v AS value, (SELECT count(*) FROM e WHERE status = k AND {a} = v) + 1 AS c FROM range(3) s(k), range({n}) t(v)" for i, (a, n) in enumerate(COUNTED.items())
)


def _logits(spark: SparkSession, d: str) -> tuple[Domain, np.ndarray]:
    own = domain("ord", *COUNTED)
    space = QuerySpace(domain("ord", *SMALL), [("status", a) for a in COUNTED], ordered=False)
    logits, at = np.zeros((3, sum(own.shape))), own.offsets()
    for r in m.answers(encoded(spark, d, "ord", SMALL), space, density=None).collect():  # three rows of twelve
        values = space.values(r["query_id"])
        attr = next(a for a in COUNTED if a in values)
        logits[values["status"], at[attr] + values[attr]] = np.log(r["ans"] + 1)
    return own, logits


@fixed(f"WITH e AS ({relation_sql('ord')}), c AS ({COUNT_SQL}) SELECT k::INTEGER AS k, attr, value::INTEGER AS value, round(c / sum(c) OVER (PARTITION BY k, attr), 9) AS p FROM c")
def softmax_blocks(spark: SparkSession, d: str) -> DataFrame:
    own, logits = _logits(spark, d)
    p, at = models.softmax_blocks(logits, own), own.offsets()
    rows = [(k, a, v, round(float(p[k, at[a] + v]), 9)) for k in range(3) for a, n in own.config.items() for v in range(n)]
    return spark.createDataFrame(rows, "k int, attr string, value int, p double")


LIKELIEST = ", ".join(f"(SELECT value FROM c WHERE k = id % 3 AND attr = '{a}' ORDER BY c DESC, value LIMIT 1)::INTEGER AS {a}" for a in COUNTED)


@query(f"WITH e AS ({relation_sql('ord')}), c AS ({COUNT_SQL}) SELECT id, {LIKELIEST} FROM range(60) t(id)")
def argmax_decode(spark: SparkSession, d: str) -> DataFrame:
    """Each row's likeliest codes."""
    own, logits = _logits(spark, d)
    return models.sample_rows(spark, models.softmax_blocks(logits, own), own, 60, how="max")


FLAGGED = Domain.fromdict({"priority": 5, "orderyear": 7, "urgent": 2})
CDF_SQL = "SELECT k, place, value, round(sum(c) OVER (PARTITION BY k, place ORDER BY value) / sum(c) OVER (PARTITION BY k, place), 12) AS c FROM c"
DRAW_SQL = ", ".join(f"(SELECT least(count(*), {n - 1}) FROM f WHERE f.k = id % 3 AND place = {i} AND f.c <= {uniform_sql('13', f"id || ':{i}'")})::INTEGER AS {a}" for i, (a, n) in enumerate(COUNTED.items()))


@query(f"WITH e AS ({relation_sql('ord')}), c AS ({COUNT_SQL}), f AS ({CDF_SQL}) SELECT *, (priority < 2)::INTEGER AS urgent FROM (SELECT id, {DRAW_SQL} FROM range(3000) t(id))")
def sums_of_codes(spark: SparkSession, d: str) -> DataFrame:
    """An attribute that says whether another has one of some codes."""
    own, logits = _logits(spark, d)
    p = np.hstack([models.softmax_blocks(logits, own), np.full((3, 2), 0.5)])
    return models.sample_rows(spark, p, FLAGGED, 3000, seed=13, sums={"urgent": [("priority", 0), ("priority", 1)]})


# Errors --------------------------------------------------------------------

EVEN, ODD = "o_orderkey % 2 = 0", "o_orderkey % 2 = 1"
HALVES = (
    f"e AS ({relation_sql('ord', EVEN)}), o AS ({relation_sql('ord', ODD)}), t AS ({dense_sql(SW, 'e', by='(SELECT count(*) FROM e)')}), f AS ({dense_sql(SW, 'o', by='(SELECT count(*) FROM o)')}), "
    "s AS (SELECT query_id, abs(t.ans - f.ans) AS score FROM t JOIN f USING (query_id))"
)


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(m.answers(encoded(spark, d, "ord", SMALL, where), SW) for where in (EVEN, ODD))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.differences(*halves(spark, d)).select("query_id", "score")


@query(f"WITH {HALVES} SELECT round(max(score), 9) AS error_max, round(avg(score), 9) AS error_mean, round(sum(score * score) / count(*), 9) AS error_mean_squared FROM s")
def errors_summary(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.errors(*halves(spark, d))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


@query(f"WITH {HALVES} SELECT query_id, round(score, 9) AS score FROM s ORDER BY round(score, 9) DESC, query_id LIMIT 1")
def worst_query(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.top_errors(*halves(spark, d)).select("query_id", "score")


@query(f"WITH {HALVES} SELECT query_id, round(score, 9) AS score FROM s ORDER BY round(score, 9) DESC, query_id LIMIT 10")
def topk_errors(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.top_errors(*halves(spark, d), k=10).select("query_id", "score")


@query(f"WITH {HALVES} SELECT query_id, round(score, 9) AS score FROM s WHERE query_id % 5 <> 0")
def excluded_scores(spark: SparkSession, d: str) -> DataFrame:
    past = spark.range(SW.n_queries).where("id % 5 = 0").select(F.col("id").alias("query_id"))
    return evaluate.excluding(scores(spark, d), past).select("query_id", F.round("score", 9).alias("score"))


@query(f"WITH {HALVES} SELECT query_id, round(score, 9) AS score FROM s WHERE round(score, 9) >= 0.5 * (SELECT max(round(score, 9)) FROM s)")
def threshold_scores(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.above(scores(spark, d).select("query_id", F.round("score", 9).alias("score")), 0.5)


# Mechanisms: the noise is hashed alike on both sides ------------------------


def gumbel_sql(seed: str, key: str) -> str:
    return f"(-ln(-ln({uniform_sql(seed, key)})))"


def normal_sql(seed: str, key: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(seed + ':r', key)})) * cos(2 * pi() * {uniform_sql(seed + ':a', key)}))"


@query(f"WITH e AS ({relation_sql('ord')}), a AS ({dense_sql(SW, 'e', by='(SELECT count(*) FROM e)')}) SELECT query_id, round(least(1.0, greatest(0.0, ans + {normal_sql('5', 'query_id')} * 0.02)), 9) AS ans FROM a")
def gaussian_noise(spark: SparkSession, d: str) -> DataFrame:
    noisy = privacy.gaussian(m.answers(encoded(spark, d, "ord", SMALL), SW), 0.5, 0.01, 5)
    return privacy.clipped(noisy).select("query_id", F.round("ans", 9).alias("ans"))


@query(f"WITH {HALVES} SELECT query_id, round(score, 9) AS score FROM s ORDER BY round(score * (0.5 / 0.01) + {gumbel_sql('9', 'query_id')}, 9) DESC, query_id LIMIT 1")
def exponential_select(spark: SparkSession, d: str) -> DataFrame:
    return privacy.exponential(scores(spark, d), 0.5, 0.01, 9).select("query_id", F.round("score", 9).alias("score"))


@query(f"WITH {HALVES}, w AS (SELECT {wid_sql(SW, 'query_id')} AS wid, max(score) AS score FROM s GROUP BY 1) SELECT wid, round(score, 9) AS score FROM w ORDER BY round(score * (0.5 / 0.01) + {gumbel_sql('11', 'wid')}, 9) DESC, wid LIMIT 1")
def workload_select(spark: SparkSession, d: str) -> DataFrame:
    by = privacy.workload_scores(scores(spark, d).withColumn("wid", m.workload_column(SW)))
    return privacy.exponential(by, 0.5, 0.01, 11, key="wid").select("wid", F.round("score", 9).alias("score"))


@query(f"WITH {DISTR}, c AS (SELECT support_id, sum(w) OVER (ORDER BY support_id) AS cdf FROM w) SELECT min(support_id) AS support_id FROM c WHERE round(cdf, 9) >= 0.375")
def inverse_cdf_sample(spark: SparkSession, d: str) -> DataFrame:
    weighted = sup.support_distribution(full_support(spark, d), encoded(spark, d, "ord", SMALL))
    return privacy.inverse_cdf(weighted, 0.375 - 5e-10, "support_id")


EPS, DELTA = 1.0, 1e-9
# The bound's logarithm at order 1 + x, least over a fine grid of orders.
BOUND = "x * ((1 + x) * {rho} - eps) + (1 + x) * ln(x / (1 + x)) - ln(x)"


@fixed(
    f"""
WITH RECURSIVE c AS (SELECT {EPS}::DOUBLE AS eps, {DELTA}::DOUBLE AS delta),
b(k, low, high) AS (
  SELECT 0, 0.0::DOUBLE, eps + 1 FROM c
  UNION ALL
  SELECT k + 1, CASE WHEN worst <= ln(delta) THEN mid ELSE low END, CASE WHEN worst <= ln(delta) THEN high ELSE mid END
  FROM (
    SELECT k, low, high, mid, eps, delta, (SELECT min({BOUND.format(rho='mid')}) FROM (SELECT exp(i / 2000.0) AS x FROM range(-8000, 20000) t(i))) AS worst
    FROM (SELECT k, low, high, (low + high) / 2 AS mid FROM b WHERE k < 45), c
  )
)
SELECT 10::INTEGER AS rounds, round(low, 6) AS rho, round(sqrt(2 * low / (10 * 0.5)), 6) AS eps0 FROM b WHERE k = 45
"""
)
def zcdp_budget(spark: SparkSession, d: str) -> DataFrame:
    eps0, rho = privacy.per_round(EPS, DELTA, 10, 0.5)
    return spark.createDataFrame([(10, round(rho, 6), round(eps0, 6))], "rounds int, rho double, eps0 double")


def data_of(spark: SparkSession, d: str, where: str = "TRUE") -> EncodedData:
    return encoded(spark, d, "ord", SMALL, where)
