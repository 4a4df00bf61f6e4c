"""Encoders, domains, splits and result stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import Domain, EncodedData
from ..functions import encode as en
from ..operators import evaluate
from ..operators import support as sup
from ..plans.workload import QuerySpace
from ..sources import io
from .marginal import cells_sql, values_sql
from .register import DOC, EV, domain, encoded, fixed, frame, query, relation_sql, table

RANKS = "SELECT o_orderpriority, (row_number() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority")


@query(f"SELECT o_orderkey, code FROM orders JOIN ({RANKS}) USING (o_orderpriority)")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    return en.encode(df, "o_orderpriority", en.dictionary(df, "o_orderpriority"), to="code").select("o_orderkey", "code")


@query("SELECT o_orderkey, (CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END)::INTEGER AS code FROM orders")
def label_encode_other(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    values = en.dictionary(df, "o_orderpriority", declared=["2-HIGH", "1-URGENT"], other=True)
    return en.encode(df, "o_orderpriority", values, other=True, to="code").select("o_orderkey", "code")


@query("SELECT o_orderkey, o_orderpriority AS label FROM orders")
def label_decode(spark: SparkSession, d: str) -> DataFrame:
    df = _orders(spark, d)
    values = en.dictionary(df, "o_orderpriority")
    return en.decode(en.encode(df, "o_orderpriority", values, to="code"), "code", values, to="label").select("o_orderkey", "label")


PRICES = [0, 1000, 5000, 10000, 20000, 50000, 1e12]


def _case(column: str, edges: list[float]) -> str:
    return "(CASE " + " ".join(f"WHEN {column} >= {a} AND {column} < {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " END)::INTEGER"


@query(f"SELECT l_orderkey, l_linenumber, {_case('l_extendedprice', PRICES)} AS bin FROM lineitem")
def bin_explicit(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    edges = en.fit_edges(li, {"l_extendedprice": PRICES})["l_extendedprice"]
    return li.select("l_orderkey", "l_linenumber", en.bin_code(F.col("l_extendedprice").cast("double"), edges).alias("bin"))


@query(
    "WITH r AS (SELECT min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, ("
    + " + ".join(f"(l_quantity >= lo + (hi - lo) / 10 * {i})::INTEGER" for i in range(1, 10))
    + ")::INTEGER AS bin FROM lineitem, r"
)
def bin_equal_width(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    edges = en.fit_edges(li, {"l_quantity": 10})["l_quantity"]
    return li.select("l_orderkey", "l_linenumber", en.bin_code(F.col("l_quantity").cast("double"), edges).alias("bin"))


REPEAT = [0, 0, 10, 50, 100, 150, 200, 300, en.INF]


@query(f"SELECT event_id, {EV['value'][0]} AS bin FROM (SELECT event_id, value FROM events UNION ALL SELECT -1, 0.0)")
def bin_repeat_edge(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").selectExpr("event_id", "CAST(value AS DOUBLE) AS value").unionAll(spark.sql("SELECT -1L AS event_id, 0.0D AS value"))
    return ev.select("event_id", en.bin_code(F.col("value"), REPEAT).alias("bin"))


LABELS = en.bin_labels(REPEAT)


@query("WITH e AS (" + relation_sql("ev") + ") SELECT label, count(*) AS n FROM e JOIN (" + values_sql([(i, x) for i, x in enumerate(LABELS)], "value, label") + ") USING (value) GROUP BY label")
def bin_labels(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(en.bin_code(F.col("value").cast("double"), REPEAT).alias("bin"))
    return en.decode(ev, "bin", LABELS, to="label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


CONFIG = en.Config(categorical=["o_orderstatus", "o_orderpriority"], bins={"o_totalprice": [0, 100000, 200000, 300000, 400000, en.INF]})


@query("SELECT 'o_orderstatus' AS attr, count(DISTINCT o_orderstatus)::INTEGER AS size FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority)::INTEGER FROM orders UNION ALL SELECT 'o_totalprice', 5")
def encoded_domain(spark: SparkSession, d: str) -> DataFrame:
    fitted = en.Encoder(CONFIG).fit(table(spark, d, "orders"))
    return spark.createDataFrame(list(fitted.domain.config.items()), "attr string, size int")


@query(
    "SELECT (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS o_orderstatus, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS o_orderpriority, "
    + _case("o_totalprice", [0, 100000, 200000, 300000, 400000, 1e18])
    + " AS o_totalprice FROM orders"
)
def encode_table(spark: SparkSession, d: str) -> DataFrame:
    return en.Encoder(CONFIG).fit_transform(table(spark, d, "orders"))


@query("WITH e AS (" + relation_sql("li") + ") SELECT 'returnflag' AS attr, 3 AS size, max(returnflag) AS largest, count(*) FILTER (returnflag >= 3) AS n_bad FROM e UNION ALL SELECT 'discount', 5, max(discount), count(*) FILTER (discount >= 5) FROM e")
def domain_validate(spark: SparkSession, d: str) -> DataFrame:
    return en.out_of_domain(frame(spark, d, "li"), Domain.fromdict({"returnflag": 3, "discount": 5}))


ONEHOT = domain("doc")


@query(
    "WITH e AS (SELECT documents.doc_id, " + ", ".join(f"{x} AS {a}" for a, (x, _) in DOC.items()) + " FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id) SELECT doc_id, concat_ws(',', "
    + ", ".join(f"CASE WHEN {a} >= 0 THEN {a} + {at} END" for a, at in ONEHOT.offsets().items())
    + ") AS positions FROM e"
)
def onehot_positions(spark: SparkSession, d: str) -> DataFrame:
    """Missing labels (-1) have no place."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels").withColumnRenamed("doc_id", "__id")
    rows = docs.join(labels, F.col("doc_id") == F.col("__id"), "left").selectExpr("doc_id", *[f"{x} AS {a}" for a, (x, _) in DOC.items()])
    return rows.select("doc_id", F.array_join(F.transform(en.onehot_positions(ONEHOT), lambda p: p.cast("string")), ",").alias("positions"))


@query("SELECT returnflag, linestatus, count(*) AS n FROM (" + relation_sql("li") + ") GROUP BY ALL")
def onehot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    own = domain("li", "returnflag", "linestatus")
    coded = frame(spark, d, "li").select(en.onehot_positions(own).alias("p"))
    return coded.select(*en.onehot_decode(F.col("p"), own)).groupBy("returnflag", "linestatus").agg(F.count(F.lit(1)).alias("n"))


SPLIT = "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey % 5000 END"


@query(
    f"WITH o AS (SELECT o_orderkey, ({SPLIT})::VARCHAR AS id FROM orders) SELECT o_orderkey, (row_number() OVER (ORDER BY md5(coalesce(id, '') || ':3') || md5(coalesce(id, '') || ':' || o_orderkey)) "
    "<= (SELECT round(0.8 * count(*)) FROM orders)) AS train FROM o"
)
def train_test_split(spark: SparkSession, d: str) -> DataFrame:
    """By an id that some rows lack and others share."""
    rows = table(spark, d, "orders").selectExpr(f"{SPLIT} AS id", "o_orderkey")
    train, test = en.train_test_split(rows, "id", 0.8, 3)
    return train.select("o_orderkey", F.lit(True).alias("train")).unionByName(test.select("o_orderkey", F.lit(False).alias("train")))


@query("SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_partkey) - 1 AS code FROM lineitem")
def label_encode_table(spark: SparkSession, d: str) -> DataFrame:
    """Values numbered as a table, for columns of any number of values."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return en.encode_numbered(li, "l_partkey", en.numbered(li, "l_partkey"), to="code").select("l_orderkey", "l_linenumber", "code")


@fixed("SELECT i::INTEGER AS r, least(i, 2)::INTEGER AS a, least(i, 6)::INTEGER AS b, 0::INTEGER AS c FROM range(7) t(i)")
def domain_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every code of every attribute at least once."""
    return en.domain_rows(spark, Domain.fromdict({"a": 3, "b": 7, "c": 1})).select(F.greatest("a", "b", "c").alias("r"), "a", "b", "c")


PART_SQL = """
WITH e AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT min(c_acctbal)::DOUBLE AS low, max(c_acctbal)::DOUBLE AS high FROM e),
s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS seg FROM (SELECT DISTINCT c_mktsegment FROM e)),
d AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS nat FROM (SELECT DISTINCT c_nationkey FROM e WHERE n_regionkey = 2))
"""


def _part(spark: SparkSession, d: str, mixed: bool = False) -> en.Prepared:
    """Customers of one region over all regions' segments and balances, and its own
    nations; a constant column leaves."""
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    every = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_mktsegment", "c_nationkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), "n_regionkey", F.lit("x").alias("same"))
    return en.prepare_part(every, every.where("n_regionkey = 2"), ["c_mktsegment", "c_nationkey", "same"], ["c_acctbal"], 10, own=["c_nationkey"], mixed=mixed)


@query(PART_SQL + "SELECT seg::INTEGER AS c_mktsegment, nat::INTEGER AS c_nationkey, (" + " + ".join(f"(c_acctbal >= low + (high - low) / 10 * {i})::INTEGER" for i in range(1, 10)) + ")::INTEGER AS c_acctbal FROM e JOIN s USING (c_mktsegment) JOIN d USING (c_nationkey), r")
def prepare_region(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d).df


@query(PART_SQL + "SELECT seg::INTEGER AS c_mktsegment, nat::INTEGER AS c_nationkey, c_acctbal::DOUBLE AS c_acctbal FROM e JOIN s USING (c_mktsegment) JOIN d USING (c_nationkey)")
def prepare_region_mixed(spark: SparkSession, d: str) -> DataFrame:
    return _part(spark, d, mixed=True).df


@query(
    PART_SQL + "SELECT 'all' AS part, 'c_mktsegment' AS attr, count(*)::INTEGER AS size FROM s UNION ALL SELECT 'all', 'c_nationkey', count(*)::INTEGER FROM d UNION ALL SELECT 'all', 'c_acctbal', 10 "
    "UNION ALL SELECT 'cat', 'c_mktsegment', count(*)::INTEGER FROM s UNION ALL SELECT 'cat', 'c_nationkey', count(*)::INTEGER FROM d UNION ALL SELECT 'num', 'c_acctbal', 1"
)
def prepare_region_domains(spark: SparkSession, d: str) -> DataFrame:
    """The domains of the binned table and of the mixed one's two halves."""
    mixed = _part(spark, d, mixed=True)
    parts = {"all": _part(spark, d).domain, "cat": mixed.only("cat").domain, "num": mixed.only("num").domain}
    return spark.createDataFrame([(k, a, n) for k, dom in parts.items() for a, n in dom.config.items()], "part string, attr string, size int")


@query("WITH u AS (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) SELECT (dense_rank() OVER (ORDER BY nation) - 1)::INTEGER AS code, count(*) AS n FROM u GROUP BY nation")
def union_concat(spark: SparkSession, d: str) -> DataFrame:
    frames = [table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))]
    coded = en.Encoder(en.Config(categorical=["nation"])).fit_transform(frames)
    return coded.groupBy(F.col("nation").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'status' AS attr, count(DISTINCT o_orderstatus)::INTEGER AS size FROM orders")
def constant_drop(spark: SparkSession, d: str) -> DataFrame:
    """An attribute of one value leaves the domain."""
    df = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.lit("x").alias("constant"))
    fitted = en.Encoder(en.Config(categorical=["status", "constant"])).fit(df)
    return spark.createDataFrame(list(en.constant_free(fitted.domain).config.items()), "attr string, size int")


@query("SELECT array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS c_mktsegment, min(c_acctbal) AS min_c_acctbal, max(c_acctbal) AS max_c_acctbal FROM customer")
def domain_union(spark: SparkSession, d: str) -> DataFrame:
    found = en.union_domain(table(spark, d, "customer"), ["c_mktsegment"], ["c_acctbal"])
    return found.withColumn("c_mktsegment", F.array_join("c_mktsegment", ","))


@query("SELECT n_regionkey AS region, count(DISTINCT n_nationkey) AS n_nations, min(n_nationkey) AS first_nation FROM nation GROUP BY 1")
def state_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains of an attribute within each state."""
    return en.domains_within(table(spark, d, "nation"), "n_regionkey", "n_nationkey").select(F.col("n_regionkey").alias("region"), F.col("size").alias("n_nations"), F.col("low").alias("first_nation"))


@query(f"SELECT c_custkey, CASE WHEN QSEX = 1 THEN 'Male' ELSE 'Female' END AS sex, CASE WHEN CENHISP = 1 THEN 'Not HLO' ELSE 'HLO' END AS origin FROM ({relation_sql('per')})")
def recode_person(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "per").select("c_custkey", en.recode_sex(F.col("QSEX")).alias("sex"), en.recode_origin(F.col("CENHISP")).alias("origin"))


@fixed("SELECT s AS sex, h AS origin, r::INTEGER AS region FROM (VALUES ('Female'), ('Male')) a(s), (VALUES ('HLO'), ('Not HLO')) b(h), range(5) c(r)")
def row_space(spark: SparkSession, d: str) -> DataFrame:
    """Every combination of allowed values."""
    values = {"sex": ["Female", "Male"], "origin": ["HLO", "Not HLO"], "region": list(range(5))}
    space = sup.full_support(spark, Domain.fromdict({a: len(v) for a, v in values.items()})).drop("support_id")
    for a in ("sex", "origin"):
        space = en.decode(space, a, values[a])
    return space


@query("SELECT discount, linestatus FROM (" + relation_sql("li") + ")")
def project_drop(spark: SparkSession, d: str) -> DataFrame:
    data = encoded(spark, d, "li", ["returnflag", "linestatus", "discount"])
    return data.project(["discount", "linestatus", "returnflag"]).drop("returnflag").df


@fixed("SELECT 0 AS low_a, 2 AS high_a, 0 AS low_b, 6 AS high_b, 10000::BIGINT AS n")
def synthetic_uniform_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = EncodedData.synthetic(spark, Domain.fromdict({"a": 3, "b": 7}), 10_000, seed=1).df
    return rows.agg(F.min("a").alias("low_a"), F.max("a").alias("high_a"), F.min("b").alias("low_b"), F.max("b").alias("high_b"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, min(o_totalprice)::DOUBLE AS error_max FROM orders GROUP BY 1, 2")
def best_run_per_config(spark: SparkSession, d: str) -> DataFrame:
    """Orders as runs, their status and priority as configurations."""
    runs = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("double").alias("error_max"))
    return evaluate.best_runs(runs, ["o_orderstatus", "o_orderpriority"], rounds=False)


RUNS = [
    ("adult", 32, 1.0, 0.5, 0.5, 0.12, 0.010), ("adult", 32, 1.0, 0.5, 0.9, 0.09, 0.011), ("adult", 32, 0.5, 1.0, 0.5, 0.2, 0.03),
    ("acs", 16, 1.0, 2.0, None, 0.07, 0.02), ("acs", 16, 1.0, 2.0, 0.5, 0.08, 0.01),
]
RUN_SQL = values_sql(RUNS, "dataset, workload, epsilon, T, alpha, error_max, error_mean")
RUN_SCHEMA = "dataset string, workload int, epsilon double, T double, alpha double, error_max double, error_mean double"


@fixed(f"SELECT dataset, workload, epsilon::DOUBLE AS epsilon, T::DOUBLE AS T, alpha::DOUBLE AS alpha, error_max::DOUBLE AS error_max, error_mean::DOUBLE AS error_mean, (T * workload)::INTEGER AS rounds FROM ({RUN_SQL}) QUALIFY row_number() OVER (PARTITION BY dataset, workload, epsilon ORDER BY error_max) = 1")
def best_run_with_rounds(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_runs(spark.createDataFrame(RUNS, RUN_SCHEMA), ["dataset", "workload", "epsilon"])


@query("SELECT documents.doc_id, lang FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id WHERE lang = 'en' AND quality IS NULL")
def resume_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows by flags of which one is null: English documents without a label."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select(F.col("doc_id").alias("__id"), "quality")
    every = docs.join(labels, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "lang", "quality")
    return io.matching_results(every, {"lang": "en", "quality": None}).select("doc_id", "lang")


STREAMED = QuerySpace(domain("ev", "event_type", "hour"), [("event_type", "hour"), ("event_type",)])


@query(f"WITH e AS ({relation_sql('ev')}) SELECT query_id, s::BIGINT AS n FROM ({cells_sql(STREAMED, 'e')})")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts kept over the events as a stream, read once to its end."""
    import uuid

    from ..streaming.upkeep import running_counts

    schema = table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).selectExpr(*[f"{x} AS {a}" for a, (x, _) in EV.items()])
    name = f"counts_{uuid.uuid4().hex}"
    running_counts(rows, STREAMED).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
