"""The register, and the encoded relations that queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import Domain, EncodedData

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


#: What reads no table, or is fitted on the driver from a small vector: compared
#: with its SQL, or run, by the tests alone.
FIXED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIXED_SQL: dict[str, str] = {}


def fixed(sql: str | None = None):
    """As query, but outside the register."""

    def take(f):
        FIXED[f.__name__] = f
        if sql is not None:
            FIXED_SQL[f.__name__] = sql
        return f

    return take


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ranked(column: str, values: list[str]) -> str:
    return f"CAST(CASE {column} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values)) + " END AS INT)"


def _banded(column: str, edges: list[float]) -> str:
    """Half-open bands; a repeated edge is a band of that value alone."""
    points = [f"WHEN {column} = {a} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:])) if a == b]
    spans = [f"WHEN {column} >= {a} AND {column} < {b} THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:])) if a != b]
    return f"CAST(CASE {' '.join(points + spans)} END AS INT)"


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
KINDS = ["click", "error", "purchase", "signup", "view"]
TOP = 1e18

# Expressions that Spark and DuckDB read alike.
LI = {
    "returnflag": (_ranked("l_returnflag", ["A", "N", "R"]), 3),
    "linestatus": (_ranked("l_linestatus", ["F", "O"]), 2),
    "linenumber": ("CAST(l_linenumber - 1 AS INT)", 7),
    "discount": ("CAST(round(l_discount * 100) AS INT)", 11),
    "tax": ("CAST(round(l_tax * 100) AS INT)", 9),
    "quantity": ("CAST(floor((l_quantity - 1) / 5) AS INT)", 10),
    "shipyear": ("CAST(year(l_shipdate) - 1995 AS INT)", 7),
}
ORD = {
    "status": (_ranked("o_orderstatus", ["F", "O", "P"]), 3),
    "priority": (_ranked("o_orderpriority", PRIORITIES), 5),
    "orderyear": ("CAST(year(o_orderdate) - 1995 AS INT)", 7),
    "segment": (_ranked("c_mktsegment", SEGMENTS), 5),
    "price": (_banded("o_totalprice", [0, 50000, 100000, 150000, 200000, 250000, 300000, 350000, 400000, 450000, TOP]), 10),
    "nation": ("CAST(c_nationkey AS INT)", 25),
}
EV = {
    "event_type": (_ranked("event_type", KINDS), 5),
    "hour": ("CAST(hour(ts) AS INT)", 24),
    "value": (_banded("value", [0, 0, 10, 50, 100, 150, 200, 300, TOP]), 8),
}
DOC = {
    "lang": (_ranked("lang", ["de", "en", "es", "fr"]), 4),
    "quality": ("CAST(coalesce(quality, -1) AS INT)", 2),
    "toxic": ("CAST(coalesce(toxic, -1) AS INT)", 2),
    "length": (_banded("n_chars", [0, 200, 1000, 5000, 20000, TOP]), 5),
}
PER = {
    "TABBLKST": ("CAST(n_regionkey AS INT)", 5),
    "TABBLKCOU": ("CAST(n_nationkey AS INT)", 25),
    "TABTRACTCE": ("CAST(c_custkey % 10 AS INT)", 10),
    "TABBLK": ("CAST(c_custkey % 4 AS INT)", 4),
    "QAGE": ("CAST(c_custkey % 116 AS INT)", 116),
    "QSEX": ("CAST(c_custkey % 2 + 1 AS INT)", 3),
    "CENRACE": ("CAST(c_custkey % 63 + 1 AS INT)", 64),
    "CENHISP": ("CAST(floor(c_custkey / 7) % 2 + 1 AS INT)", 3),
}
FROM = {
    "li": (LI, "lineitem", ()),
    "ord": (ORD, "orders JOIN customer ON o_custkey = c_custkey", ("o_orderkey", "o_totalprice")),
    "ev": (EV, "events", ()),
    "doc": (DOC, "documents LEFT JOIN labels ON documents.doc_id = labels.doc_id", ()),
    "per": (PER, "customer JOIN nation ON c_nationkey = n_nationkey", ("c_custkey",)),
}


def relation_sql(name: str, where: str = "TRUE", extra: str = "") -> str:
    columns, source, keys = FROM[name]
    return f"SELECT {', '.join([*keys, *[f'{e} AS {a}' for a, (e, _) in columns.items()]])}{extra} FROM {source} WHERE {where}"


def domain(name: str, *attrs: str) -> Domain:
    sizes = {a: n for a, (_, n) in FROM[name][0].items()}
    return Domain.fromdict({a: sizes[a] for a in attrs or sizes})


def frame(spark: SparkSession, d: str, name: str, where: str = "TRUE") -> DataFrame:
    """The relation by DataFrame operations on the tables it needs."""
    columns, source, keys = FROM[name]
    words = source.split()
    df = table(spark, d, words[0])
    if "JOIN" in words:
        right, how = table(spark, d, words[words.index("JOIN") + 1]), "left" if "LEFT" in words else "inner"
        if name == "doc":
            df = df.join(right.withColumnRenamed("doc_id", "__id"), df["doc_id"] == F.col("__id"), how)
        else:
            left_key, right_key = words[words.index("ON") + 1], words[-1]
            df = df.join(right, df[left_key] == right[right_key], how)
    return df.where(where).selectExpr(*keys, *[f"{e} AS {a}" for a, (e, _) in columns.items()])


def encoded(spark: SparkSession, d: str, name: str, attrs: list[str], where: str = "TRUE", weight: str | None = None) -> EncodedData:
    return EncodedData(frame(spark, d, name, where), domain(name, *attrs), weight)

