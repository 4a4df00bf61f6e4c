"""Geography and census tables over arithmetic persons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domain import EncodedData
from ..functions import census, geo, schema
from ..operators import setquery as sq
from .marginal import values_sql
from .register import domain, fixed, frame, query, relation_sql

PER_SQL = relation_sql("per")
NAMES = {"state": "TABBLKST", "county": "TABBLKCOU", "tract": "TABTRACTCE", "block": "TABBLK"}
GEOID_SQL = "lpad(TABBLKST || '', 2, '0') || lpad(TABBLKCOU || '', 3, '0') || lpad(TABTRACTCE || '', 6, '0') || lpad(TABBLK || '', 4, '0')"
RAW = {"Male": 1, "Female": 2, census.NOT_HLO: 1, census.HLO: 2}


def _parts() -> dict:
    return {p: F.col(c) for p, c in NAMES.items()}


@query(f"SELECT * FROM ({PER_SQL}) WHERE TABBLKST = 2")
def geo_partition_filter(spark: SparkSession, d: str) -> DataFrame:
    return geo.select_place(frame(spark, d, "per"), NAMES, {"state": 2})


@query(f"SELECT * FROM ({PER_SQL}) WHERE TABBLKST = 1 AND TABTRACTCE = 3 AND TABBLK = 1")
def geo_filter(spark: SparkSession, d: str) -> DataFrame:
    return geo.select_place(frame(spark, d, "per"), NAMES, {"state": 1, "tract": 3, "block": 1})


@query(f"SELECT {GEOID_SQL} AS geoid, count(*) AS n FROM ({PER_SQL}) GROUP BY 1")
def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "per").groupBy(geo.geoid(_parts()).alias("geoid")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_custkey, {GEOID_SQL} AS geoid FROM ({PER_SQL})")
def geoid_format(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "per").select("c_custkey", geo.geoid(_parts()).alias("geoid"))


@query(f"SELECT c_custkey, 'G' || lpad(TABBLKST || '', 2, '0') || '0' || lpad(TABBLKCOU || '', 3, '0') || '0' || lpad(TABTRACTCE || '', 6, '0') || lpad(TABBLK || '', 4, '0') AS gisjoin FROM ({PER_SQL})")
def gisjoin_format(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "per").select("c_custkey", geo.gisjoin(_parts()).alias("gisjoin"))


@query(f"SELECT c_custkey, TABBLKST AS state, TABBLKCOU AS county, CASE WHEN c_custkey % 3 > 0 THEN TABTRACTCE END AS tract, CASE WHEN c_custkey % 3 > 1 THEN TABBLK END AS block FROM ({PER_SQL})")
def geoid_parse(spark: SparkSession, d: str) -> DataFrame:
    """Keys of three lengths: county, tract and block."""
    key = geo.geoid(_parts())
    cut = F.substring(key, F.lit(1), F.when(F.col("c_custkey") % 3 == 0, 5).when(F.col("c_custkey") % 3 == 1, 11).otherwise(15))
    return frame(spark, d, "per").select("c_custkey", cut.alias("k")).select("c_custkey", *geo.parse_geoid(F.col("k")))


@query(f"SELECT c_custkey, TABBLKST AS state, TABBLKCOU AS county, TABTRACTCE AS tract, TABBLK AS block FROM ({PER_SQL})")
def gisjoin_parse(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "per").select("c_custkey", geo.gisjoin(_parts()).alias("k")).select("c_custkey", *geo.parse_gisjoin(F.col("k")))


@query(f"SELECT TABBLKST AS state, TABBLKCOU AS county, count(*) AS n FROM ({PER_SQL}) GROUP BY 1, 2")
def geo_rollup(spark: SparkSession, d: str) -> DataFrame:
    places = frame(spark, d, "per").select(*[F.col(c).alias(p) for p, c in NAMES.items()])
    return geo.roll_up(places, "county").groupBy(*geo.PARTS).agg(F.count(F.lit(1)).alias("n")).drop("tract", "block")


@query(
    f"WITH s AS (SELECT {GEOID_SQL} AS key, count(*) AS n FROM ({PER_SQL}) GROUP BY 1), t AS (SELECT max(n) // d AS target FROM s, (VALUES (1), (2), (4), (8), (16)) v(d) GROUP BY d) "
    "SELECT target, key, n FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(n - target), key) AS r FROM s, (SELECT DISTINCT target FROM t)) WHERE r = 1"
)
def nearest_size_blocks(spark: SparkSession, d: str) -> DataFrame:
    sizes = group_sizes(spark, d).withColumnRenamed("geoid", "key")
    top = sizes.agg(F.max("n").alias("top"))
    targets = top.select(F.explode(F.array(*[F.floor(F.col("top") / k) for k in (1, 2, 4, 8, 16)])).alias("target")).distinct()
    return geo.nearest_size(sizes, targets)


# Races by combinatorics in SQL: subsets of six, by size, then by their members in order.
RACE_SQL = (
    "SELECT row_number() OVER (ORDER BY n, members)::INTEGER AS race_id, mask::INTEGER AS mask, n::INTEGER AS n_races, "
    f"CASE WHEN n = 1 THEN names[members[1]] || ' alone' ELSE array_to_string(list_transform(members, lambda k: names[k]), '; ') END AS name "
    "FROM (SELECT mask, bit_count(mask::INTEGER) AS n, list_filter([1, 2, 3, 4, 5, 6], lambda k: (mask::INTEGER >> (k - 1)) & 1 = 1) AS members, "
    f"[{', '.join(repr(r) for r in census.RACES)}] AS names FROM range(1, 64) t(mask))"
)


@fixed(RACE_SQL)
def race_dimension(spark: SparkSession, d: str) -> DataFrame:
    return census.race_table(spark)


@query(f"SELECT n_races::INTEGER AS n_races, count(*) AS n FROM ({PER_SQL}) JOIN ({RACE_SQL}) ON CENRACE = race_id GROUP BY 1")
def persons_by_races(spark: SparkSession, d: str) -> DataFrame:
    races = F.broadcast(census.race_table(spark).select("race_id", "n_races"))
    return frame(spark, d, "per").join(races, F.col("CENRACE") == F.col("race_id")).groupBy("n_races").agg(F.count(F.lit(1)).alias("n"))


def coded(cell: census.Cell) -> dict[str, list[int]]:
    return {a: [RAW.get(v, v) for v in vs] for a, vs in cell.allowed().items()}


# The tables' cells, written out anew for the SQL: bands of ages, variants by race
# (ids 1 to 6 are one race alone, larger ones several) and by origin (1 not HLO, 2 HLO).
BANDS = [0, 5, 10, 15, 18, 20, 21, 22, 25, 30, 35, 40, 45, 50, 55, 60, 62, 65, 67, 70, 75, 80, 85, 116]
SINGLE = [*range(101), 105, 110, 116]
VARIANTS = [*[f"CENRACE = {i}" for i in range(1, 7)], "CENRACE > 6", "CENHISP = 2", *[f"CENRACE = {i} AND CENHISP = 1" for i in range(1, 7)]]


def _ages_sql(name: str, bands: list[int], women: bool, where: str = "TRUE") -> str:
    """All, men, men by age, women and, for some tables, women by age."""
    ages = list(zip(bands, bands[1:]))
    cells = ["TRUE", "QSEX = 1", *[f"QSEX = 1 AND QAGE >= {a} AND QAGE < {b}" for a, b in ages], "QSEX = 2"]
    cells += [f"QSEX = 2 AND QAGE >= {a} AND QAGE < {b}" for a, b in ages] if women else []
    counts = ", ".join(f"count(*) FILTER ({c})" for c in cells)
    return f"SELECT '{name}' AS table_name, unnest(range(1, {len(cells) + 1}))::INTEGER AS cell, unnest([{counts}])::BIGINT AS n FROM e WHERE {where}"


def _races_sql(where: str, last_triple: bool) -> str:
    """Cells 4 to 73: totals by the number of races, and each set of races."""
    totals = {4: "n_races = 1", 11: "n_races > 1", 12: "n_races = 2", 28: "n_races = 3", 49: "n_races = 4", 65: "n_races = 5", 72: "n_races = 6"}
    own = f"(SELECT * FROM e JOIN r ON CENRACE = race_id WHERE CENHISP = 1 AND {where})"
    parts = [f"SELECT {cell} AS cell, count(*) FILTER ({c}) AS n FROM {own}" for cell, c in totals.items()]
    of_set = "CASE WHEN r.n_races = 1 THEN r.race_id + 4 ELSE r.race_id + 4 + r.n_races END"
    parts.append(f"SELECT {of_set}, count(x.race_id) FROM r LEFT JOIN {own} x USING (race_id) {'' if last_triple else 'WHERE r.race_id <> 41'} GROUP BY 1")
    return " UNION ALL ".join(parts)


def _sql(body: str, of: str = "cell::INTEGER AS cell, n::BIGINT AS n") -> str:
    return f"WITH e AS ({PER_SQL}), r AS ({RACE_SQL}) SELECT {of} FROM ({body})"


def _having_sql(first: int, where: str) -> str:
    """One cell for each race: persons who have it, alone or with others."""
    return f"SELECT {first} + i AS cell, count(*) FILTER ((mask >> i) & 1 = 1 AND {where}) AS n FROM e JOIN r ON CENRACE = race_id, range(6) t(i) GROUP BY i"


P12 = " UNION ALL ".join(_ages_sql(f"P12{x}", BANDS, False, w) for x, w in zip("ABCDEFGHI", VARIANTS))
PCT12 = " UNION ALL ".join(_ages_sql(f"PCT12{x}", SINGLE, True, w) for x, w in zip("ABCDEFGHIJKLMN", VARIANTS))
P11 = " UNION ALL ".join(f"SELECT {c} AS cell, count(*) AS n FROM e WHERE QAGE >= 18 AND {w}" for c, w in ((1, "TRUE"), (2, "CENHISP = 2"), (3, "CENHISP = 1")))


def _counted(spark: SparkSession, d: str, *tables: str) -> DataFrame:
    """(table_name, cell, n): persons are counted once by age, sex, race and origin,
    then all cells of the tables are read off those counts."""
    cells = [c for c in census.census_cells() if c.table in tables]
    data = EncodedData(frame(spark, d, "per"), domain("per", "QAGE", "QSEX", "CENRACE", "CENHISP"))
    found = sq.set_answers(data, [coded(c) for c in cells], density=False)
    names = spark.createDataFrame([(i, c.table, c.cell) for i, c in enumerate(cells)], "qid int, table_name string, cell int")
    return found.join(F.broadcast(names), "qid").select("table_name", "cell", F.col("ans").cast("bigint").alias("n"))


@query(f"SELECT 1::INTEGER AS cell, count(*)::BIGINT AS n FROM ({PER_SQL})")
def census_p1(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "P1").select("cell", "n")


@query(_sql(_having_sql(2, "TRUE")))
def census_p6(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "P6").select("cell", "n")


@query(_sql(_having_sql(3, "CENHISP = 1") + " UNION ALL " + _having_sql(10, "CENHISP = 2")))
def census_p7(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "P7").select("cell", "n")


@query(_sql(_races_sql("TRUE", True)))
def census_p9(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "P9").select("cell", "n")


@query(_sql(P11 + " UNION ALL " + _races_sql("QAGE >= 18", False)))
def census_p11(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "P11").select("cell", "n")


@query(_sql(_ages_sql("P12", BANDS, False)))
def census_p12(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "P12").select("cell", "n")


@query(_sql(P12, "table_name, cell, n"))
def census_p12_variants(spark: SparkSession, d: str) -> DataFrame:
    """Tables A to I, by race and origin."""
    return _counted(spark, d, *[f"P12{x}" for x in "ABCDEFGHI"])


@query(_sql(_ages_sql("PCT1", SINGLE, True)))
def census_pct1(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, "PCT1").select("cell", "n")


@query(_sql(PCT12, "table_name, cell, n"))
def census_pct12_variants(spark: SparkSession, d: str) -> DataFrame:
    """Tables A to N: 2,926 cells."""
    return _counted(spark, d, *[f"PCT12{x}" for x in "ABCDEFGHIJKLMN"])


@query(
    f"WITH e AS ({PER_SQL}) SELECT TABBLKST AS state, TABBLK AS block, unnest([2, 3, 4])::INTEGER AS cell, unnest([count(*) FILTER (QSEX = 1), count(*) FILTER (QSEX = 1 AND QAGE < 5), count(*) FILTER (QSEX = 1 AND QAGE BETWEEN 5 AND 9)])::BIGINT AS n FROM e GROUP BY 1, 2"
)
def census_by_block(spark: SparkSession, d: str) -> DataFrame:
    """Cells of P12 in every block of every state, from one count of persons."""
    cells = [c for c in census.census_cells() if c.table == "P12" and c.cell in (2, 3, 4)]
    data = EncodedData(frame(spark, d, "per"), domain("per", "TABBLKST", "TABBLK", "QAGE", "QSEX"))
    found = sq.set_answers(data, [coded(c) for c in cells], density=False, by=["TABBLKST", "TABBLK"])
    return found.select(F.col("TABBLKST").alias("state"), F.col("TABBLK").alias("block"), (F.col("qid") + 2).cast("int").alias("cell"), F.col("ans").cast("bigint").alias("n"))


PLACES = "SELECT *, lpad(TABBLKST || '', 2, '0') || lpad(TABBLKCOU || '', 3, '0') AS geoid FROM (" + PER_SQL + ")"


@query(f"WITH e AS ({PLACES}) SELECT geoid, dense_rank() OVER (PARTITION BY geoid ORDER BY TABBLK) - 1 AS block, QAGE AS age, (QSEX = 1)::INTEGER AS sex, CENRACE - 1 AS race, (CENHISP = 1)::INTEGER AS origin FROM e")
def release_rows(spark: SparkSession, d: str) -> DataFrame:
    """Persons of every county, coded over the county's own blocks."""
    rows = schema.release_places(frame(spark, d, "per"), NAMES, "county").rows
    return rows.select("geoid", F.col("TABBLK").cast("long").alias("block"), F.col("QAGE").alias("age"), F.col("QSEX").alias("sex"), F.col("CENRACE").alias("race"), F.col("CENHISP").alias("origin"))


@query(
    f"WITH e AS ({PLACES}) SELECT geoid, 'TABBLK' AS attr, count(DISTINCT TABBLK)::INTEGER AS size FROM e GROUP BY geoid UNION ALL SELECT geoid, a, n FROM (SELECT DISTINCT geoid FROM e), (VALUES ('QAGE', 116), ('QSEX', 2), ('CENRACE', 63), ('CENHISP', 2)) v(a, n)"
)
def release_domains(spark: SparkSession, d: str) -> DataFrame:
    return schema.release_places(frame(spark, d, "per"), NAMES, "county").domain


BLOCK_CELLS = sum(c.level == "Block" for c in census.cells_of(tract=True))
TRACT_CELLS = sum(c.level == "Tract" for c in census.cells_of(tract=True))


@query(f"WITH e AS ({PLACES}) SELECT geoid, count(DISTINCT TABBLK) * {BLOCK_CELLS} + {TRACT_CELLS} AS n, 2 * count(DISTINCT TABBLK) AS n_p12_men_5_9 FROM e GROUP BY geoid")
def release_query_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many queries each county's release has; men of 5 to 9 are cells of P12
    (and of nine variants, which aren't counted here) in every block."""
    queries = schema.release_places(frame(spark, d, "per"), NAMES, "county").queries
    men = F.col("table_name").isin("P12", "P12H") & F.col("sexes").eqNullSafe(F.array(F.lit(1))) & F.col("ages").eqNullSafe(F.array(*[F.lit(a) for a in range(5, 10)]))
    return queries.groupBy("geoid").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(men, 1)).alias("n_p12_men_5_9"))


def _release_cells() -> list[tuple[str, int, bool, str]]:
    """(table, cell, of blocks, condition) of a release, from the same bands,
    variants and numbers of races as above."""
    sizes = [n for n, many in enumerate((6, 15, 20, 15, 6, 1), 1) for _ in range(many)]
    out = [("P1", 1, True, "TRUE")]
    having = [f"(mask >> {i}) & 1 = 1" for i in range(6)]
    out += [("P6", 2 + i, True, h) for i, h in enumerate(having)]
    out += [("P7", first + i, True, f"{h} AND CENHISP = {o}") for first, o in ((3, 1), (10, 2)) for i, h in enumerate(having)]
    totals = {4: "n_races = 1", 11: "n_races > 1", 12: "n_races = 2", 28: "n_races = 3", 49: "n_races = 4", 65: "n_races = 5", 72: "n_races = 6"}
    for name, where in (("P9", "CENHISP = 1"), ("P11", "CENHISP = 1 AND QAGE >= 18")):
        sets = [(i + 4 + (n if n > 1 else 0), f"race_id = {i}") for i, n in enumerate(sizes, 1) if not (name == "P11" and i == 41)]
        out += [(name, c, True, f"{p} AND {where}") for c, p in [*totals.items(), *sets]]
    out += [("P11", c, True, f"QAGE >= 18 AND {w}") for c, w in ((1, "TRUE"), (2, "CENHISP = 2"), (3, "CENHISP = 1"))]
    by_age = [("P12", BANDS, False, "TRUE"), *[(f"P12{x}", BANDS, False, w) for x, w in zip("ABCDEFGHI", VARIANTS)], ("PCT1", SINGLE, True, "TRUE")]
    for name, bands, women, where in by_age:
        ages = [f"QAGE >= {a} AND QAGE < {b}" for a, b in zip(bands, bands[1:])]
        own = ["TRUE", "QSEX = 1", *[f"QSEX = 1 AND {a}" for a in ages], "QSEX = 2", *([f"QSEX = 2 AND {a}" for a in ages] if women else [])]
        out += [(name, c, name != "PCT1", f"{p} AND {where}") for c, p in enumerate(own, 1)]
    return out


def _release_sql() -> str:
    parts = []
    for of_blocks in (True, False):
        cells = [c for c in _release_cells() if c[2] == of_blocks]
        lists = [f"unnest([{', '.join(repr(x[k]) for x in cells)}]) AS {n}" for k, n in ((0, "table_name"), (1, "cell"))]
        counts = ", ".join(f"count(*) FILTER ({c[3]})" for c in cells)
        block = "block" if of_blocks else "NULL::INTEGER AS block"
        parts.append(f"SELECT geoid, {block}, {', '.join(lists)}, unnest([{counts}])::BIGINT AS n FROM b GROUP BY geoid{', block' if of_blocks else ''}")
    rank = "(dense_rank() OVER (PARTITION BY geoid ORDER BY TABBLK) - 1)::INTEGER AS block"
    return f"WITH r AS ({RACE_SQL}), b AS (SELECT *, {rank} FROM ({PLACES}) JOIN r ON CENRACE = race_id) SELECT geoid, block, table_name, cell::INTEGER AS cell, n FROM ({' UNION ALL '.join(parts)})"


@query(_release_sql())
def release_answers(spark: SparkSession, d: str) -> DataFrame:
    """Every census query of every block, and every one of whole counties, answered
    from the relation of queries."""
    found = schema.release_places(frame(spark, d, "per"), NAMES, "county").answers()
    return found.select("geoid", "block", "table_name", "cell", F.col("ans").cast("bigint").alias("n"))


CODED = [c for c in census.cells_of() if c.table in census.NHGIS]


@fixed("SELECT * FROM (" + values_sql([(c.table, c.cell, f"{census.NHGIS[c.table]}{str(c.cell).zfill(3)}_dp") for c in CODED], "table_name, cell, code") + ")")
def nhgis_codes(spark: SparkSession, d: str) -> DataFrame:
    cells = spark.createDataFrame([(c.table, c.cell) for c in CODED], "table_name string, cell int")
    own = spark.createDataFrame(list(census.NHGIS.items()), "t string, prefix string")
    return cells.join(F.broadcast(own), F.col("table_name") == F.col("t")).select("table_name", "cell", F.concat("prefix", F.lpad(F.col("cell").cast("string"), 3, "0"), F.lit("_dp")).alias("code"))
