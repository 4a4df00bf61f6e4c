import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymill.domain import Domain
from tallymill.functions import census, encode as en, geo


def codes(spark, values, edges, repeat="point"):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    return [r.c for r in df.select(en.bin_code(F.col("x"), edges, repeat).alias("c")).collect()]


def test_repeated_edges(spark):
    edges = [0, 0, 1000, math.inf]
    assert codes(spark, [0, 5, 2000, -1], edges) == [0, 1, 2, None]
    assert codes(spark, [0, 5, 2000], edges, "overwrite") == [1, 1, 2]
    assert en.bin_labels(edges) == ["0", "(0, 1000)", "[1000, inf)"]


def test_edges_are_fitted_and_checked(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (9.0,)], "x double")
    assert en.fit_edges(df, {"x": 4})["x"] == [-math.inf, 3, 5, 7, math.inf]
    assert len(en.fit_edges(df, {"x": None})["x"]) == 11
    with pytest.raises(ValueError):
        en.fit_edges(df, {"x": [0, 5]})


def test_labels_sort_by_their_own_order(spark):
    df = spark.createDataFrame([(10,), (9,), (100,), (None,)], "x int")
    values = en.dictionary(df, "x")
    assert values == [9, 10, 100]
    assert [r.c for r in en.encode(df, "x", values, to="c").collect()] == [1, 0, 2, -1]
    assert [r.x for r in en.decode(en.encode(df, "x", values), "x", values).collect()] == [10, 9, 100, None]


def test_unknown_values(spark):
    df = spark.createDataFrame([("a",), ("c",)], "x string")
    values = en.dictionary(df, "x", declared=["a", "b"], other=True)
    assert values == ["_OTHER", "a", "b"]
    assert [r.x for r in en.encode(df, "x", values, other=True).collect()] == [1, 0]
    with pytest.raises(Exception, match="unknown value c"):
        en.encode(df, "x", ["a", "b"]).collect()


def test_encoder_over_frames(spark):
    a = spark.createDataFrame([("x", 1.0, 1), ("y", 7.0, 2)], "s string, n double, unused int")
    b = spark.createDataFrame([("z", 20.0)], "s string, n double")
    coder = en.Encoder(en.Config(categorical=["s"], bins={"n": [0, 5, 10, math.inf]})).fit([a, b.withColumn("unused", F.lit(1))])
    assert coder.domain == Domain(("s", "n"), (3, 3))
    out = coder.transform(a)
    assert [tuple(r) for r in out.collect()] == [(0, 0), (1, 1)]
    assert [tuple(r) for r in coder.inverse_transform(out).collect()] == [("x", "[0, 5)"), ("y", "[5, 10)")]
    assert en.Encoder(en.known_config("adult")).attrs[0] == "workclass"
    assert len(en.known_config("census").categorical) == 35 and len(en.known_config("census").bins) == 6


def test_onehot_ignores_codes_outside(spark):
    dom = Domain(("a", "b"), (2, 3))
    df = spark.createDataFrame([(0, 2), (-1, 1), (1, 3), (-1, -1)], "a int, b int")
    assert [r.p for r in df.select(en.onehot_positions(dom).alias("p")).collect()] == [[0, 4], [3], [1], []]
    back = df.select(en.onehot_positions(dom).alias("p")).select(*en.onehot_decode(F.col("p"), dom)).collect()
    assert [tuple(r) for r in back] == [(0, 2), (-1, 1), (1, -1), (-1, -1)]
    bad = {r.attr: r.n_bad for r in en.out_of_domain(df, dom).collect()}
    assert bad == {"a": 0, "b": 1}
    assert en.constant_free(Domain(("a", "k"), (2, 1))).attrs == ("a",)
    assert en.split_con_cat(["x", "y", "z"], ["y"]) == (["x", "z"], ["y"])


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_split_is_exact(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    train, test = en.train_test_split(df, "k", 0.7, 1)
    assert train.count() == round(0.7 * n) and test.count() == n - round(0.7 * n)
    assert train.join(test, "k").count() == 0


def test_a_split_loses_no_row(spark):
    rows = [(None if i < 10 else i % 2, "same" if i < 40 else f"r{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "k int, v string")
    for fraction in (0.0, 0.05, 0.5, 0.7, 1.0):
        train, test = en.train_test_split(df, "k", fraction, 1)
        a, b = train.collect(), test.collect()
        assert len(a) == round(100 * fraction) and len(a) + len(b) == 100
        assert Counter(map(tuple, a + b)) == Counter(rows)
    again = en.train_test_split(df.repartition(5), "k", 0.7, 1)[0].collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, en.train_test_split(df, "k", 0.7, 1)[0].collect()))
    train, test = en.train_test_split(spark.createDataFrame([(1, "x")] * 9, "k int, v string"), "k", 0.5)
    assert (train.count(), test.count()) == (4, 5)
    assert [x.count() for x in en.train_test_split(df.limit(0), "k", 0.5)] == [0, 0]


def test_labels_of_large_and_fine_edges():
    assert en.bin_labels([1000000, 1000001, 1234567]) == ["[1000000, 1000001)", "[1000001, 1234567)"]
    assert en.bin_labels([0, 0, 0.5, en.INF]) == ["0", "(0, 0.5)", "[0.5, inf)"]
    edges = [i + 0.1 * k for i in (10**6, 10**9) for k in range(5)]
    assert len(set(en.bin_labels(edges))) == len(edges) - 1


def test_many_values_are_numbered_as_a_table(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "c", None, "a", "b", "d"]], "v string")
    with pytest.raises(ValueError):
        en.dictionary(df, "v", most=3)
    with pytest.raises(ValueError):
        en.union_domain(df, ["v"], [], most=3)
    table = en.numbered(df, "v")
    assert {r.value: r.code for r in table.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    coded = en.encode_numbered(df.union(spark.createDataFrame([("zz",)], "v string")), "v", table, to="c")
    assert Counter((r.v, r.c) for r in coded.collect()) == Counter([("a", 0), ("b", 1), ("b", 1), ("c", 2), ("d", 3), (None, -1), ("zz", -1)])
    assert en.numbered(df.limit(0), "v").count() == 0


def test_a_part_is_prepared_over_the_whole(spark):
    every = spark.createDataFrame([("x", 1, 0.0, "k"), ("y", 2, 10.0, "k"), ("z", 3, 5.0, "k"), ("y", 9, 2.5, "k")], "c string, own int, n double, one string")
    part = every.where("n < 6")
    p = en.prepare_part(every, part, ["c", "own", "one"], ["n"], 4, own=["own"])
    assert p.domain.config == {"c": 3, "own": 3, "n": 4}
    assert sorted(map(tuple, p.df.collect())) == [(0, 0, 0), (1, 2, 1), (2, 1, 2)]
    mixed = en.prepare_part(every, part, ["c", "own", "one"], ["n"], 4, own=["own"], mixed=True)
    assert mixed.domain.config == {"c": 3, "own": 3, "n": 1} and sorted(r.n for r in mixed.df.collect()) == [0.0, 2.5, 5.0]
    assert mixed.only("cat").df.columns == ["c", "own"] and mixed.only("num").domain.config == {"n": 1}
    assert en.domain_rows(spark, p.domain).count() == 4


def test_geo_keys(spark):
    df = spark.createDataFrame([(42, 3, 140100, 1), (1, 2, 3, None), (7, None, None, None)], "state int, county int, tract int, block int")
    parts = {p: F.col(p) for p in geo.PARTS}
    assert [r.g for r in df.select(geo.geoid(parts).alias("g")).collect()] == ["420031401000001", "01002000003", "07"]
    assert df.select(geo.gisjoin(parts).alias("g")).first().g == "G42000301401000001"
    again = df.select(geo.geoid(parts).alias("g")).select(*geo.parse_geoid(F.col("g"))).collect()
    assert again == df.collect()
    joined = df.select(geo.gisjoin(parts).alias("g")).select(*geo.parse_gisjoin(F.col("g"))).collect()
    assert joined == df.collect()
    assert df.where(geo.contains({"state": 42, "county": None})).count() == 1
    assert geo.roll_up(df, "county").select("tract").distinct().collect()[0][0] is None


def test_nearest_size_breaks_ties_by_key(spark):
    sizes = spark.createDataFrame([("b", 4), ("a", 6), ("c", 9)], "key string, n bigint")
    got = geo.nearest_size(sizes, spark.createDataFrame([(5,), (100,)], "target bigint"))
    assert {r.target: r.key for r in got.collect()} == {5: "a", 100: "c"}


def test_races():
    assert len(census.SETS) == 63 and census.race_name(63).count(";") == 5
    assert [len(s) for s in census.SETS] == sorted(len(s) for s in census.SETS)
    assert all(census.parse_race(census.race_name(i)) == i for i in range(1, 64))
    assert census.race_id([0]) == 1 and census.race_id([0, 1]) == 7
    assert census.races_where(lambda s: len(s) == 6) == [63]


def test_census_tables():
    cells = census.census_cells()
    assert len(census.cells_of()) == 421 and len(census.cells_of(tract=True)) == 630 and len(cells) == 3556
    keys = [(c.table, c.cell) for c in cells]
    assert len(set(keys)) == len(keys)
    assert not any(c.cell > 26 for c in cells if c.table == "P12")
    full = {(c.table, c.cell): c for c in census.census_cells(complete=True)}
    assert full["P12", 49].sexes == ("Female",) and full["P12", 49].ages == tuple(range(85, 116))
    assert ("P11", 48) in full and ("P11", 48) not in set(keys)
    assert full["P9", 73].races == (63,) == full["P9", 72].races
    assert full["P9", 13].races == (census.parse_race("White; Black or African American"),)
    assert census.nhgis_code("P12A", 7) == "H9A007_dp"
    assert len(census.by_block(census.cells_of(tract=True), [1, 2])) == 2 * 421 + 208
    assert full["PCT12N", 209].allowed()["CENHISP"] == ("Not HLO",)
