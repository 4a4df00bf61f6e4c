"""Stores of partial answers and of results, and dictionaries of many columns."""

import math

import pytest
from pyspark.sql import functions as F

from tallymill import storage
from tallymill.domain import Domain, EncodedData
from tallymill.functions import encode as en
from tallymill.operators import marginals as m
from tallymill.plans.workload import QuerySpace
from tallymill.sources import io
from tallymill.sources.answers import AnswerStore
from tallymill.streaming import upkeep

DOM = Domain(("a", "b"), (2, 3))
SPACE = QuerySpace(DOM, [("a", "b"), ("a",)])


def rows(spark, n, k=0):
    return spark.range(n).select(((F.col("id") + k) % 2).cast("int").alias("a"), ((F.col("id") * 3 + k) % 4).cast("int").alias("b"))


def test_a_new_file_is_the_only_one_read(spark, tmp_path, monkeypatch):
    table, read = f"{tmp_path}/t", []
    rows(spark, 40).coalesce(1).write.parquet(table)
    rows(spark, 30, 1).coalesce(1).write.mode("append").parquet(table)
    store = AnswerStore(spark, f"{tmp_path}/s", SPACE, lambda df: EncodedData(df, DOM))
    plain = store._read
    monkeypatch.setattr(store, "_read", lambda names: read.append(len(names)) or plain(names))

    def same():
        for density in (None, "valid", "all"):
            want = m.answers(EncodedData(spark.read.parquet(table), DOM), SPACE, density).orderBy("query_id").collect()
            got = store.answers(table, density).orderBy("query_id").collect()
            assert [r.ans for r in got] == pytest.approx([r.ans for r in want])

    same()
    assert read == [2]
    rows(spark, 7, 2).coalesce(1).write.mode("append").parquet(table)
    same()
    assert read == [2, 1]
    store.compact()
    same()
    assert read == [2, 1] and len(store.batches()) == 3 and len(store.batches()[0].files) == 3
    rows(spark, 5).coalesce(1).write.mode("overwrite").parquet(table)  # all files are others now
    same()
    assert read == [2, 1, 1]
    assert io.cached_answers(spark, table, SPACE, f"{tmp_path}/s").orderBy("query_id").collect() == store.answers(table).orderBy("query_id").collect()
    other = AnswerStore(spark, f"{tmp_path}/s", QuerySpace(DOM, [("b",)]), lambda df: EncodedData(df, DOM))
    assert other.batches() == []


def test_overlapping_batches_and_no_rows(spark, tmp_path):
    table = f"{tmp_path}/t"
    rows(spark, 10).coalesce(1).write.parquet(table)
    store = AnswerStore(spark, f"{tmp_path}/s", SPACE, lambda df: EncodedData(df, DOM))
    assert all(r.ans == 0 for r in store.answers().collect())
    files = storage.files(spark, table)
    for name in ("one", "two"):  # two writers that counted the same file
        store._add(store._sums(spark.read.parquet(table)), files, name)
    assert store.counts(table).where("query_id = -1").first().ans == 10


def test_a_stream_feeds_the_store(spark, tmp_path):
    for i in range(3):
        rows(spark, 5 + i, i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    store = AnswerStore(spark, f"{tmp_path}/s", SPACE, lambda df: EncodedData(df, DOM))
    source = spark.readStream.schema("a int, b int").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    upkeep.into_store(source, store, "q", f"{tmp_path}/c").awaitTermination()
    want = m.sums(EncodedData(spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"), DOM), SPACE)
    own = lambda df: {r.query_id: r.ans for r in df.collect() if r.query_id >= 0}
    assert own(store.counts()) == own(want)
    store.compact()
    assert own(store.counts()) == own(want)
    before = own(store.counts())
    store.add_rows(rows(spark, 4), "late")
    store.add_rows(rows(spark, 4), "late")  # written again
    assert sum(own(store.counts()).values()) == sum(before.values()) + sum(own(m.sums(EncodedData(rows(spark, 4), DOM), SPACE)).values())


def test_a_run_stored_twice_is_one(spark, tmp_path):
    path, schema = f"{tmp_path}/r", "d string, alpha double, error_max double"
    for error in (0.5, 0.4):
        io.append_results(spark.createDataFrame([("a", None, error)], schema), path)
    io.append_results(spark.createDataFrame([("b", 0.1, 0.9)], schema), path)
    found = io.stored_results(spark, path)
    assert sorted(map(tuple, found.collect()), key=str) == [("a", None, 0.4), ("b", 0.1, 0.9)]
    assert io.already_run(found, {"d": "a", "alpha": None}) and not io.already_run(found, {"d": "c"})
    # two writers at once: both folders' files are there, the later one counts
    late = spark.createDataFrame([("a", None, 0.3)], schema)
    run = [r.run_key for r in spark.read.parquet(path).where("d = 'a'").collect()][0]
    late.withColumn("run_attempt", F.lit("9" * 20)).write.mode("append").parquet(f"{path}/run_key={run}")
    found = io.stored_results(spark, path)
    assert [r.error_max for r in found.where("d = 'a'").collect()] == [0.3]


def test_two_million_values_through_the_encoder(spark):
    n = 2_000_000
    df = spark.range(n).select((n - 1 - F.col("id")).alias("big"), F.concat(F.lit("k"), F.col("id") % 7).alias("s"), (F.col("id") % 3 == 0).alias("flag"), (F.col("id") % 10).cast("double").alias("x"))
    coder = en.Encoder(en.Config(categorical=["big", "s", "flag"], bins={"x": [0, 5, math.inf]})).fit(df)
    assert coder.domain.config == {"big": n, "s": 7, "flag": 2, "x": 2} and set(coder.tables) == {"big"}
    coded = coder.transform(df)
    assert coded.columns == ["big", "s", "flag", "x"]
    row = coded.agg(F.count_distinct("big"), F.min("big"), F.max("big"), F.sum("flag"), F.sum("x")).first()
    assert tuple(row) == (n, 0, n - 1, -(-n // 3), n // 2)
    few = df.where("id < 0 OR big < 50")
    assert sorted(map(tuple, coder.inverse_transform(coder.transform(few)).select("big", "s", "flag").collect())) == sorted(map(tuple, few.select("big", "s", "flag").collect()))


@pytest.mark.parametrize("most", [100, 2])
def test_small_and_large_columns_are_coded_alike(spark, most):
    df = spark.createDataFrame([("b", 10, 1.5), ("a", 9, None), (None, 100, -0.5), ("é", 9, 1.5), ("Z", None, 2.0)], "s string, n int, d double")
    coder = en.Encoder(en.Config(categorical=["s", "n", "d"]), most=most).fit(df)
    got = sorted(map(tuple, coder.transform(df).collect()))
    assert got == sorted([(2, 1, 1), (1, 0, -1), (-1, 2, 0), (3, 0, 1), (0, -1, 2)])
    with pytest.raises(Exception, match="s: unknown value q"):
        coder.transform(spark.createDataFrame([("q", 9, 1.5)], "s string, n int, d double")).collect()
    other = en.Encoder(en.Config(categorical=["s"]), other=True, most=most).fit(df)
    values = sorted(["b", "a", "é", "Z", en.OTHER])
    assert other.domain.config == {"s": 5}
    strange = spark.createDataFrame([("q",), ("a",), (None,)], "s string")
    assert [r.s for r in other.transform(strange).orderBy("s").collect()] == sorted([values.index(en.OTHER), values.index("a"), -1])
    empty = en.Encoder(en.Config(categorical=["s", "n"]), most=most).fit(df.limit(0))
    assert empty.domain.config == {"s": 0, "n": 0} and empty.transform(df.limit(0)).count() == 0
