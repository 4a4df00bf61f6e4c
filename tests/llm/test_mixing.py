import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymill.llm import mixing

from . import data


def test_counts_follow_the_rates_and_repeat(spark):
    pairs = [(i, f"text {i}") for i in range(6000)]
    df = data.frame(spark, pairs)
    weights = {"src0": 0.5, "src1": 0.5, "src2": 0.0}
    got = mixing.mix(df, weights, total=9000)
    rows = got.select("doc_id", "source", "copy").collect()
    by = Counter(r.source for r in rows)
    assert by["src2"] == 0
    assert by["src0"] == pytest.approx(4500, rel=0.06) and by["src1"] == pytest.approx(4500, rel=0.06)
    assert Counter((r.doc_id, r.copy) for r in rows) == Counter((r.doc_id, r.copy) for r in mixing.mix(df.repartition(9), weights, total=9000).collect())
    copies = Counter(r.doc_id for r in rows if r.source == "src1")
    shares = Counter(copies.values())
    assert shares[1] / 2000 == pytest.approx(2.25 * 2.718281828 ** -2.25, abs=0.04)  # Poisson of mean 2.25


def test_clashing_columns_stay(spark):
    df = data.frame(spark, data.rows()).withColumn("copy", F.lit("mine")).withColumn("Shuffle_Key", F.lit(3))
    out = mixing.mix(df)
    assert out.columns == [*df.columns, "copy_", "shuffle_key_"]
    assert {(r[df.columns.index("copy")], r[df.columns.index("Shuffle_Key")]) for r in out.collect()} == {("mine", 3)}


def test_a_rate_of_many_parts_is_poisson_by_brute_force(spark):
    got = mixing.mix(data.frame(spark, [(i * 3, "t") for i in range(400)]), {"src0": 1.0}, total=400 * 100)
    times = Counter(r.doc_id for r in got.select("doc_id").collect())
    cdf = [round(sum(math.exp(-25 + j * math.log(25) - math.lgamma(j + 1)) for j in range(k + 1)), 12) for k in range(117)]
    draw = lambda i, j: int(hashlib.md5(f"20:count:{j}:{i}".encode()).hexdigest()[:13], 16) / 2**52
    want = {i * 3: sum(sum(c <= draw(i * 3, j) for c in cdf) for j in range(1, 5)) for i in range(400)}
    assert times == Counter(want)
    mean = sum(want.values()) / 400
    assert sum((x - mean) ** 2 for x in want.values()) / 399 == pytest.approx(100, rel=0.25)


def test_large_rates(spark):
    got = mixing.mix(data.frame(spark, [(i, "t") for i in range(0, 30, 3)]), {"src0": 1.0}, total=20000).count()
    assert got == pytest.approx(20000, rel=0.03)


def test_awkward_rows(spark):
    pairs = data.rows()
    out = mixing.mix(data.frame(spark, pairs))
    assert set(out.columns) == {*data.frame(spark, []).columns, "copy", "shuffle_key"}
    by = Counter((r.doc_id, r.text) for r in out.collect())
    assert set(by) <= {(i, t) for i, t in pairs}
    assert mixing.mix(data.frame(spark, pairs), {None: 1.0}, total=50).select("source").distinct().collect()[0][0] is None
    assert mixing.mix(data.empty(spark)).count() == 0
    assert mixing.mix(data.frame(spark, pairs), {}).count() == 0


def test_many_sources_are_joined_alike(spark, monkeypatch):
    df = data.frame(spark, data.rows())
    one = Counter(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert Counter(map(tuple, mixing.mix(df).collect())) == one
