"""The command line's other jobs."""

import pytest

from tallymill import jobs
from tallymill.domain import Domain
from tallymill.sources import io


def run(spark, job, *flags):
    return getattr(jobs, job)(spark, jobs.parser().parse_args([job, *flags]))


def test_prepare_then_split(spark, tmp_path):
    root = str(tmp_path)
    rows = [("CA" if k % 3 else "NY", f"t{k % 4}", ["x", "y", "z"][k % 3], k % 7, float(k)) for k in range(60)]
    spark.createDataFrame(rows, "ST string, job string, area string, kids int, pay double").write.parquet(f"{root}/raw.parquet")
    common = ("--source", f"{root}/raw.parquet", "--part_column", "ST", "--part", "CA", "--dataset", "toy", "--categorical", "job,area", "--numeric", "kids,pay", "--own", "area", "--root", root)
    assert run(spark, "prepare", *common) == ["toy"]
    domain = Domain.from_json(f"{root}/domain/toy-domain.json", spark)
    assert domain.config == {"job": 4, "area": 2, "kids": 10, "pay": 10}  # only two areas in CA
    assert io.get_data(spark, "toy", root).records == 40
    assert run(spark, "prepare", *common, "--mixed") == ["toy-mixed", "toy-cat", "toy-num"]
    assert Domain.from_json(f"{root}/domain/toy-num-domain.json", spark).config == {"kids": 1, "pay": 1}
    names = run(spark, "split", "--dataset", "toy", "--mixed", "--root", root, "--fraction", "0.75")
    assert names == [f"toy-{s}-{h}" for h in ("train", "test") for s in ("mixed", "cat", "num")]
    halves = [spark.read.parquet(f"{root}/toy-mixed-{h}.parquet") for h in ("train", "test")]
    assert [h.count() for h in halves] == [30, 10]
    every = spark.read.parquet(f"{root}/toy-mixed.parquet")
    assert sorted(map(tuple, halves[0].union(halves[1]).collect())) == sorted(map(tuple, every.collect()))
    assert spark.read.parquet(f"{root}/toy-cat-test.parquet").columns == ["job", "area"]
    assert run(spark, "split", "--dataset", "toy", "--root", root) == ["toy-train", "toy-test"]


def test_collect(spark, tmp_path):
    schema = "dataset string, marginal bigint, workload bigint, workload_seed bigint, epsilon double, T double, max_iters bigint, error_max double, error_mean double, error_mean_squared double"
    rows = [("a", 3, 32, 0, 1.0, 0.5, 10, 0.4, 0.1, 0.02), ("a", 3, 32, 0, 1.0, 0.25, 10, 0.3, 0.2, 0.03), ("b", 3, 32, 0, 1.0, 0.5, 10, 0.9, 0.1, 0.02), ("a", 2, 32, 0, None, 0.5, 10, 0.8, 0.1, 0.02)]
    for r in [*rows, rows[0]]:
        io.append_results(spark.createDataFrame([r], schema), f"{tmp_path}/r")
    best = run(spark, "collect", "--results", f"{tmp_path}/r", "--out", f"{tmp_path}/best.csv").collect()
    assert sorted((r.dataset, r.marginal, r["T"], r.rounds, r.error_max) for r in best) == [("a", 2, 0.5, 16, 0.8), ("a", 3, 0.25, 8, 0.3), ("b", 3, 0.5, 16, 0.9)]
    assert io.read_table(spark, f"{tmp_path}/best.csv").count() == 3
    mean = run(spark, "collect", "--results", f"{tmp_path}/r", "--error_metric", "mean", "--dataset", "a", "--marginal", "3").collect()
    assert [(r["T"], r.error_mean) for r in mean] == [(0.5, 0.1)]
    with pytest.raises(ValueError):
        run(spark, "collect", "--results", f"{tmp_path}/none")
