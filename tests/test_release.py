import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.domain import Domain, EncodedData
from tallymill.functions import noise
from tallymill.operators import evaluate, fit, marginals as m, models, privacy, setquery as sq, support as sup
from tallymill.plans.workload import QuerySpace, all_workloads
from tallymill.sources import io
from tallymill.streaming import upkeep

DOM = Domain(("a", "b"), (2, 3))
SPACE = QuerySpace(DOM, [("a", "b"), ("a",), ("b",)])


def data(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2, n)
    return EncodedData(spark.createDataFrame([(int(x), int(min(2, x + y))) for x, y in zip(a, rng.integers(0, 2, n))], "a int, b int"), DOM)


def test_budget():
    rho = privacy.cdp_rho(1.0, 1e-9)
    assert privacy.cdp_delta(rho, 1.0) == pytest.approx(1e-9, rel=1e-6)
    assert privacy.cdp_eps(rho, 1e-9) == pytest.approx(1.0, rel=1e-6)
    assert privacy.per_round(1.0, 1e-9, 10, 0.5)[0] == pytest.approx(math.sqrt(4 * rho / 10))
    assert privacy.per_round(1.0, 1e-9, 10)[0] == pytest.approx(math.sqrt(2 * rho / 10))
    assert privacy.cdp_rho(1, 1) == 0 and privacy.cdp_eps(0, 0.1) == 0 and privacy.cdp_delta(0, 1) == 0
    assert privacy.resolve_rounds(0.5, 10) == 5 and privacy.resolve_rounds(1.0, 10) == 10
    with pytest.raises(ValueError):
        privacy.resolve_rounds(11, 10)
    assert privacy.default_delta(100) == 1e-4


def test_noise_has_its_distribution(spark):
    row = spark.range(20000).select(noise.normal(1, F.col("id")).alias("n"), noise.uniform(1, F.col("id")).alias("u"))
    r = row.agg(F.avg("n"), F.stddev("n"), F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(r[0]) < 0.03 and r[1] == pytest.approx(1, abs=0.03) and r[2] == pytest.approx(0.5, abs=0.01) and 0 < r[3] and r[4] < 1


def test_exponential_mechanism(spark):
    scores = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, -math.inf), (3, None)], "query_id bigint, score double")
    n = 4000
    many = spark.range(n).crossJoin(scores.where("score >= 0"))
    noisy = F.col("score") * 1.0 + noise.gumbel("t", F.col("id"), F.col("query_id"))
    picks = Counter(r[1] for r in many.groupBy("id").agg(F.max_by("query_id", noisy)).collect())
    assert picks[1] / n == pytest.approx(math.e / (1 + math.e), abs=0.03)
    seen = {privacy.exponential(scores, 0.0, 1.0, s).first()["query_id"] for s in range(12)}
    assert seen == {0, 1}
    assert privacy.exponential(scores, 1000.0, 1.0, 1).first()["query_id"] == 1
    assert privacy.exponential(scores.where("score < 0"), 1.0, 1.0, 1).count() == 0


def test_set_queries(spark):
    d = data(spark)
    queries = [{"a": [0, 1], "b": [2]}, {"b": [0]}, {}, {"a": []}, {"a": [1], "b": [1, 2]}]
    one = {r.qid: r.ans for r in sq.set_answers(d, queries, strategy="inline").collect()}
    two = {r.qid: r.ans for r in sq.set_answers(d, queries, strategy="tables").collect()}
    by = {(r.a, r.qid): r.ans for r in sq.set_answers(d, queries, density=False, by=["a"]).collect()}
    rows = d.df.collect()
    for i, q in enumerate(queries):
        want = sum(all(r[a] in v for a, v in q.items() if v) for r in rows) / len(rows)
        assert one[i] == pytest.approx(want) and two[i] == pytest.approx(want)
        for a in (0, 1):
            assert by[a, i] == sum(r.a == a and all(r[c] in v for c, v in q.items() if v) for r in rows)
    assert [r.ans for r in sq.set_answers(EncodedData(d.df.limit(0), DOM), queries, strategy="tables").collect()] == [0.0] * 5
    assert sq.distinct([{"a": [1, 0]}, {"a": [0, 1, 1], "b": []}, {}]) == [{"a": (0, 1)}, {}]
    assert sq.attribute_sets([{"a": [1], "b": [0]}, {"b": [1]}, {"a": []}]) == [(), ("b",), ("a", "b")]


def test_supports(spark):
    full = sup.full_support(spark, DOM)
    assert [(r.a, r.b) for r in full.orderBy("support_id").collect()] == [(x, y) for x in range(2) for y in range(3)]
    with pytest.raises(ValueError):
        sup.full_support(spark, Domain(("x",), (10,)), most=5)
    d = data(spark)
    distr = sup.support_distribution(full, d)
    got = {r.query_id: r.ans for r in sup.support_answers(distr, SPACE).collect()}
    want = {r.query_id: r.ans for r in m.answers(d, SPACE).collect()}
    assert got == pytest.approx(want)
    public = sup.public_support(d)
    assert public.agg(F.sum("w")).first()[0] == pytest.approx(1)
    drawn = sup.sample_support(distr.select("support_id", "w"), 5000, 2)
    assert drawn.count() == 5000
    by = Counter(r.support_id for r in drawn.collect())
    for r in distr.collect():
        assert by[r.support_id] / 5000 == pytest.approx(r.w, abs=0.03)


def test_one_step_of_each_fit(spark):
    dom = Domain(("x",), (2,))
    space = QuerySpace(dom, [("x",)])
    true = spark.createDataFrame([(0, 0.1), (1, 0.9)], "query_id bigint, ans double")
    hist = fit.Histogram(sup.uniform(sup.full_support(spark, dom), 2), space)
    hist.update(1, fit.projection_step(0.9, 0.5))
    assert hist.current([1])[0] == pytest.approx(0.9)
    mw = fit.multiplicative_weights(fit.Histogram(hist.support, space), true, 1, fit.Chooser())
    factor = math.exp(-0.2)  # the first of two equal errors is query 0
    assert mw.current([0])[0] == pytest.approx(factor / (factor + 1))


def test_private_fits_approach_the_answers(spark):
    d = data(spark, 2000)
    true = fit.stored(m.answers(d, SPACE))
    start = sup.uniform(sup.full_support(spark, DOM), 6)
    before = evaluate.errors(true, fit.Histogram(start, SPACE).answers()).first().error_max
    for run in (
        lambda: fit.multiplicative_weights(fit.Histogram(start, SPACE), true, 5, fit.Chooser(n=2000, eps0=1.0), recycle=True),
        lambda: fit.entropy_projection(fit.Histogram(start, SPACE), true, 3, fit.Chooser(n=2000, eps0=1.0, single=False), iterations=4),
    ):
        hist = run()
        assert evaluate.errors(true, hist.answers()).first().error_max < 0.8 * before
        assert hist.weights().agg(F.sum("w")).first()[0] == pytest.approx(1)


@pytest.mark.parametrize("index", [True, False])
def test_weights_by_definition(spark, index, tmp_path):
    hist = fit.Histogram(sup.uniform(sup.full_support(spark, DOM), 6), SPACE, index=index)
    steps = [(0, 0.3), (7, -0.2), (9, 0.5), (3, 0.1), (0, 0.2)]
    kept = []
    for k, (q, eta) in enumerate(steps):
        hist.update(q, eta)
        if k % 2:
            hist.snapshot()
        kept.append(dict(hist.etas))
    cells = {(a, b): {SPACE.lookup(v) for v in ({"a": a, "b": b}, {"a": a}, {"b": b})} for a in range(2) for b in range(3)}

    def weights(etas):
        w = {ab: math.exp(sum(e for q, e in etas.items() if q in c)) for ab, c in cells.items()}
        return {ab: x / sum(w.values()) for ab, x in w.items()}

    got = {(r.a, r.b): r.w for r in hist.weights().collect()}
    assert got == pytest.approx(weights(kept[-1]))
    mean = {(r.a, r.b): r.w for r in hist.weights(average=True).collect()}
    assert mean == pytest.approx({ab: (weights(kept[1])[ab] + weights(kept[3])[ab]) / 2 for ab in cells})
    want = [sum(w for ab, w in got.items() if q in cells[ab]) for q in range(SPACE.n_queries)]
    assert hist.current(list(range(SPACE.n_queries))) == pytest.approx(want)
    assert [r.ans for r in hist.answers().orderBy("query_id").collect()] == pytest.approx(want)
    averaged = [sum(w for ab, w in mean.items() if q in cells[ab]) for q in range(SPACE.n_queries)]
    assert [r.ans for r in hist.answers(average=True).orderBy("query_id").collect()] == pytest.approx(averaged)
    hist.save(f"{tmp_path}/h")
    assert {(r.a, r.b): r.w for r in fit.Histogram.load(spark, f"{tmp_path}/h", SPACE).weights().collect()} == pytest.approx(got)


def test_sums_dense_and_sparse(spark):
    d = data(spark)
    bad = EncodedData(d.df.unionByName(spark.createDataFrame([(-1, 0), (None, 2), (1, 7)], "a int, b int")), DOM)
    want = {r.query_id: r.ans for r in m.sums(bad, SPACE, "inline").collect()}
    for dense in (m.DENSE_CELLS, 5, 1):
        assert {r.query_id: r.ans for r in m.sums(bad, SPACE, "arrow", dense).collect()} == want


def test_soft_set_answers_and_their_gradient():
    rng = np.random.default_rng(3)
    space = sq.SetSpace(DOM, [{"a": [0], "b": [1, 2]}, {"b": [0]}, {}, {"a": [0, 1]}])
    model = models.FixedModel(DOM, 5, seed=4)
    p = model.probabilities()
    want = [(p[:, 0] * (p[:, 3] + p[:, 4])).mean(), p[:, 2].mean(), 1.0, 1.0]
    assert sq.soft_set_answers(p, space) == pytest.approx(np.array(want))
    up = rng.random(4)
    grad = sq.soft_set_gradient(p, space, up)
    for i in range(5):
        for j in range(5):
            q = p.copy()
            q[i, j] += 1e-6
            assert grad[i, j] == pytest.approx((up @ (sq.soft_set_answers(q, space) - sq.soft_set_answers(p, space))) / 1e-6, abs=1e-5)
    log = models.fit_exact(model, space, np.array([0.5, 0.3, 1.0, 1.0]), 200, lr=0.1)
    assert min(log) < 0.01


def test_rows_of_sums(spark):
    dom = Domain(("a", "b", "any"), (2, 3, 2))
    p = np.array([[0.5, 0.5, 0.2, 0.3, 0.5, 0.0, 1.0]])
    rows = models.sample_rows(spark, p, dom, 200, seed=4, sums={"any": [("a", 1), ("b", 2)]}).collect()
    assert all(r["any"] == int(r.a == 1 or r.b == 2) for r in rows) and {r["any"] for r in rows} == {0, 1}
    again = models.sample_rows(spark.newSession(), p, dom, 200, seed=4)
    assert sorted((r.id, r.a, r.b) for r in again.repartition(7).collect()) == sorted((r.id, r.a, r.b) for r in rows)
    assert models.summed(p, dom, {"any": [("a", 1), ("b", 2)]})[0, 5:].tolist() == [0.0, 1.0]


@pytest.mark.parametrize("network", [False, True])
def test_gradients(network):
    model = models.ResidualModel(DOM, 6, 4, (5, 3), seed=2) if network else models.FixedModel(DOM, 6, seed=2)
    goal = np.random.default_rng(1).random(SPACE.n_queries)
    loss = lambda: float(((goal - m.soft_answers(model.probabilities(), SPACE)) ** 2).sum())
    p = model.probabilities()
    grads = model.backward(p, models.answers_gradient(p, SPACE, -2 * (goal - m.soft_answers(p, SPACE))))
    for k, g in grads.items():
        flat = model.params[k].reshape(-1)
        for i in range(0, len(flat), max(1, len(flat) // 5)):
            held = flat[i]
            flat[i] = held + 1e-5
            up = loss()
            flat[i] = held - 1e-5
            down = loss()
            flat[i] = held
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


@pytest.mark.parametrize("style", ["gem", "rap", "iter"])
def test_product_fits(spark, style, tmp_path):
    d = data(spark, 2000)
    true = np.array([r.ans for r in m.answers(d, SPACE).orderBy("query_id").collect()])
    model = models.FixedModel(DOM, 50, seed=3)
    before = np.abs(true - m.soft_answers(model.probabilities(), SPACE)).max()
    log = models.fit_private(model, SPACE, true, 2000, 1.0, models.FitConfig(style=style, rounds=3, lr=0.1, max_iters=80))
    assert len(log) == 3 and log[-1]["error_max"] < before
    model.save(f"{tmp_path}/m.npz")
    again = models.FixedModel(DOM, 50)
    again.load(f"{tmp_path}/m.npz")
    assert np.array_equal(again.probabilities(), model.probabilities())
    model.save(f"file://{tmp_path}/far.npz", spark)
    again.params = {}
    again.load(f"file://{tmp_path}/far.npz", spark)
    assert np.array_equal(again.probabilities(), model.probabilities())
    assert models.fit_exact(model, SPACE, true, 60, lr=0.1)[-1] < 0.05
    rows = models.sample_rows(spark, model.probabilities(), DOM, 4000, seed=1)
    drawn = np.array([r.ans for r in m.answers(EncodedData(rows, DOM), SPACE).orderBy("query_id").collect()])
    assert np.abs(drawn - true).max() < 0.08
    assert models.sample_rows(spark, model.probabilities(), DOM, 10, how="max").count() == 10


def test_results_and_query_sets(spark, tmp_path):
    runs = spark.createDataFrame([("a", 1, None, 0.5, 2.0, 3), ("a", 1, None, 0.2, 2.0, 3), ("b", 1, 0.1, 0.9, 1.0, 3)], "d string, seed int, alpha double, error_max double, T double, workload int")
    best = {r.d: (r.error_max, r.rounds) for r in evaluate.best_runs(runs, ["d", "alpha"]).collect()}
    assert best == {"a": (0.2, 6), "b": (0.9, 3)}
    with pytest.raises(ValueError):
        io.already_run(runs, {"d": "a"})
    io.save_queries([{"a": (1, 2)}], f"{tmp_path}/q.json")
    assert io.load_queries(f"{tmp_path}/q.json") == [{"a": [1, 2]}]
    assert len(io.default_columns("acs_PA")) == 67 and len(io.default_columns("adult-reduced")) == 7 and io.default_columns("x") is None


def test_reading_datasets(spark, tmp_path):
    (tmp_path / "domain").mkdir()
    DOM.to_json(f"{tmp_path}/domain/toy-domain.json")
    (tmp_path / "toy.csv").write_text("b,a,extra\n2,1,300\n0,0,5\n")
    got = io.get_data(spark, "toy", str(tmp_path))
    assert got.df.columns == ["a", "b"] and [tuple(r) for r in got.df.collect()] == [(1, 2), (0, 0)]
    io.split_by(got.df, "a", f"{tmp_path}/by")
    plan = spark.read.parquet(f"{tmp_path}/by").where("a = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(a" in plan


def test_streamed_counts_equal_batch(spark, tmp_path):
    d = data(spark)
    d.df.repartition(3).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("a int, b int").parquet(f"{tmp_path}/in")
    upkeep.running_counts(rows, SPACE).writeStream.format("memory").queryName("kept").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = {r.query_id: float(r.n) for r in spark.table("kept").collect()}
    assert got == {r.query_id: r.ans for r in m.sums(d, SPACE).collect()}


def test_windowed_counts_drop_late_rows(spark, tmp_path):
    schema = "t timestamp, a int, b int"
    for i, batch in enumerate((["2024-01-01 00:01", "2024-01-01 05:00"], ["2024-01-01 05:01"], ["2024-01-01 00:02", "2024-01-01 06:00"], ["2024-01-01 07:00"])):
        spark.createDataFrame([(t, 0, 1) for t in batch], "t string, a int, b int").selectExpr("CAST(t AS TIMESTAMP) t", "a", "b").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    counts = upkeep.windowed_counts(rows, QuerySpace(DOM, [("a",)]), "t", "10 minutes", "30 minutes")
    counts.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    got = {(str(r.window.start)[11:16], r.n) for r in spark.table("windows").collect()}
    assert got == {("00:00", 1), ("05:00", 2), ("06:00", 1)}  # 00:02 came after its window had closed


def test_workloads_of_many_sizes(spark):
    d = data(spark)
    space = QuerySpace(DOM, all_workloads(DOM, 1) * 30)
    one = {r.query_id: r.ans for r in m.answers(d, space).collect()}
    assert one == pytest.approx({r.query_id: r.ans for r in m.answers(d, space, strategy="inline").collect()})
