"""Answers kept by changes, and projections on the quotient support."""

import math

import numpy as np
import pytest

from tallymill.domain import Domain, EncodedData
from tallymill.operators import fit, marginals as m, support as sup
from tallymill.plans.workload import QuerySpace, all_workloads

DOM = Domain(("a", "b", "c"), (3, 4, 5))
SPACE = QuerySpace(DOM, all_workloads(DOM, 2))


def _start(spark):
    rng = np.random.default_rng(2)
    rows = [(int(x) % 3, int(x) % 4, int(x * x) % 5) for x in rng.integers(0, 60, 500)]
    data = EncodedData(spark.createDataFrame(rows, "a int, b int, c int"), DOM)
    return fit.stored(m.answers(data, SPACE)), fit.Histogram(sup.uniform(sup.full_support(spark, DOM), DOM.size()), SPACE)


@pytest.mark.parametrize("refresh", [3, 100])
def test_answers_after_moves(spark, refresh, monkeypatch):
    monkeypatch.setattr(fit, "REFRESH", refresh)
    true, hist = _start(spark)
    now = fit.Standing(hist, true)
    for moves in ({3: 0.4}, {3: -0.1, 20: 0.7}, {40: -2.0}, {5: 1.0, 6: 0.2, 33: 0.5}):
        now.move(moves)
        kept = {r.query_id: (r.true, r.found) for r in now.scored().collect()}
        whole = {r.query_id: r.ans for r in hist.answers().collect()}
        assert {q: f for q, (_, f) in kept.items()} == pytest.approx(whole)
        assert {q: t for q, (t, _) in kept.items()} == pytest.approx({r.query_id: r.ans for r in true.collect()})
    now.close()


@pytest.mark.parametrize("single", [True, False])
def test_quotient_and_passes_project_alike(spark, single):
    true, _ = _start(spark)
    found = []
    for most in (fit.CLASSES, 0):
        hist = _start(spark)[1]
        fit.entropy_projection(hist, true, 3, fit.Chooser(n=500, eps0=0.5, seed=4, single=single), iterations=6, most=most)
        found.append(hist.etas)
    assert found[0] == pytest.approx(found[1])


def test_classes_hold_the_whole_weight(spark):
    _, hist = _start(spark)
    hist.update(2, 0.5)
    queries = np.array([1, 2, 14, 40])
    rows = hist.classes(queries, [0, 1, 2]).collect()
    total = hist.sums().where("query_id = -1").first().s
    assert math.isclose(sum(r.w for r in rows), total)
    assert len({bytes(r.hits) for r in rows}) == len(rows) <= 3 * 2 * 2
    sums = {r.query_id: r.s for r in hist.sums().collect()}
    for k, q in enumerate(queries.tolist()):
        hit = sum(r.w for r in rows if k in np.frombuffer(bytes(r.hits), "<i4"))
        assert hit == pytest.approx(sums[q])


def test_a_long_fit_of_workloads_with_recycling(spark):
    true, hist = _start(spark)
    fit.multiplicative_weights(hist, true, 2, fit.Chooser(n=500, eps0=1.0, seed=1, single=False), recycle=True)
    assert len(hist.etas) > 2 and len(hist.snapshots) == 2
    again = _start(spark)[1]
    fit.multiplicative_weights(again, true, 40, fit.Chooser())
    assert again.log[-1]["error_max"] < 0.8 * again.log[0]["error_max"]
