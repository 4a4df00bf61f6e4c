import numpy as np
import pytest

from tallymill.domain import Domain, EncodedData
from tallymill.operators import marginals as m
from tallymill.plans.workload import QuerySpace, all_workloads, count_queries, random_workloads

DOM = Domain(("a", "b", "c-d"), (2, 3, 2))


def rows(spark, values, weights=None):
    schema = "a int, b int, `c-d` int" + (", w double" if weights else "")
    return spark.createDataFrame([(*v, *([w] if weights else [])) for v, w in zip(values, weights or values)], schema)


def test_domain_algebra(tmp_path):
    assert DOM.project("b").config == {"b": 3}
    assert DOM.transpose(["c-d", "a"]).attrs == ("c-d", "a")
    assert DOM.marginalize(["a"]).attrs == ("b", "c-d")
    assert DOM.invert("b") == ["a", "c-d"]
    assert DOM.axes(["b", "a"]) == (1, 0)
    assert DOM.canonical(["c-d", "a"]) == ("a", "c-d")
    assert DOM.merge(Domain(("b", "z"), (9, 5))).config == {"a": 2, "b": 3, "c-d": 2, "z": 5}
    assert DOM.contains(Domain(("a",), (2,))) and not DOM.contains(Domain(("q",), (2,)))
    assert DOM.size() == 12 and DOM.size("b") == 3 and DOM.size([]) == 1
    assert DOM.sort().attrs == ("a", "c-d", "b") and DOM.sort("name").attrs == ("a", "b", "c-d")
    assert "a" in DOM and DOM["b"] == 3 and len(DOM) == 3 and list(DOM) == ["a", "b", "c-d"]
    DOM.to_json(f"{tmp_path}/d.json")
    assert Domain.from_json(f"{tmp_path}/d.json") == DOM
    with pytest.raises(ValueError):
        Domain(("a",), (1, 2))
    assert Domain(tuple(f"x{i}" for i in range(81)), (10,) * 81).size() == 10**81


def test_dense_histogram_and_density(spark):
    data = EncodedData(rows(spark, [(0, 0, 0), (0, 0, 1), (1, 2, 0)]), DOM).project(["a", "b"])
    assert [r.value for r in data.datavector().orderBy("cell").collect()] == [2, 0, 0, 0, 0, 1]
    assert [r.value for r in data.datavector(density=True).orderBy("cell").collect()] == pytest.approx([2 / 3, 0, 0, 0, 0, 1 / 3])
    assert data.records == 3 and data.drop("a").df.columns == ["b"]
    with pytest.raises(ValueError):
        EncodedData(data.df, DOM)


@pytest.mark.parametrize("strategy", ["inline", "arrow"])
@pytest.mark.parametrize("density", [None, "valid", "all"])
def test_answers_against_numpy(spark, strategy, density):
    rng = np.random.default_rng(0)
    values = [tuple(int(x) for x in rng.integers([-1, -1, 0], [3, 4, 2])) for _ in range(200)]
    weights = [float(w) for w in rng.integers(1, 5, 200)]
    space = QuerySpace(DOM, all_workloads(DOM, 2) + [("b",)])
    data = EncodedData(rows(spark, values, weights), DOM, "w")
    got = {r.query_id: r.ans for r in m.answers(data, space, density, strategy).collect()}
    assert sorted(got) == list(range(space.n_queries))
    place = {a: i for i, a in enumerate(DOM.attrs)}
    for w in space.workloads:
        ok = [(v, x) for v, x in zip(values, weights) if all(0 <= v[place[a]] < n for a, n in zip(w.attrs, w.sizes))]
        by = {None: 1, "all": sum(weights), "valid": sum(x for _, x in ok)}[density]
        for q in range(w.offset, w.offset + w.n_cells):
            want = space.values(q)
            assert got[q] == pytest.approx(sum(x for v, x in ok if all(v[place[a]] == c for a, c in want.items())) / by)


def test_numbering_round_trips(spark):
    space = QuerySpace(DOM, [("c-d", "a"), ("b",), ("a", "b", "c-d"), ("b",)])
    assert [w.attrs for w in space.workloads] == [("a", "b", "c-d"), ("a", "c-d"), ("b",), ("b",)]
    for q in range(space.n_queries):
        again = space.lookup(space.values(q))
        assert again == q if q < 12 + 4 + 3 else again == q - 3  # the first of repeated workloads
    assert space.lookup({"a": 5, "c-d": 0}) is None and space.lookup({"z": 0}) is None
    assert space.describe(13) == "a=0 | c-d=1"
    listed = {r.query_id: (r.wid, tuple(r.vals)) for r in space.queries(spark).collect()}
    assert all(listed[q] == (space.workload_of(q).wid, tuple(space.values(q).values())) for q in range(space.n_queries))
    kept = space.filter_workloads([1, 2])
    assert kept.n_queries == 7 and space.query_mask([1, 2]) == list(range(12, 19))
    assert count_queries(DOM, all_workloads(DOM, 2)) == 6 + 4 + 6
    assert random_workloads(DOM, 2, 2, 0) == random_workloads(DOM, 2, 2, 0)
    assert all(DOM.size(w) <= 4 for w in random_workloads(DOM, 9, 2, 0, most_cells=4))


def test_groups_bridges_and_soft_rows(spark):
    space = QuerySpace(DOM, all_workloads(DOM, 2))
    values = [(0, 1, 1), (1, 2, 0), (1, 2, 1)]
    found = m.answers(EncodedData(rows(spark, values), DOM), space)
    grouped = {r.wid: r.answers for r in m.by_workload(found, space).collect()}
    assert len(grouped[0]) == 6 and sum(grouped[0]) == pytest.approx(1)
    bridge = m.random_bridge(space, 1)
    flat = [x for w in sorted(grouped) for x in grouped[w]]
    got = {r.agg_id: r.ans for r in m.aggregate_answers(found, spark.createDataFrame(bridge, "agg_id int, query_id bigint")).collect()}
    for agg in got:
        assert got[agg] == pytest.approx(sum(flat[q] for a, q in bridge if a == agg))
    hot = np.zeros((3, 7))
    at = DOM.offsets()
    for i, v in enumerate(values):
        for a, c in zip(DOM.attrs, v):
            hot[i, at[a] + c] = 1
    assert m.soft_answers(hot, space) == pytest.approx(flat)


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    a = EncodedData.synthetic(spark, DOM, 500, 3).df.collect()
    assert a == EncodedData.synthetic(spark, DOM, 500, 3).df.collect()
    assert {r["b"] for r in a} == {0, 1, 2}
