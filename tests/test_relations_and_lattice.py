"""Set queries as a relation, and cuboids that cover workloads."""

import itertools
import pickle
import random

import numpy as np
import pytest

from tallymill.domain import Domain, EncodedData
from tallymill.operators import marginals as m
from tallymill.operators import setquery as sq
from tallymill.operators import setrelation as sr
from tallymill.plans import lattice
from tallymill.plans.workload import QuerySpace, all_workloads, random_workloads

DOM = Domain(("age", "sex", "race"), (116, 2, 63))


def _asked(rng, n):
    def some(size):
        return rng.choice([None, [], sorted(rng.sample(range(size), rng.randint(1, size))), list(range(size)), [size - 1, size + 5, -1]])

    return [(rng.choice([1, 2, None, 9]), q, some(116), some(2), some(63)) for q in range(n)]


def _counts(rows, asked):
    out = {}
    for place, q, *allowed in asked:
        hit = lambda v, a, n: not a or (v is not None and v in a and 0 <= v < n)
        out[q] = float(sum(w for p, *codes, w in rows if p == place and all(hit(v, a, n) for v, a, n in zip(codes, allowed, DOM.shape))))
    return out


@pytest.mark.parametrize("slices", [1, 5])
def test_relation_against_python(spark, slices):
    rng = random.Random(slices)
    rows = [(rng.choice([1, 2, None]), rng.choice([-1, None, *range(118)]), rng.choice([0, 1, 2]), rng.choice([0, 5, 62, 63, None]), rng.randint(1, 3)) for _ in range(400)]
    asked = _asked(rng, 60)
    df = spark.createDataFrame(rows, "place int, age int, sex int, race int, w int")
    table = spark.createDataFrame(asked, "place int, qid int, ages array<int>, sexes array<int>, races array<int>")
    queries = sr.SetQueries.of_arrays(table, DOM, {"age": "ages", "sex": "sexes", "race": "races"}, ["place"])
    got = {r.qid: r.ans for r in sr.relation_answers(df, queries, "w", slices=slices).collect()}
    assert got == _counts(rows, asked)
    share = {r.qid: r.ans for r in sr.relation_answers(df, queries, "w", density=True, slices=slices).collect()}
    whole = {p: sum(r[-1] for r in rows if r[0] == p) for p in (1, 2, None)}
    for place, q, *_ in asked:
        assert share[q] == (pytest.approx(got[q] / whole[place]) if place in whole else 0.0)
    none = sr.relation_answers(df.limit(0), queries, "w").collect()
    assert len(none) == 60 and all(r.ans == 0 for r in none)


def test_relation_of_codes_and_repetitions(spark):
    queries = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0), (2, 1)], "place int, qid int")
    values = [(1, 0, "age", 3), (1, 0, "age", 100), (1, 1, "age", 100), (1, 1, "age", 3), (1, 1, "age", 3), (1, 2, "sex", 1), (2, 0, "race", 62)]
    own = sr.SetQueries.of_relation(spark.createDataFrame(values, "place int, qid int, attr string, code int"), DOM, queries, ["place"])
    assert sorted((r.place, r.qid) for r in own.distinct().df.collect()) == [(1, 0), (1, 2), (2, 0), (2, 1)]
    assert {tuple(r.attrs): r.n for r in own.attribute_sets().collect()} == {("age",): 2, ("sex",): 1, ("race",): 1, (): 1}
    rows = spark.createDataFrame([(1, 3, 1, 0), (1, 100, 0, 62), (2, 100, 0, 62), (2, 5, 1, 1)], "place int, age int, sex int, race int")
    assert {(r.place, r.qid): r.ans for r in sr.relation_answers(rows, own).collect()} == {(1, 0): 2, (1, 1): 2, (1, 2): 1, (2, 0): 1, (2, 1): 2}


@pytest.mark.parametrize("by", [[], ["p"]])
def test_bands_as_tables(spark, by):
    rng = random.Random(len(by))
    dom = Domain(("age", "sex", "race", "p"), (20, 2, 5, 3))
    rows = [(rng.choice([-1, None, *range(22)]), rng.choice([0, 1, None]), rng.randrange(6), rng.choice([0, 1, None]), float(rng.randint(1, 3))) for _ in range(300)]
    data = EncodedData(spark.createDataFrame(rows, "age int, sex int, race int, p int, w double"), dom, "w")
    asked = []
    for _ in range(40):
        a = rng.randrange(20)
        asked.append({"age": rng.choice([[], range(a, rng.randint(a, 21) + 1)]), "sex": rng.choice([[], [0], [1]]), "race": rng.choice([[], [0, 3]])})
    bands = sq.banded(asked)
    assert bands.axis == "age" and len(bands.classes) <= 6
    for density in (True, False):
        one, two = (sorted(map(tuple, sq.set_answers(data, asked, density, by, strategy=s).collect()), key=str) for s in ("tables", "bands"))
        assert [r[:-1] for r in one] == [r[:-1] for r in two] and [r[-1] for r in one] == pytest.approx([r[-1] for r in two])
    assert sq.banded([{"age": [1, 3]}]) is None and sq.banded([{}]) is None
    with pytest.raises(ValueError):
        sq.set_answers(data, [{"age": [1, 3], "sex": [0]}, {"sex": [0, 5], "age": [7]}], strategy="bands")


def _domain(sizes):
    return Domain(tuple(f"a{i:02}" for i in range(len(sizes))), tuple(sizes))


@pytest.mark.parametrize("make", [lattice.cover, lattice.by_blocks])
def test_every_workload_lies_in_one_cuboid(make):
    dom = _domain([2, 3, 5, 40, 7, 2, 300, 4, 9, 2])
    space = QuerySpace(dom, [*all_workloads(dom, 3), *all_workloads(dom, 1), ("a00", "a01"), ("a00", "a01")])
    found = make(space.workloads, 4096)
    assert sorted(w.wid for c in found for w in c.children) == list(range(len(space.workloads)))
    for c in found:
        assert all(set(w.attrs) <= set(c.attrs) for w in c.children)
        assert c.n_cells <= 4096 or len({w.attrs for w in c.children}) == 1 or any(len(w.attrs) == len(c.attrs) for w in c.children)
    assert len(found) < len(space.workloads) * (0.7 if make is lattice.cover else 1)


def test_many_workloads_take_few_passes():
    rng = np.random.default_rng(3)
    dom = _domain([int(x) for x in np.concatenate([rng.integers(2, 9, 60), rng.integers(9, 30, 15), [48, 67, 81, 91, 97, 150]])])
    space = QuerySpace(dom, random_workloads(dom, 3200, 3, seed=0))
    passes = lattice.plan(space.workloads, m.DENSE_CELLS)
    assert len(passes) <= 3 and sum(len(c.children) for p in passes for c in p) == 3200
    assert sum(len(p) for p in passes) < 3200 * 0.7  # cuboids counted for each row
    assert all(sum(c.n_cells for c in p) <= m.DENSE_CELLS for p in passes)


@pytest.mark.parametrize("density", [None, "valid", "all"])
@pytest.mark.parametrize("dense", [1, 300, 1 << 23])
def test_sums_in_several_passes(spark, density, dense, monkeypatch):
    """Against numpy: cells met one by one, in several passes, and in one."""
    monkeypatch.setattr(m, "DENSE_CELLS", dense)
    rng = np.random.default_rng(dense)
    dom = Domain(("a", "b-c", "d", "e"), (3, 4, 2, 5))
    codes = rng.integers(-1, [4, 5, 3, 6], (300, 4))
    weights = rng.integers(1, 4, 300).astype(float)
    space = QuerySpace(dom, [w for k in (1, 2, 3, 4) for w in itertools.combinations(dom.attrs, k)])
    df = spark.createDataFrame([(*map(int, c), float(w)) for c, w in zip(codes, weights)], "a int, `b-c` int, d int, e int, w double")
    data = EncodedData(df, dom, "w")
    found = m.sums(data, space, "arrow", dense=dense)
    whole = spark.createDataFrame([(float(weights.sum()),)], "__all double")
    got = {r.query_id: r.ans for r in m.finished(found, space, density, whole).collect()}
    want = {}
    for w in space.workloads:
        own = codes[:, [dom.attrs.index(a) for a in w.attrs]]
        ok = ((own >= 0) & (own < np.array(w.sizes))).all(axis=1)
        cells = np.bincount(np.ravel_multi_index(own[ok].T, w.sizes), weights[ok], minlength=w.n_cells)
        by = {None: 1.0, "valid": weights[ok].sum(), "all": weights.sum()}[density]
        want |= {w.offset + k: x / by for k, x in enumerate(cells)}
    assert got == pytest.approx(want)


def test_spaces_travel_as_arrays():
    dom = _domain([2, 3, 4] * 27)
    space = QuerySpace(dom, all_workloads(dom, 3))  # 85,320 workloads
    sent = pickle.dumps(space)
    assert len(sent) < 16 * len(space.workloads) + 10_000
    again = pickle.loads(sent)
    assert again.workloads == space.workloads and again.n_queries == space.n_queries
    for q in (0, 1, 77, 400_000, space.n_queries - 1):
        assert again.lookup(again.values(q)) == q and again.describe(q) == space.describe(q)
