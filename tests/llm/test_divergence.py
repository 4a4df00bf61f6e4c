"""The source audit against plain Python, on awkward rows and in small blocks."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallymill.llm import divergence as d

from . import data


def brute(rows: list[tuple], min_docs: int, top: int) -> list[tuple]:
    """rows: (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in [tuple(x or "" for x in r) for r in rows]:
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        size = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        total = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        v, whole = len(kept), sum(size.values())
        p = {s: {t: 1 + d.SCALE * (counts[lang, s][t] + 1) // (size[s] + v) for t in kept} for s in sources}
        q = {t: 1 + d.SCALE * (total[t] + 1) // (whole + v) for t in kept}
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked[:most])]
    return sorted(out)


def audited(spark, rows, min_docs=3, top=200):
    df = spark.createDataFrame([(i, *r, 0.5, 7) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, value double, counts int")
    got = d.audit(df.repartition(3), min_docs, top).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(map(tuple, got))


def test_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "Ä", "a:b"])) for _, t in data.rows()]
    rows += [("alpha beta beta", "xx", "one")] * 2 + [("", "yy", "only"), (None, None, None), ("Straße STRASSE É é", "de", "b"), ("a" * 50_000 + " b" * 2000, "en", "a")]
    rows += [("tie tie", "tt", "s1"), ("tie tie", "tt", "s2"), ("tie", "tt", "s3"), ("other", "tt", "s3")]
    assert audited(spark, rows) == brute(rows, 3, 200)
    assert audited(spark, rows, 1, 2) == brute(rows, 1, 2)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    assert d.audit(df).count() == 0


def test_a_task_passes_its_counts_on(spark, monkeypatch):
    rows = [(t, "en", f"s{i % 4}") for i, (_, t) in enumerate(data.rows(7))]
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    whole = sorted(map(tuple, d.term_counts(df).collect()))
    assert sorted(map(tuple, d.term_counts(df, held=5).collect())) == whole


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_sums_by_blocks(cells):
    rng = np.random.default_rng(cells)
    width, columns = 5, 11
    dense = rng.integers(0, 4, (columns, width))
    sizes, terms = rng.integers(50, 90, width), rng.integers(1, 9, columns)
    row, source = np.nonzero(dense)
    starts = np.searchsorted(row, np.arange(columns + 1))
    got = np.concatenate([s for _, s in d.pair_sums(sizes, 30, starts, source, dense[row, source], terms, cells)])
    p = 1 + d.SCALE * (dense + 1) // (sizes + 30)
    want = [[sum(int(t) * ((int(x[i]) - int(x[j])) ** 2 // int(x[j])) for x, t in zip(p, terms)) for j in range(width)] for i in range(width)]
    assert got.tolist() == want


def test_shares_of_counts_past_64_bits():
    n, size = np.array([10**13, 5 * 10**14, 0]), np.array([3 * 10**13, 10**15, 10**15])
    assert d.shares(n, size).tolist() == [1 + d.SCALE * (int(a) + 1) // int(b) for a, b in zip(n, size)]
