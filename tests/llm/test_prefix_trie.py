"""Tries against a dictionary of prefixes, in one shard and in many."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tallymill.llm import prefix_trie as t

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n int, key string, depth int"


def brute(rows: list[tuple]) -> list[tuple]:
    """rows: (conv_id, turn, role, text); no turn number repeats with unequal turns of one role."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        root = int(np.fix(c / 100)) * 100
        path = tuple(own.get(root, [])[:h] + own[c][h:])
        for k in range(len(path) + 1):
            members[path[:k]].append(c)
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for k in range(len(p) + 1):
            leaves[p[:k]] += p not in kids
            saved[p[:k]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    hashed = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids.get(p, 0), leaves[p], saved[p], hashed(p)) for p, m in members.items()), key=str)


def conversations(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 7 % 523
        same = rng.random() < 0.3  # copies of one conversation
        for turn in range(4 if same else rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, turn, ["user", "assistant"][turn % 2], f"hot {turn}" if same else rng.choice(["hi", "ho", "a longer text", "", None, "漢字 😀"])))
    return rows


def awkward() -> list[tuple]:
    rows = conversations(3, 260)
    rows += [(-5, 0, "user", "below"), (-105, 1, None, "x"), (-105, None, "user", None), (None, 0, "user", "nobody's"), (None, None, None, None)]
    rows += [(10**15, 0, "user", "far"), (10**15 + 3, 2, "user", "far"), (10**15 + 3, 2, "user", "far"), (77, 9, "user\n", "a:b"), (78, 9, "user", "\na:b")]
    rows += [(601, k, "user", f"turn {k % 3}") for k in range(450)] + [(602, k, "user", "y" * 20_000) for k in range(3)]
    return rows


def got(spark, rows, few, parts=None):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts or before)
    try:
        return sorted(map(tuple, t.nodes(t.rebuilt(t.paths(df)), few=few).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("few, parts", [(10**9, None), (300, 4), (40, 30)])
def test_awkward_conversations(spark, few, parts):
    assert got(spark, awkward(), few, parts) == brute(awkward())


def test_no_rows(spark):
    assert got(spark, [], 10) == []
    assert got(spark, [(None, 1, "user", "x")], 10) == []


def test_query(spark, tmp_path):
    rows = conversations(5, 120)
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = t.op13_prefix_trie(spark, str(tmp_path))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows)


def test_ids_of_a_path_in_several_rows(spark, monkeypatch):
    monkeypatch.setattr(t, "IDS", 3)
    rows = [(c, k, "user", f"t{k}") for c in range(40) for k in range(2)] + [(c, 0, "user", f"own {c}") for c in range(40, 80)]
    assert got(spark, rows, 20, 6) == brute(rows)


def test_bit_vector():
    key = lambda *labels: b"".join(x.to_bytes(t.KEY, "big") for x in labels)
    trie = t.Trie(sorted([key(1), key(1, 2), key(1, 3, 4), key(5), key(1, 2), key()]))
    # root: 1 and 5; node 1: 2 and 3; node 5: none; 2: none; 3: 4; 4: none
    assert trie.bits().tolist() == [1, 1, 0, 1, 1, 0, 0, 0, 1, 0, 0]
    assert trie.parents().tolist() == [0, 0, 1, 1, 4]
    assert [trie.find(key(*p)) for p in ((), (1,), (5,), (1, 2), (1, 3), (1, 3, 4), (9,), (5, 1))] == [0, 1, 2, 3, 4, 5, -1, -1]
