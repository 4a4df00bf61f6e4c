import math
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tallymill.llm import ctw, lm_scoring as lm, quality_classifier as qc

from . import data


def brute(trained, text, depth):
    """Context-tree weighting by its definition, one node at a time."""
    bits = lambda x: [((x >> (8 - k)) | (1 << k), (x >> (7 - k)) & 1) for k in range(8)]
    nodes, children = {}, {}
    for s in trained:
        b = b"\n" * depth + s
        for k in range(depth, len(b)):
            for node, bit in bits(b[k]):
                for d in range(depth + 1):
                    nodes.setdefault((b[k - d : k], node), [0, 0])[bit] += 1
    for c, node in nodes:
        if c:
            children.setdefault((c[1:], node), []).append((c, node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(key):
        own = kt(*nodes[key])
        if len(key[0]) == depth:
            return own
        below = sum(weighted(k) for k in children[key])
        return float(np.logaddexp(math.log(0.5) + own, math.log(0.5) + below))

    total, b = 0.0, b"\n" * depth + text
    for k in range(depth, len(b)):
        for node, bit in bits(b[k]):
            p = None
            for d in range(depth, -1, -1):
                key = (b[k - d : k], node)
                counts = nodes.get(key, [0, 0])
                q = (counts[bit] + 0.5) / (sum(counts) + 1)
                w = 1 if d == depth else math.exp(math.log(0.5) + kt(*counts) - weighted(key)) if key in nodes else 0.5
                p = q if p is None else w * q + (1 - w) * p
            total += math.log10(p)
    return total


def test_ctw_by_definition(spark):
    pairs = [(1, "The cat. the CAT"), (2, None), (3, "a the"), (4, "é the cat sat"), (4, "é the cat sat"), (10, "unseen words é"), (None, "cat")]
    rows = data.frame(spark, pairs).selectExpr("doc_id", "text", "CAST(crc32(coalesce(CAST(doc_id AS STRING), '')) % 3 AS INT) AS remainder")
    train = [b" ".join(lm.tokens(r.text)) + b"\n" for r in rows.collect() if r.remainder]
    for depth in (1, 2, 3, 5):
        model = lm.train(rows, depth)
        for way in (dict(), dict(chunk_bytes=20), dict(chunk_bytes=20, most=9), dict(most=0)):
            for r, t in zip(sorted(lm.score(rows, model, depth, **way).collect(), key=lambda r: (r.doc_id or 0, r.score)), sorted(rows.collect(), key=lambda r: (r.doc_id or 0))):
                assert r.score == pytest.approx(brute(train, b" ".join(lm.tokens(t.text)) + b"\n", depth), abs=1e-8)


def test_grams_of_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 300).astype(np.uint8)
    codes, place = ctw.block_grams(raw, 3)
    for i, p in enumerate(place):
        a, b, c, x = raw[i : i + 4].tolist()
        assert int(codes[p]) == (c << 24) | (b << 16) | (a << 8) | x
    assert len(np.unique(codes)) == len(codes)


def test_grams_of_blocks_of_any_alphabet_and_depth():
    """Packed with their positions where 64 bits hold both, else sorted plainly."""
    rng = np.random.default_rng(2)
    for size, letters, depth in ((400, 256, 7), (400, 3, 7), (9, 200, 5), (300, 1, 1), (5000, 129, 5), (5000, 128, 5)):
        raw = rng.integers(0, letters, size).astype(np.uint8)
        codes, place = ctw.block_grams(raw, depth)
        want = [int.from_bytes(bytes([*raw[i : i + depth][::-1], raw[i + depth]])) for i in range(size - depth)]
        assert codes[place].tolist() == want
        assert codes.tolist() == sorted(set(want))


def test_counts_of_repeated_grams_are_sent_once(monkeypatch):
    """A task's grams are merged before their number says that they must be sent."""
    monkeypatch.setattr(lm, "TABLE", 100)
    text, n = "the cat sat on the mat " * 6, 512 * 30
    batch = pa.record_batch({"text": pa.array([text] * n), "remainder": pa.array(np.ones(n, np.int32))})
    rows = [r for b in lm._counts(iter([batch]), 3) for r in b.to_pylist()]
    words, grams = [r for r in rows if r["word"] is not None], [r for r in rows if r["word"] is None]
    assert len(words) == 5 and len(grams) == len({r["gram"] for r in grams})  # each gram 5 times before
    assert sum(r["n"] for r in words) == n * 36 and sum(r["n"] for r in grams) == n * len(text)


def test_counts_hold_the_grams_of_the_texts_alone_and_are_sent_in_slices(monkeypatch):
    """Before, a task's counts went to the JVM as one batch, with grams that span two texts."""
    monkeypatch.setattr(lm, "SENT", 7)
    texts = ["abc abd  abe", None, "éa\nab abc"]
    batch = pa.record_batch({"text": pa.array(texts), "remainder": pa.array([1, 0, 2], pa.int32())})
    sent = list(lm._counts(iter([batch]), 3))
    assert max(b.num_rows for b in sent) <= 7
    want, words = Counter(), Counter()
    for text, of in zip(texts, (1, 0, 1)):
        b = b"\n" * 3 + lm.string(text)
        for i in range(len(b) - 3):
            want[int.from_bytes(bytes([*b[i : i + 3][::-1], b[i + 3]]))] += of
        words.update(lm.tokens(text) * of)
    rows = [r for b in sent for r in b.to_pylist()]
    assert {r["gram"]: r["n"] for r in rows if r["word"] is None} == want
    assert {r["word"]: r["n"] for r in rows if r["word"] is not None} == words


def test_frequent_words_are_broadcast_and_the_others_joined(spark):
    """A chunk asks for its rare words alone; where the cut lies changes no score."""
    pairs = [(i, "the cat the dog the of " + f"rare{i} " * (i % 3)) for i in range(40)] + [(41, None), (42, "unseen? of")]
    rows = data.frame(spark, pairs).selectExpr("doc_id", "text", "CAST(doc_id % 7 AS INT) AS remainder")
    model = lm.train(rows, 2)
    got = [sorted(lm.score(rows, model, 2, chunk_bytes=200, most_words=k).collect()) for k in (0, 5, 1 << 18)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(pairs)
    chunk = pa.table({"chunk": pa.array([3, 3], pa.int32()), "text": ["the cat  rare1 the", None]})
    asked = lm._keys(chunk, 2, None, {b"the": -1.0, b"cat": -2.0})
    assert asked.to_pylist() == [{"chunk": 3, "word": b"rare1", "gram": None}]


HELD = """
import numpy as np, pyarrow as pa
from tallymill.llm import lm_scoring as lm

rng = np.random.default_rng(0)
held = lambda: next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("RssAnon")) // 1024
batch = lambda n: pa.record_batch({"text": pa.array([" ".join(map(str, rng.integers(0, 10**6, 300).tolist())) for _ in range(n)]), "remainder": pa.array(np.ones(n, np.int32))})
large, few = batch(3000), list(lm._counts(iter([batch(5)]), 5))
before = held()
for rows in lm._counts(iter([large]), 5):
    pass
del rows
print(held() - before)
"""


def test_a_worker_gives_memory_back_after_counting():
    """It waits beside the JVM, whose heap may be full by then."""
    done = subprocess.run([sys.executable, "-c", HELD], cwd=Path(__file__).parents[2], capture_output=True, text=True, timeout=100, check=True)
    assert int(done.stdout) < 60  # MB: 35 measured, 76 to 84 before


def test_long_texts_are_cut_into_segments(monkeypatch):
    s = [b"abc abd " * 40 + b"\n", b"\n", b"xyz\n"]
    whole = {}
    for seg in (7, 1000):
        monkeypatch.setattr(lm, "SEGMENT", seg)
        sums = Counter()
        for codes, place, owner in lm.blocks(s, 3):
            sums.update(zip(owner.tolist(), codes[place].tolist()))
        whole[seg] = sums
    assert whole[7] == whole[1000]
    assert sum(whole[7].values()) == sum(map(len, s))


def test_base_scores(spark, tmp_path):
    pairs = data.rows(3, 60)
    got = lm.op5_lm_scoring(spark, data.table(spark, pairs, tmp_path)).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    for r in got:
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_bytes)
    assert Counter((r.doc_id, r.n_bytes) for r in got) == Counter((i, len(b" ".join(lm.tokens(t))) + 1) for i, t in pairs)
    c, ends = Counter(), 0
    for i, t in pairs:
        if not held(i):
            c.update(lm.tokens(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    lg = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    want = Counter((i, held(i), len(ws := lm.tokens(t)) + 1, sum(w in c for w in ws) + 1, n, round(sum(lg(c[w]) for w in ws) + lg(ends), 6)) for i, t in pairs)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_rows_that_repeat_are_scored_once_and_all_returned(spark):
    pairs = [(1, "one text again and again")] * 50 + [(None, "no id")] * 7 + [(i, f"other {i}") for i in range(2, 30)] + [(1, "another text of this id")]
    rows = data.frame(spark, pairs).selectExpr("doc_id", "text", "1 AS remainder")
    model = lm.train(rows)
    got = lm.score(rows, model, chunk_bytes=40).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in pairs)
    by = {(r.doc_id, r.n_bytes): r.score for r in got}
    assert len({r.score for r in got if r.doc_id == 1}) == 2
    alone = lm.score(rows.distinct(), model).collect()
    assert {(r.doc_id, r.n_bytes): pytest.approx(r.score) for r in alone} == by


def test_no_task_holds_two_python_processes(spark, monkeypatch):
    """Functions in a row in one stage would each hold a process for every core."""
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    cut = lm.cut
    monkeypatch.setattr(lm, "cut", noted)
    rows = data.frame(spark, data.rows(5, 40)).selectExpr("doc_id", "text", "1 AS remainder")
    assert lm.train(rows).grams.count() > 0
    counts = [len(re.findall("MapInArrow", p)) for p in plans]
    assert max(counts) == counts[-1] == 1  # 2 in the last when large pairs were mixed in apart


def test_words_of_a_chunk_take_little_beside_their_table():
    n = 200_000
    words = pa.array([*(b"w%d" % i for i in range(n)), None, None], pa.binary())
    answers = pa.table({"word": words, "gram": pa.array([None] * n + [7, 8], pa.int64()), "value": pa.array([float(i % 50) for i in range(n + 2)])})
    base = lambda c: math.log10(c + 0.1)
    tracemalloc.start()
    lp = lm._of_words(answers, base)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lp == {b"w%d" % i: base(i % 50) for i in range(n)}
    assert peak < 140 * n  # 116 measured; 179 by whole lists and a number for each word


def test_lm_empty_and_untrained(spark):
    rows = data.empty(spark).selectExpr("doc_id", "text", "1 AS remainder")
    assert lm.score(rows, lm.train(rows)).count() == 0
    only = data.frame(spark, [(1, "a b")]).selectExpr("doc_id", "text", "0 AS remainder")
    r = lm.score(only, lm.train(only)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0)
    assert r.score == pytest.approx(-4 * 8 * math.log10(2))


def test_discriminant_matches_densities():
    rng = np.random.default_rng(1)
    x = {0: rng.normal(0, 2, (400, 9)), 1: rng.normal(1, 0.5, (900, 9))}
    model = qc.discriminant({c: (len(v), v.sum(0), v.T @ v) for c, v in x.items()}, shrink=0.0, ridge=0.0)
    points = rng.normal(0.5, 1, (20, 9))
    log = []
    for c in (0, 1):
        mean, cov = x[c].mean(0), np.cov(x[c].T, bias=True)
        d = points - mean
        log.append(np.log((len(x[c]) + 1) / 1302) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert model.score(points) == pytest.approx(1 / (1 + np.exp(log[0] - log[1])), rel=1e-6, abs=1e-9)


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = qc.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in got) / len(got) > 0.95
    good = [r for r in got if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.98


def test_classifier_awkward_rows(spark):
    pairs = data.rows()
    schema = "doc_id bigint, quality int, toxic int"
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (6, None, 0), (999, 1, 0), (None, 1, 0), (12, 1, 1), (15, 0, 0)], schema)
    for known in (labels, labels.where("quality = 1"), spark.createDataFrame([], schema)):
        got = qc.classify(data.frame(spark, pairs), known).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in pairs)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert qc.classify(data.empty(spark), labels).count() == 0
    kept = qc.keep_good(data.frame(spark, pairs), labels)
    assert kept.columns == data.frame(spark, []).columns
