"""The queries and the whole pipeline on awkward rows, against plain Python or
their SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tallymill.llm import packing, quality_classifier as qc
from tallymill.llm.registry import QUERIES, SQL
from tallymill.llm.tokens import Words

from . import data
from .test_similar import jaccard
from .test_simhash_and_packing import classes, print_of
from .test_spans import base_pii

LABELS = "doc_id bigint, quality int, toxic int"


def folder(spark, path, pairs, seed=3):
    rng = random.Random(seed)
    sf = data.table(spark, pairs, path)
    labels = [(i, int(len(t or "") > 150), 0) for i, t in pairs if i is not None and rng.random() < 0.7] + [(None, 1, 0), (10**6, 0, 0), (pairs[0][0], None, 0)]
    spark.createDataFrame(labels, LABELS).write.mode("overwrite").parquet(f"{path}/labels.parquet")
    return sf, labels


def remainder(i, mod):
    return zlib.crc32(str(i).encode() if i is not None else b"") % mod


def plain_scores(pairs, labels):
    """Densities by inverse and determinant, without Cholesky factors."""
    stats = [np.array(qc.statistics(t or "")) for _, t in pairs]
    own = {c: [s for (i, _), s in zip(pairs, stats) for d, q, _ in labels if q == c and d is not None and d == i and remainder(i, 5)] for c in (0, 1)}
    n = {c: len(x) for c, x in own.items()}
    means = {c: np.mean(x, axis=0) for c, x in own.items()}
    covs = {c: sum(np.outer(x - means[c], x - means[c]) for x in own[c]) / n[c] for c in (0, 1)}
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / (n[0] + n[1])
    out = []
    for s in stats:
        log = {}
        for c in (0, 1):
            cov = (1 - qc.SHRINK) * covs[c] + qc.SHRINK * pooled
            cov = (1 - qc.RIDGE) * cov + qc.RIDGE * np.trace(pooled) / len(s) * np.eye(len(s))
            d = s - means[c]
            log[c] = math.log((n[c] + 1) / (n[0] + n[1] + 2)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * d @ np.linalg.inv(cov) @ d
        out.append(1 / (1 + math.exp(min(500, max(-500, log[0] - log[1])))))
    return out


def test_statistics_by_hand():
    assert qc.statistics("") == (0.0, math.sqrt(16 / 20), 0.0, 0.0, 0.0, math.log(5), math.sqrt(3 / 20), 0.0, 0.0)
    got = qc.statistics("a a b|1, b\nx\nx")
    want = (math.log(7), math.sqrt((4 + 16) / 26), math.sqrt(2 / 26), math.sqrt(1 / 26), 0.0, math.log((9 + 100) / 26), math.sqrt((1 + 3) / 26), math.sqrt(1 / 8), math.sqrt(1 / 26))
    assert got == pytest.approx(want)


def test_classifier_query_against_plain_densities(spark, tmp_path):
    pairs = data.rows(5, 90)
    sf, labels = folder(spark, tmp_path, pairs)
    got = QUERIES["op3_quality_classifier"](spark, sf).collect()
    key = lambda i, held, s: (i, held, round(s, 6), int(s >= 0.3))
    assert Counter(key(r.doc_id, r.held_out, r.score) for r in got) == Counter(key(i, remainder(i, 5) == 0, s) for (i, _), s in zip(pairs, plain_scores(pairs, labels)))
    assert all(r.predicted == (r.score >= 0.3) for r in got)


@pytest.mark.parametrize("name", ["op4_quality_rules", "op10_mixing"])
def test_queries_match_their_sql_on_awkward_rows(spark, tmp_path, name):
    sf = data.table(spark, data.rows(8, 80) + [(None, "x y"), (700, " ".join(["one two three four five six seven eight"] * 9))], tmp_path)
    df = QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet/*.parquet')")
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(found.fetchall())


def test_simhash_and_packing_queries(spark, tmp_path):
    pairs = data.rows(4, 50)
    sf = data.table(spark, pairs, tmp_path)
    prints = [print_of(t or "") for _, t in pairs]
    want = classes(prints, [i for i, _ in pairs], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    got = QUERIES["op6_simhash"](spark, sf).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(pairs, prints, want))
    words, want = Words(packing.tokenizer_path()), Counter()
    for i, t in pairs:
        ids = words._whole(t or "") + b"\0\0\0\0"
        want.update((i, k, s // 4, len(ids[s : s + 8192]) // 4, zlib.crc32(ids[s : s + 8192])) for k, s in enumerate(range(0, len(ids), 8192)))
    placed = QUERIES["op9_packing"](spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    sequences = defaultdict(list)
    for r in placed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048


def test_the_pipeline_against_plain_python(spark, tmp_path):
    rng = random.Random(21)
    pairs = data.rows(6, 60)
    pairs += [(400 + k, t) for k, (_, t) in enumerate(pairs[:12])]  # copies under other ids
    pairs += [(500 + k, f"{data.prose(rng, 60)} mail a{k}@b.co from 10.0.0.{k}") for k in range(8)]
    sf, labels = folder(spark, tmp_path, pairs)
    good = [p for p, s in zip(pairs, plain_scores(pairs, labels)) if s >= qc.THRESHOLD]
    texts = [t or "" for _, t in good]
    root = classes(texts, range(len(texts)), lambda i, j: jaccard(*("".join(c.lower() if c.isascii() else c for c in texts[k]) for k in (i, j))) >= 0.8)
    kept = {}
    for c, p in zip(root, good):
        kept[c] = min(kept.get(c, p), p, key=lambda q: (q[0] is None, q[0] or 0))

    def redacted(t):
        spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in base_pii(t).split(",") if x))
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [t[at:a], f"<{k.upper()}>"]
            at = max(at, b)
        return "".join(out) + t[at:]

    clean = [(i, None if t is None else redacted(t)) for i, t in kept.values()]
    source = lambda i: f"src{(i or 0) % 3}"
    n = Counter(source(i) for i, _ in clean)
    whole = sum(x**0.5 for x in n.values())
    words, want = Words(packing.tokenizer_path()), Counter()
    for i, t in clean:
        rate = round(n[source(i)] ** 0.5 / whole * len(clean) / n[source(i)], 9)
        name = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"20:count:1:{name}".encode()).hexdigest()[:13], 16) / 2**52
        times, total = 0, 0.0
        for k in range(100):
            total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
            times += round(total, 12) <= u
        ids = words._whole(t or "") + b"\0\0\0\0"
        for k, s in enumerate(range(0, len(ids), 8192)):
            want[(i, k, s // 4, len(ids[s : s + 8192]) // 4, zlib.crc32(ids[s : s + 8192]))] += times
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want
    assert 20 < len(kept) < len(good) < len(pairs)


def test_stages_on_empty_tables_and_other_columns(spark, tmp_path):
    sf, _ = folder(spark, tmp_path, data.rows())
    for docs in (data.empty(spark), data.frame(spark, data.rows())):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "packing":
                assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
            else:
                assert out.columns == docs.columns
            assert (out.count() == 0) == docs.isEmpty()
