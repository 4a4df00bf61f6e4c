import random

import pytest

import corpus_pipeline
from tallymill.llm import simhash, similar

from . import data


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def lone_pairs(n):
    """Pairs of texts of 400 or 150 words: one passage replaced or words edited
    here and there, to similarities around 0.8."""
    rng, pairs = random.Random(8), []
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    for k in range(n):
        size = (400, 150)[k % 2]
        a = [word() for _ in range(size)]
        b = list(a)
        if k % 4 < 2:
            length = int(size * rng.uniform(0.06, 0.115))
            at = rng.randrange(5, size - length - 5)
            b[at : at + length] = [word() for _ in range(length)]
        else:
            for at in rng.sample(range(size), int(size * rng.uniform(0.012, 0.026))):
                b[at] = word()
        pairs.append((" ".join(a), " ".join(b)))
    return pairs


def test_lone_pairs_against_brute_force(spark):
    pairs = lone_pairs(400)
    rows = [(2 * k + side, t) for k, p in enumerate(pairs) for side, t in enumerate(p)]
    kept = {r.doc_id for r in simhash.keep_one(data.frame(spark, rows), corpus_pipeline.NEAR).collect()}
    likes = [jaccard(*p) for p in pairs]
    assert sum(0.8 <= x < 0.85 for x in likes) >= 80 and sum(x < 0.8 for x in likes) >= 40
    assert {2 * k for k in range(len(pairs))} <= kept
    assert [2 * k + 1 in kept for k in range(len(pairs))] == [x < 0.8 for x in likes]


@pytest.mark.parametrize("tile", [similar.TILE, 4])
def test_a_cluster_in_tiles_against_brute_force(spark, tile):
    rng = random.Random(3)
    base, texts = data.prose(rng, 120).split(), []
    for _ in range(40):
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(6)):
            copy[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += ["", " ", "one", "ONE", "one two", texts[0].upper()]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    got = {int(r["key"]): r["class"] for r in similar.similar(df, corpus_pipeline.NEAR, tile).collect()}
    assert len(got) == len(texts)
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in got for j in got)
    assert similar.similar(df.limit(0), corpus_pipeline.NEAR).count() == 0


def template_pages(n, seed=5):
    """Pages of one template whose sets agree in about 0.44; every tenth page has
    a near copy."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    frame, rows = [word() for _ in range(150)], []
    for k in range(n):
        own = [word() for _ in range(90)]
        rows.append((2 * k, " ".join([*frame, *own])))
        if k % 10 == 0:
            rows.append((2 * k + 1, " ".join([*frame, *own[:-4], *(word() for _ in range(4))])))
    return rows


@pytest.mark.parametrize("n, sketches", [(300, similar.SKETCHES), (300, 16), (1500, similar.SKETCHES)])
def test_pages_of_one_template_fall_apart(spark, monkeypatch, n, sketches):
    monkeypatch.setattr(similar, "SKETCHES", sketches)
    rows = template_pages(n)
    like = [jaccard(rows[1 + k][1], rows[2 + k][1]) for k in range(1, 20)]
    assert 0.4 < sorted(like)[len(like) // 2] < 0.5
    docs = data.frame(spark, rows)
    found = similar.per_batch(docs.selectExpr("CAST(doc_id AS STRING) AS key", "text"), similar._described, "key string, node bigint, fp bigint, bands array<bigint>, sketch binary")
    # what is joined before any exact comparison: the planted pairs, so clusters don't grow with the template
    assert similar.proposals(found, corpus_pipeline.NEAR).selectExpr("least(u, v)", "greatest(u, v)").distinct().count() == n // 10
    kept = {r.doc_id for r in simhash.keep_one(docs, corpus_pipeline.NEAR).collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0}
