import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tallymill.llm import fingerprints as fp

from . import data


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_against_brute_force(spark, tmp_path):
    pairs = [(i, t) for i, t in data.rows(7, 80) if i is not None and i not in (9,)] + [(9, "the last of nine words that are all different here")]
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # several ranges
    got = fp.op2_fingerprints(spark, data.table(spark, pairs, tmp_path)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    order = sorted((i, t or "") for i, t in pairs)
    rows = {r.doc_id: r for r in got}
    assert len(got) == len(order)
    off = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert rows[i].n_chars == len(t)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off.append(rows[i].near_edited - jaccard(t, edited))
        assert rows[i].near_next == pytest.approx(jaccard(t, after), abs=0.2)
        assert (rows[i].fingerprint == "") == (not t.split(" ") or not [w for w in t.replace("\x0b", " ").replace("\x0c", " ").split() if w])
    assert abs(sum(off) / len(off)) < 0.05
    assert max(map(abs, off)) < 0.25


def test_equal_texts_have_equal_prints_and_likeness_one(spark):
    df = fp.fingerprints(data.frame(spark, data.rows()))
    got = df.select("text", fp.to_text(F.col("print")).alias("p"), fp.likeness(F.col("print"), F.col("print")).alias("same")).collect()
    seen = {}
    for r in got:
        assert seen.setdefault(r.text, r.p) == r.p
        assert r.same == 1.0


def test_next_rows_with_repeats_and_nulls(spark):
    rows = fp.with_next(fp.fingerprints(data.frame(spark, data.rows())), ["text"], 5).collect()
    order = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in rows))
    pairs = sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.next_text) for r in rows)
    follow = sorted((*a, b[2]) for a, b in zip(order, order[1:] + order[:1]))
    assert pairs == follow


def test_single_and_empty_tables(spark):
    one = fp.with_next(fp.fingerprints(data.frame(spark, [(5, "a b c")])), ["text"]).collect()
    assert [r.next_text for r in one] == ["a b c"]
    assert fp.with_next(fp.fingerprints(data.empty(spark)), ["text"]).count() == 0


def test_next_rows_of_large_ids(spark):
    ids = [2**62 + 1001 * k * k + 7 * k + 1 for k in range(200)] + [2**63 - 1, -(2**63), -(2**61) - 3]
    rows = fp.with_next(data.frame(spark, [(i, f"t{i}") for i in ids]).select("doc_id", "text"), ["text"], 20).collect()
    order = sorted(ids)
    assert {r.doc_id: r.next_text for r in rows} == {i: f"t{j}" for i, j in zip(order, order[1:] + order[:1])}


def plain_fingerprint(text):
    """One hash a shingle, the least of each bin, and for an empty bin the filled
    one that a hash of both ranks first; the low bytes as hex."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def chain(parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed

    ws = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not ws:
        return ""
    hashes = [chain(ws[i : i + 5]) for i in range(len(ws) - 4)] if len(ws) >= 5 else [chain([b" ".join(ws)])]
    least = {}
    for h in hashes:
        least[h >> 57] = min(h, least.get(h >> 57, h))
    codes = []
    for i in range(128):
        four = lambda k: struct.pack("<i", k)
        rank = lambda b: (signed(chain([four(i), four(b)])) & -256) | (least[b] & 255)
        codes.append(least[i] & 255 if i in least else min(map(rank, least)) & 255)
    return bytes(codes).hex()


def test_fingerprints_by_plain_python(spark, tmp_path):
    pairs = data.rows(3, 50) + [(900, "ümläut wörds and more of them here now")]
    got = fp.fingerprints(data.frame(spark, pairs)).select("text", fp.to_text(F.col("print")).alias("p")).collect()
    assert [r.p for r in got] == [plain_fingerprint(r.text) for r in got]
    query = fp.op2_fingerprints(spark, data.table(spark, pairs, tmp_path)).collect()
    own = Counter((i, plain_fingerprint(t or "")) for i, t in pairs)
    assert Counter((r.doc_id, r.fingerprint) for r in query) == own
    same = lambda a, b: sum(a[k : k + 2] == b[k : k + 2] for k in range(0, 256, 2)) / 128
    for r in query:
        if r.fingerprint and r.edited_fingerprint:
            assert r.near_edited == pytest.approx(max(0.0, (same(r.fingerprint, r.edited_fingerprint) - 1 / 256) / (255 / 256)))


def test_ranges_come_out_even(spark):
    rows = fp.with_next(data.frame(spark, [(i * i, f"t{i}") for i in range(3000)]).select("doc_id", "text"), ["text"], 16)
    assert rows.count() == 3000
    assert {r.doc_id: r.next_text for r in rows.collect()} == {i * i: f"t{(i + 1) % 3000}" for i in range(3000)}
