import cProfile
import pstats
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymill.llm import packing, simhash, tokens
from tallymill.llm.tokens import Words

from . import data

PATH = packing.tokenizer_path()


def print_of(t, k=3):
    w = "".join(c.lower() if c.isascii() else c for c in t).encode()
    ws = w.split()
    parts = [b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(prints, ids, near):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if near(i, j):
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("tile", [simhash.TILE, 3])
def test_components_by_brute_force(spark, tile):
    pairs = data.rows(9, 60)
    rng = random.Random(1)
    base = data.prose(rng, 300).split()
    for k in range(40):  # a chain of near copies
        base[rng.randrange(300)] = "edited"
        pairs.append((5000 + k, " ".join(base)))
    prints = [print_of(t or "") for _, t in pairs]
    want = classes(prints, [i for i, _ in pairs], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    got = simhash.near_duplicates(data.frame(spark, pairs), tile=tile).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter(zip([i for i, _ in pairs], prints, want))
    assert simhash.near_duplicates(data.empty(spark)).count() == 0


def test_forest_keeps_all_connections():
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 12).astype(np.uint64)
    prints = np.unique(np.concatenate([s ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for s in seeds]))
    first = rng.random(len(prints)) < 0.5
    for cut in (np.ones(len(prints), bool), first):
        u, v = simhash.forest(prints, None, cut, simhash.Near())
        pairs = {(a, b) for a in range(len(prints)) for b in range(a) if int(prints[a] ^ prints[b]).bit_count() <= 3 and (cut.all() or cut[a] != cut[b])}
        own = {int(p): i for i, p in enumerate(prints)}
        tree = {(own[int(a)], own[int(b)]) for a, b in zip(u, v)}
        one = classes(list(prints), list(range(len(prints))), lambda i, j: (i, j) in pairs)
        two = classes(list(prints), list(range(len(prints))), lambda i, j: (i, j) in tree or (j, i) in tree)
        assert one == two


def test_similar_copies_are_linked_and_others_left(spark):
    rng = random.Random(6)
    pairs = []
    for k in range(12):
        words = data.prose(rng, 250).split()
        pairs.append((2 * k, " ".join(words)))
        for at in (60, 180):
            words[at] = "changed"
        pairs.append((2 * k + 1, " ".join(words)))
    near = simhash.Near(radius=3, wide=9, similarity=0.77)
    kept = {r.doc_id for r in simhash.keep_one(data.frame(spark, pairs), near).collect()}
    assert {2 * k for k in range(12)} <= kept
    assert len(kept) <= 14


@pytest.mark.parametrize("exact", [None, 0.8])
def test_keep_one_with_awkward_rows(spark, exact):
    pairs = data.rows()
    near = simhash.Near(exact=exact)
    out = simhash.keep_one(data.frame(spark, pairs), near)
    assert out.columns == data.frame(spark, []).columns
    got = Counter((r.doc_id, r.text) for r in out.collect())
    texts = [t or "" for _, t in pairs]
    if exact is None:
        prints = [print_of(t) for t in texts]
        linked = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3
    else:
        sets = [five_words(t) for t in texts]
        linked = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    class_of = classes(texts, range(len(texts)), linked)
    least = {}
    for c, (i, _) in zip(class_of, pairs):
        least[c] = min(least.get(c, (1, 0)), (i is None, i or 0))
    # one row of each class, of its least id (a null one only where there is no other)
    rows = {c: {p for p, q in zip(pairs, class_of) if q == c and (p[0] is None, p[0] or 0) == least[c]} for c in set(class_of)}
    assert sum(got.values()) == len(rows)
    assert all(sum(got[p] for p in of) == 1 for of in rows.values())


def five_words(t):
    w = "".join(c.lower() if c.isascii() else c for c in t).split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


@pytest.mark.parametrize("exact", [None, 0.8])
def test_rows_that_share_an_id_are_told_apart(spark, exact):
    rng = random.Random(12)
    a, b, c = (data.prose(rng, 80) for _ in range(3))
    rows = [(3, a), (9, a), (9, b), (None, c), (None, c), (None, b), (7, c)]
    got = simhash.keep_one(data.frame(spark, rows), simhash.Near(exact=exact)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted([(3, a), (9, b), (7, c)])
    clash = data.frame(spark, rows).withColumn("row_key", F.lit("own")).withColumn("key", F.create_map(F.lit("a"), F.lit(1)))
    got = simhash.keep_one(clash, simhash.Near(exact=exact))
    assert got.columns == clash.columns and {r.row_key for r in got.collect()} == {"own"}
    assert simhash.keep_one(data.empty(spark), simhash.Near(exact=exact)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abzXÀéßÿ×÷ªº²¼µİΣςσ́ \x85\x1c\x00\n\t​漢字😀<|endoftext>'_-.,019"), max_size=40))
def test_word_ids_are_the_tokenizer_s(text):
    words = _words()
    assert words.encode(text) == words._whole(text)


_held = []


def _words():
    if not _held:
        _held.append(Words(PATH, cached=50))
    return _held[0]


def test_common_words_need_no_pattern(monkeypatch):
    class Never:
        def __getattr__(self, name):
            raise AssertionError("a pattern was used")

    words, text = Words(PATH), "Hello, the hello; THE end. naïve Naïve?"
    want = words._whole(text)
    monkeypatch.setattr(tokens, "PIECE", Never())
    assert words.encode(text) == want
    with pytest.raises(AssertionError):
        words.encode("(the)")


def test_births_look_at_pieces_in_bulk():
    """Calls of functions in 16 births over 4,096 pieces."""
    rng = random.Random(5)
    lengths = [min(2048, max(2, int(rng.lognormvariate(6.4, 0.8)))) for _ in range(4096)]
    start = packing.best_fit([], rng.sample(range(4096), 4096), lengths, 2048)
    assert len(start) > -(-sum(lengths) // 2048)
    a, b = start, packing.best_fit([], list(range(4096)), lengths, 2048)
    calls = cProfile.Profile()
    calls.enable()
    for k in range(8):
        packing.fitness(packing.mutate(a, lengths, 2048, random.Random(k)), lengths)
        packing.fitness(packing.crossover(a, b, lengths, 2048, random.Random(k)), lengths)
    calls.disable()
    assert pstats.Stats(calls).total_calls < 500_000  # 774,000 by a look at each piece


def test_packing(spark):
    pairs = data.rows(11, 60)
    got = packing.pack(data.frame(spark, pairs), limit=128, items=16, births=9).collect()
    words = Words(PATH)
    want = Counter()
    total = 0
    for i, t in pairs:
        ids = words._whole(t or "") + b"\0\0\0\0"
        total += len(ids) // 4
        for k, s in enumerate(range(0, len(ids), 512)):
            want[(i, k, s // 4, len(ids[s : s + 512]) // 4, zlib.crc32(ids[s : s + 512]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.02 * total / 128 + 2
    assert packing.pack(data.empty(spark)).count() == 0


def test_genetic_steps_keep_every_piece_once():
    rng = random.Random(2)
    lengths = [rng.randint(1, 60) for _ in range(200)]
    items = sorted(range(200), key=lambda i: -lengths[i])
    a = packing.best_fit([], items, lengths, 64)
    b = packing.best_fit([], items[::-1], lengths, 64)
    for child in (packing.crossover(a, b, lengths, 64, rng), packing.mutate(a, lengths, 64, rng), packing.evolve(lengths, [b], 64, 20, 5, rng)):
        assert sorted(i for x in child for i in x) == list(range(200))
        assert all(sum(lengths[i] for i in x) <= 64 for x in child)
    assert len(packing.evolve(lengths, [b], 64, 20, 5, rng)) <= len(b)


def test_the_search_beats_best_fit_where_there_is_room():
    rng = random.Random(4)
    gains = rooms = 0
    for k in range(12):
        lengths = [min(2048, max(2, int(rng.lognormvariate(6.4, 0.8)))) for _ in range(500)]
        plain = packing.best_fit([], sorted(range(500), key=lambda i: -lengths[i]), lengths, 2048)
        found = packing.evolve(lengths, [], 2048, 96, 6, random.Random(k))
        assert sorted(i for x in found for i in x) == list(range(500))
        assert all(sum(lengths[i] for i in x) <= 2048 for x in found)
        assert len(found) <= len(plain)
        rooms += len(plain) > -(-sum(lengths) // 2048)
        gains += len(found) < len(plain)
    assert rooms >= 3 and gains >= 2


def test_swaps_keep_the_pieces_and_fill_further():
    rng = random.Random(7)
    lengths = [rng.randint(1, 60) for _ in range(120)]
    bins = packing.best_fit([], list(range(100)), lengths, 64)
    out, free = packing.swapped(bins, list(range(100, 120)), lengths, 64)
    assert sorted([i for b in out for i in b] + free) == list(range(120)) and len(out) == len(bins) and len(free) == 20
    assert all(sum(lengths[i] for i in b) <= 64 for b in out)
    assert sum(lengths[i] for i in free) < sum(lengths[100:])
    # by brute force: no free piece is left that could take a shorter one's place
    assert not any(0 < lengths[f] - lengths[i] <= 64 - sum(lengths[j] for j in b) for f in free for b in out for i in b)
    assert packing.swapped([], [1, 2], lengths, 64) == ([], sorted([1, 2], key=lambda i: -lengths[i]))


def test_shards_hold_every_piece_once(spark):
    rows = [(i, 0, 0, 1 + i % 50, i, i // 3) for i in range(1000)]
    df = spark.createDataFrame(rows, packing.PIECE + ", sequence_id bigint")
    for items in (df.drop("sequence_id"), df):
        got = packing.shards(items, 1000, 64).collect()
        tables = [pa.ipc.open_stream(r["rows"]).read_all() for r in got]
        assert sorted(i for t in tables for i in t["doc_id"].to_pylist()) == list(range(1000))
        assert len({r["shard"] for r in got}) == len(got)
        assert all(t.num_rows <= 64 + 2 for t in tables)
    for t in tables:  # sequences stay whole
        assert all(n == min(3, 1000 - 3 * s) for s, n in Counter(i // 3 for i in t["doc_id"].to_pylist()).items())


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        if name in ("quality", "near_duplicates", "personal_data"):
            assert 0.5 * n < docs.count() <= n
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0
