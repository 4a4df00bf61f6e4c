"""Near duplicates by exact similarity: texts whose sets of five-word shingles
have a Jaccard similarity of at least a bound are linked.

Proposals come first, cheaply and with room to spare: texts are proposed to each
other if their SimHash fingerprints lie within a few bits, or if they agree in a
whole band of MinHash values (BANDS bands of ROWS independent values; a pair of
similarity 0.8 shares no band with probability 1.1e-4, one of 0.85 with 2.6e-7).
A group of proposals is tied to its least text, the hub.  Sketches, a byte of each
MinHash value, then tell which ties hold: only texts whose sketches agree in LOW
or more (0.8 is five standard errors above that) are joined.  A text that agrees
with its hub in less than SURE could be like another text of the group and unlike
the hub, so these are compared with each other, by sketches and in tiles.  Pages
of one template, which share bands but are unlike, fall apart here.

What is joined are clusters.  Within a cluster every pair is compared exactly
unless it is connected already or the sizes of its sets rule it out; no proposal
counts as a link by itself.  A cluster larger than a tile is dealt as its tile
pairs, so no task holds more than two tiles.

Edge cases: null text counts as empty; fewer words than a shingle are one
shingle; texts with equal sets are one node; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import grouped, per_batch, texts_of
from .common import cut, joined, released
from .components import components
from .simhash import SEED, SKETCH_SHINGLE, Near, _hashes, _united, fingerprint, links, words_of

BANDS, ROWS, TILE = 30, 6, 512
#: Agreement of sketches that joins two texts, and that settles a text; sketches in a tile.
LOW, SURE, SKETCHES = 0.65, 0.9, 4096
#: Bands shared that join two texts without a look at sketches (a similarity of 0.65 shares as
#: many with probability 0.002, and what is joined is compared exactly), and that settle a text.
MANY, MOST = 8, 20
_random = np.random.default_rng(SEED)
#: Odd factors and addends of the MinHash values, and what joins a band's values to its key.
TIMES, PLUS = (_random.integers(0, 2**64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64))
JOIN, BAND = _random.integers(0, 2**64, ROWS, np.uint64) | np.uint64(1), _random.integers(0, 2**64, BANDS, np.uint64)


def shingle_set(ws: list[bytes]) -> np.ndarray:
    """The different hashes of five-word shingles, sorted."""
    return np.unique(np.concatenate(list(_hashes(ws, SKETCH_SHINGLE))))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[at : at + 1024, None] * TIMES + PLUS).min(axis=0))
    return least >> np.uint64(7)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands don't meet."""
    return _keys(min_hashes(hashes))


def _keys(least: np.ndarray) -> np.ndarray:
    return (least.reshape(BANDS, ROWS) * JOIN).sum(axis=1, dtype=np.uint64) ^ BAND


def _described(batch: pa.RecordBatch) -> dict:
    words = [words_of(t) for t in texts_of(batch)]
    sets = [shingle_set(ws) for ws in words]
    node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
    prints = np.array([fingerprint(ws) for ws in words], np.uint64)
    least = [min_hashes(s) for s in sets]
    keys = np.concatenate([_keys(x) for x in least]).view(np.int64)
    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS, dtype=np.int32)), pa.array(keys))
    sketch = pa.array([x.astype(np.uint8).tobytes() for x in least], pa.binary())
    return {"key": batch.column("key"), "node": node.view(np.int64), "fp": prints.view(np.int64), "bands": bands, "sketch": sketch}


def _agreement(batch: pa.RecordBatch) -> dict:
    one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("one", "two"))
    return {"u": batch.column("u"), "v": batch.column("v"), "like": (one == two).mean(axis=1)}


def _alike(batches: Iterator[pa.RecordBatch], low: float) -> Iterator[pa.RecordBatch]:
    """Edges that connect the nodes of a tile pair whose sketches agree."""
    for table in grouped(batches, "pair"):
        pair, side, node = table["pair"].to_numpy(), table["side"].to_numpy(), table["node"].to_numpy()
        cuts = np.flatnonzero(np.diff(pair)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(pair)]):
            sketch = np.frombuffer(b"".join(table["sketch"].slice(s, e - s).to_pylist()), np.uint8).reshape(e - s, -1)
            label, first = np.arange(e - s), side[s:e] == 0
            one, rest = np.flatnonzero(first), np.flatnonzero(~first)
            for k, i in enumerate(one):
                other = one[k + 1 :] if first.all() else rest
                other = other[label[other] != label[i]]
                if len(other):
                    like = other[(sketch[other] == sketch[i]).mean(axis=1) >= low]
                    label = _united(label, np.full(len(like), i), like)
            at = np.flatnonzero(label != np.arange(e - s))
            yield pa.RecordBatch.from_arrays([pa.array(node[s:e][at]), pa.array(node[s:e][label[at]])], names=["u", "v"])


def in_tiles(members: DataFrame, group: str, tile: int) -> DataFrame:
    """members, each once for every pair of tiles of its group that it is in, with
    pair and side (0 or 1), dealt by pairs and sorted; no group is in one task."""
    large = members.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > tile).select("__g", F.ceil(F.col("__n") / tile).cast("int").alias("tiles"))
    salted = members.join(large, F.col(group) == F.col("__g"), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pair = F.xxhash64(group, F.least("salt", "other"), F.greatest("salt", "other"))
    rows = dealt.select(pair.alias("pair"), (F.col("salt") > F.col("other")).cast("int").alias("side"), *[c for c in members.columns if c != group])
    return rows.repartition("pair").sortWithinPartitions("pair")


def proposals(rows: DataFrame, near: Near) -> DataFrame:
    """Edges (u, v) of nodes that connect whatever may be linked: ties of groups of
    equal bands or near fingerprints to their hubs, where sketches agree, and
    those between texts that their hub doesn't settle."""
    nodes = cut(rows.groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    banded = nodes.select("node", F.explode("bands").alias("band"))
    least = lambda df, by: df.groupBy(by).agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n"))
    hubs = least(banded, "band").where("n > 1")
    by_band = joined(banded, hubs, "band", BANDS * nodes.count()).select(F.col("node").alias("u"), "v")
    printed = cut(rows.select("node", "fp").distinct())
    own = least(printed, "fp")
    by_print = joined(printed, own.where("n > 1"), "fp", printed.count()).select(F.col("node").alias("u"), "v")
    close = links(own.select("fp"), Near(near.radius))
    one = own.select(F.col("fp").alias("f"), F.col("v").alias("n"))
    two = own.select(F.col("fp").alias("g"), F.col("v").alias("m"))
    by_bits = close.join(one, F.col("u") == F.col("f")).join(two, F.col("v") == F.col("g")).select(F.col("n").alias("u"), F.col("m").alias("v"))
    bands = by_band.where("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("shared"))
    printed_ties = by_print.unionByName(by_bits).where("u <> v").select("u", "v", F.lit(0).cast("bigint").alias("shared"))
    every = cut(bands.unionByName(printed_ties).groupBy("u", "v").agg(F.max("shared").alias("shared")))
    # many equal bands tell as much as a sketch, which then need not travel
    plain = every.where(F.col("shared") >= MANY).select("u", "v", F.when(F.col("shared") >= MOST, 1.0).otherwise(LOW).alias("like"))
    ties = every.where(F.col("shared") < MANY).select("u", "v")
    sketches = nodes.select("node", "sketch")
    hub = ties.groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(sketches.withColumnRenamed("sketch", "two"), F.col("v") == F.col("node")).select("v", "n", "two")
    both = joined(ties.join(sketches.withColumnRenamed("sketch", "one"), F.col("u") == F.col("node")).select("u", "v", "one"), hub, "v", ties.count())
    measured = cut(per_batch(both, _agreement, "u bigint, v bigint, like double").unionByName(plain))
    unsure = measured.where(F.col("like") < SURE).select(F.col("v").alias("hub"), F.col("u").alias("node"))
    several = unsure.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = joined(unsure, several, "hub", unsure.count()).join(sketches, "node").select("hub", "node", "sketch")
    alike = in_tiles(crowd, "hub", SKETCHES).mapInArrow(lambda it: _alike(it, LOW), "u bigint, v bigint")
    return measured.where(F.col("like") >= LOW).select("u", "v").unionByName(alike).distinct()


def forest(sets: list[np.ndarray], first: np.ndarray, bound: float) -> np.ndarray:
    """The least member of each set's class, where sets of a Jaccard similarity
    of bound or more are linked: all pairs if first is all true, else the pairs
    of one that is first and one that isn't."""
    label, sizes = np.arange(len(sets)), np.array([len(s) for s in sets])
    one = np.flatnonzero(first)
    for k, i in enumerate(one):
        other = one[k + 1 :] if first.all() else np.flatnonzero(~first)
        other = other[label[other] != label[i]]
        small, large = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
        other = other[small >= bound * large]
        for at in range(0, len(other), 64):
            some = other[at : at + 64]
            flat = np.concatenate([sets[j] for j in some])
            place = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
            both = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
            like = some[both >= bound * (sizes[some] + sizes[i] - both)]
            label = _united(label, np.full(len(like), i), like)
    return label


def _confirmed(batches: Iterator[pa.RecordBatch], bound: float) -> Iterator[pa.RecordBatch]:
    for table in grouped(batches, "pair"):
        pair, first, node = table["pair"].to_numpy(), table["side"].to_numpy() == 0, table["node"].to_numpy()
        edges = np.flatnonzero(np.diff(pair)) + 1
        for s, e in zip([0, *edges], [*edges, len(pair)]):
            if e - s > 1:
                sets = [shingle_set(words_of(t or "")) for t in table["text"].slice(s, e - s).to_pylist()]
                label = forest(sets, first[s:e], bound)
                at = np.flatnonzero(label != np.arange(e - s))
                yield pa.RecordBatch.from_arrays([pa.array(node[s:e][at]), pa.array(node[s:e][label[at]])], names=["u", "v"])


def confirmed(members: DataFrame, bound: float, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect whatever is linked within the clusters of
    members (root, node, text)."""
    return in_tiles(members, "root", tile).mapInArrow(lambda it: _confirmed(it, bound), "u bigint, v bigint")


def similar(docs: DataFrame, near: Near, tile: int = TILE) -> DataFrame:
    """(key, class) of docs (key, text), where rows of one key have one text:
    equal classes are connected by texts of a similarity of near.exact or more."""
    rows = cut(per_batch(docs.select("key", "text"), _described, "key string, node bigint, fp bigint, bands array<bigint>, sketch binary"))
    roots = cut(components(proposals(rows, near)))
    released(docs.sparkSession)
    every = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    held = cut(rows.groupBy("node").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")))
    chosen = every.join(held, "node").select("root", "node", "key")
    texts = docs.select("key", "text").join(chosen, "key").dropDuplicates(["key"]).select("root", "node", "text")
    found = components(confirmed(texts, near.exact, tile))
    classes = held.select("node", "n").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("class"), "n")
    return joined(rows.select("key", "node"), classes, "node", rows.count()).select("key", "class")
