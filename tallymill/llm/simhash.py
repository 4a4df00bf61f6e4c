"""SimHash near-duplicates by tiled exact comparison.

Fingerprints within a radius of r bits agree in one of r + 1 blocks of bits at
least.  Distinct fingerprints are dealt by (block, its value); each such group is
cut into tiles, and tiles are compared pair by pair with numpy exclusive-or and
bit counts, leaving out pairs whose population counts differ by more than the
radius.  A group larger than a tile is dealt as its tile pairs, so no task holds
more than two tiles.  Every tile pair gives a spanning forest of its links (no
more edges than fingerprints), which keeps all connections; connected components
follow by star steps.

Beyond the radius a link can be had by similarity: with ``similar = (r, s)``
fingerprints within r bits are linked too if sketches of their texts' five-word
shingles (one-permutation MinHash) agree in a share of s or more.

Edge cases: null text counts as empty; texts without words have fingerprint 0
and are linked like others; fewer words than a shingle are one shingle; equal
fingerprints are one node, however many rows have them; null ids belong to
components but never name one unless nothing else can; empty tables give empty
results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import LOWER, grouped, per_batch, texts_of
from .common import cut, fresh, joined, read, row_key
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
TILE, STRIP, AT_ONCE = 65536, 64, 1 << 16
SKETCH_SHINGLE, BINS = 5, 128
#: Rank of every bin for every empty one that looks for a filled bin.
RANKS = np.random.default_rng(SEED).random((BINS, BINS))


def _hashes(ws: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Hashes of word shingles, in arrays of bounded size."""
    n = max(len(ws) - shingle + 1, 1)
    for at in range(0, n, 1 << 16):
        parts = zip(*[ws[at + k : min(at + (1 << 16), n) + k] for k in range(shingle)]) if len(ws) >= shingle else [ws]
        yield np.array([xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in parts], dtype="<u8")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def fingerprint(ws: list[bytes], shingle: int = SHINGLE) -> int:
    """The 64 majority bits of the hashes of word shingles."""
    if not ws:
        return 0
    ones, n = np.zeros(64, np.int64), max(len(ws) - shingle + 1, 1)
    for hashes in _hashes(ws, shingle):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def sketch(ws: list[bytes]) -> bytes:
    """The low byte of the least shingle hash of each bin."""
    if not ws:
        return bytes(BINS)
    least = np.full(BINS, np.iinfo(np.uint64).max)
    for hashes in _hashes(ws, SKETCH_SHINGLE):
        np.minimum.at(least, (hashes >> np.uint64(57)).astype(np.int64), hashes)
    filled = np.flatnonzero(least != np.iinfo(np.uint64).max)
    if len(filled) == 0:
        filled = np.array([BINS - 1])
    source = np.arange(BINS)
    empty = np.setdiff1d(source, filled)
    source[empty] = filled[RANKS[empty][:, filled].argmin(axis=1)]
    return (least[source] & np.uint64(255)).astype(np.uint8).tobytes()


def _prints(batch: pa.RecordBatch, shingle: int, sketched: bool) -> dict:
    texts = [words_of(t) for t in texts_of(batch)]
    prints = np.array([fingerprint(ws, shingle) for ws in texts], dtype=np.uint64)
    out = {"doc_id": batch.column("doc_id"), "fp": prints.view(np.int64)}
    return out | ({"sketch": pa.array([sketch(ws) for ws in texts], pa.binary())} if sketched else {})


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, sketched: bool = False) -> DataFrame:
    """(doc_id, fp and, if asked for, sketch), fp as a signed 64-bit integer."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint" + ", sketch binary" * sketched
    return per_batch(docs.select("doc_id", "text"), _prints, schema, shingle, sketched)


@dataclass(frozen=True)
class Near:
    """Which fingerprints are linked: within radius bits, or within wide bits
    with sketches that agree in a share of similarity.  With exact, keep_one
    links texts by the exact similarity of their shingles (see similar)."""

    radius: int = RADIUS
    wide: int = 0
    similarity: float = 1.0
    exact: float | None = None

    @property
    def reach(self) -> int:
        return max(self.radius, self.wide)


def forest(prints: np.ndarray, sketches: np.ndarray | None, first: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links in a tile (first is all true), or
    between two tiles (first tells the one from the other).

    Fingerprints are sorted by population count; a strip of one tile is compared
    only with the stretch of the other whose counts can be near enough."""
    label, counts = np.arange(len(prints)), np.bitwise_count(prints).astype(int)
    order = np.argsort(counts, kind="stable")
    alone = first.all()
    one, two = (order, order) if alone else (order[first[order]], order[~first[order]])
    for s in range(0, len(one), STRIP):
        strip = one[s : s + STRIP]
        lo = s if alone else np.searchsorted(counts[two], counts[strip[0]] - near.reach)
        hi = np.searchsorted(counts[two], counts[strip[-1]] + near.reach, "right")
        if hi <= lo:
            continue
        apart = np.bitwise_count(prints[strip][:, None] ^ prints[two[lo:hi]][None, :])
        i, j = np.nonzero(apart <= near.radius)
        label = _united(label, strip[i], two[lo + j])
        if near.wide > near.radius:
            i, j = np.nonzero((apart > near.radius) & (apart <= near.wide))
            for at in range(0, len(i), AT_ONCE):
                u, v = strip[i[at : at + AT_ONCE]], two[lo + j[at : at + AT_ONCE]]
                u, v = u[new := label[u] != label[v]], v[new]
                like = (sketches[u] == sketches[v]).mean(axis=1) >= near.similarity
                label = _united(label, u[like], v[like])
    at = np.flatnonzero(label != np.arange(len(label)))
    return prints[at], prints[label[at]]


def _united(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """label, the least member of each one's class, with the links u - v added."""
    while len(open_ := np.flatnonzero(label[u] != label[v])):
        u, v = u[open_], v[open_]
        label = label.copy()
        a, b = label[u], label[v]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]
    return label


def _links(batches: Iterator[pa.RecordBatch], near: Near) -> Iterator[pa.RecordBatch]:
    for table in grouped(batches, "pair"):
        pair, first = table["pair"].to_numpy(), table["side"].to_numpy() == 0
        fp = table["fp"].to_numpy().view(np.uint64)
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, BINS) if near.wide else None
        edges = np.flatnonzero(np.diff(pair)) + 1
        found = [forest(fp[s:e], sketches[s:e] if near.wide else None, first[s:e], near) for s, e in zip([0, *edges], [*edges, len(pair)]) if e - s > 1]
        if found:
            columns = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found)]
            yield pa.RecordBatch.from_arrays(columns, names=["u", "v"])


def _tiled(dealt: DataFrame, radius: int, tile: int) -> DataFrame:
    """(pair, side, fp) from (group, pc, fp): small groups as they are, larger
    ones as the pairs of their tiles (population count, salt) that can hold
    links."""
    sizes = dealt.groupBy("group", "pc").agg(F.count(F.lit(1)).alias("n"))
    big = sizes.groupBy("group").agg(F.sum("n").alias("all")).where(F.col("all") > tile).select(F.col("group").alias("g"))
    kept = [c for c in ("fp", "sketch") if c in dealt.columns]
    whole = lambda df: df.select(F.xxhash64("group").alias("pair"), F.lit(0).alias("side"), *kept)
    big = cut(big)  # at most one row for each value of a block
    if big.isEmpty():
        return whole(dealt)
    salted = sizes.join(big, F.col("group") == F.col("g"), "left_semi").withColumn("salts", F.ceil(F.col("n") / tile).cast("int"))
    tiles = salted.select("group", "pc", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    x, y = tiles.alias("x"), tiles.alias("y")
    near = (F.col("x.group") == F.col("y.group")) & (F.struct("x.pc", "x.salt") <= F.struct("y.pc", "y.salt")) & (F.col("y.pc") - F.col("x.pc") <= radius)
    pairs = x.join(y, near).select(
        F.col("x.group").alias("g"), F.xxhash64("x.group", "x.pc", "x.salt", "y.pc", "y.salt").alias("pair"),
        F.array_distinct(F.array(F.struct("x.pc", "x.salt"), F.struct("y.pc", "y.salt"))).alias("of"),
    )
    sides = pairs.select("g", "pair", F.posexplode("of").alias("side", "t")).select("g", "pair", "side", F.col("t.pc").alias("p"), F.col("t.salt").alias("s"))
    keyed = dealt.join(salted.select(F.col("group").alias("g"), F.col("pc").alias("p"), "salts"), (F.col("group") == F.col("g")) & (F.col("pc") == F.col("p")))
    keyed = keyed.select("group", "pc", *kept, F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int").alias("salt"))
    cross = keyed.join(sides, (F.col("group") == F.col("g")) & (F.col("pc") == F.col("p")) & (F.col("salt") == F.col("s"))).select("pair", "side", *kept)
    return whole(dealt.join(big, F.col("group") == F.col("g"), "left_anti")).unionByName(cross)


def links(nodes: DataFrame, near: Near = Near(), tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect whatever fingerprints fp of nodes are linked;
    nodes has sketches where near goes by them."""
    blocks = near.reach + 1
    edges = [64 * b // blocks for b in range(blocks + 1)]

    def value(b: int) -> Column:
        low, width = edges[b], edges[b + 1] - edges[b]
        part = F.shiftrightunsigned("fp", low) if low else F.col("fp")
        return F.struct(F.lit(b).alias("b"), (part.bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else part).alias("v"))

    group = F.explode(F.array(*[value(b) for b in range(blocks)])).alias("group")
    dealt = nodes.select("fp", *["sketch"] * (near.wide > 0), F.bit_count("fp").alias("pc"), group)
    rows = _tiled(dealt, near.reach, tile)
    return rows.repartition("pair").sortWithinPartitions("pair").mapInArrow(lambda it: _links(it, near), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, near: Near = Near(), tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): a component's id is its least doc_id."""
    prints = cut(fingerprints(docs, shingle, near.wide > 0))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    compared = prints.select("fp", "sketch").distinct() if near.wide else nodes
    roots = components(links(compared, near, tile))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    held = cut(members.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "least"))
    named = held.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    classes = joined(held.select("fp", "root"), named, "root", held.count()).select("fp", "component_id")
    table = nodes.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n")
    return joined(prints.select("doc_id", "fp"), table, "fp", prints.count()).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, near: Near) -> DataFrame:
    """One row of docs for each class of near duplicates: the one of least doc_id
    (a null id comes last), of rows that share the id any one, always the same.
    Classes are those of texts, so rows that share an id but not a text are told
    apart, rows without an id are compared like others, and equal rows are one."""
    from .similar import similar  # which builds on this module

    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs))
    texts = keyed.select(F.col(key).alias("key"), "text")
    if near.exact is None:
        found = near_duplicates(texts.withColumnRenamed("key", "doc_id"), near=near).select(F.col("doc_id").alias("key"), F.col("component_id").alias("class"))
    else:
        found = similar(texts, near)
    found = cut(found)
    kept = found.groupBy("class").agg(F.min("key").alias("key")).select("key")
    counted = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(kept.withColumn("stays", F.lit(True)), "key", "left")
    marked = cut(counted.where("stays IS NULL OR n > 1").select(F.col("key").alias(key), "stays"))
    stay = keyed.join(marked.select(key), key, "left_anti")
    repeated = marked.where("stays").select(key)
    if not repeated.isEmpty():  # equal rows are one: only they are brought together
        stay = stay.unionByName(keyed.join(repeated, key, "left_semi").dropDuplicates([key]))
    return stay.drop(key)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
