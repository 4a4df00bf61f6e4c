"""Conversation prefix tries: level-order (LOUDS) tries over shards of sorted
conversations.

A conversation is a path of turn keys.  Paths are dealt by ranges of their order,
so that a prefix's conversations lie together, and a common prefix or path is
spread over as many shards as it needs.  Each shard becomes a trie: a bit vector
with a one for each child and a zero after each node, in level order, and label
arrays in that order; parents are found by rank and select on it, and sums run
from the last level up with add.at.  Only nodes on a shard's first and last path
can have members in other shards.  What a shard knows of these heavy upper levels
goes on as two rows of sums by level, which are dealt and merged in the same way,
shard by shard, until one shard is left.  All other nodes are done at once.

Edge cases: turns are ordered by turn, nulls first, then by role and by a hash of
the turn; repeated rows are repeated turns; null role and text are empty; rows
without a conv_id belong to no conversation and are left out; a conversation
rebuilt without turns ends at the root; an empty table has no nodes; other
columns are not read.  A conversation's turn keys, not its texts, meet in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, joined, read

#: Bytes of a turn's key: the front of a SHA-256, so equal for equal turns only.
KEY = 16
HEADS, EVERY = 6, 100
#: Turns of a shard: at least as many, about, but for the last, and at most.
FEW, TURNS = 10_000, 1_000_000
#: Conversations in a row of ids.
IDS = 8192
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: Sums of a node, without what its unfinished children will add.
SUMS = ("n", "kids", "leaves", "saved", "least")
_PATH = "key binary, chars binary, conv_id bigint, " + ", ".join(f"{s} binary" for s in SUMS)
_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, own binary, parent binary"
#: kind: a finished node, a path of unfinished ones, or conversations that end at one.
_FOUND = f"kind int, {_NODE}, key binary, chars binary, {', '.join(f'{s} binary' for s in SUMS)}, ids string"


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the conversation's turns in order, as structs of a key
    and the number of code points of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    key = F.unhex(F.substring(digest, 1, 2 * KEY))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", role.alias("role"), key.alias("key"), F.length(text).alias("chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, heads: int = HEADS, every: int = EVERY) -> DataFrame:
    """(conv_id, key, chars): the first h turns of conversation c - c % every, then
    c's own after its first h; h is crc32(c) % heads.  At most 2 * every rows meet one head."""
    first = convs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("__root"), F.slice("turns", 1, heads - 1).alias("__head"))
    rows = convs.withColumn("__root", F.col("conv_id") - F.col("conv_id") % every).join(first, "__root", "left")
    h = F.crc32(F.col("conv_id").cast("string")) % heads

    def front(xs: Column, n: Column) -> Column:
        return F.slice(xs, F.lit(1), n.cast("int"))

    own = F.slice("turns", (h + 1).cast("int"), F.greatest(F.size("turns") - h, F.lit(0)).cast("int"))
    head = F.coalesce(F.col("__head"), F.slice("turns", 1, 0))
    whole = rows.select("conv_id", F.concat(front(head, h), own).alias("turns"))
    return whole.select("conv_id", _joined_bytes(F.transform("turns", lambda t: t["key"])).alias("key"), _joined_bytes(F.transform("turns", lambda t: F.unhex(F.lpad(F.hex(t["chars"]), 8, "0")))).alias("chars"))


def _joined_bytes(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


class Trie:
    """A level-order trie of sorted paths, given by their joined keys.

    louds: the packed bit vector, 1 for each child of a node and 0 after them, in
    level order from the root; n_bits of it count.  level[d] is the first node of
    depth d; label[k] is node k's turn key as two unsigned integers."""

    def __init__(self, keys: list[bytes]) -> None:
        self.size = np.array([len(k) // KEY for k in keys], np.int64)
        at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        items = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 2)
        shared = _shared(self.size, at, items)
        deep, n = int(self.size.max(initial=0)), len(keys)
        #: The row that first shows each node, level by level; a level has the rows that reach it.
        self.first = [np.zeros(min(n, 1), np.int64)] + [np.flatnonzero((self.size >= d) & (shared < d)) for d in range(1, deep + 1)]
        self.level = np.concatenate([[0], np.cumsum([len(f) for f in self.first])])
        self.label = np.concatenate([np.zeros((1, 2), np.uint64), *[items[at[f] + d - 1] for d, f in enumerate(self.first) if d]])
        degree = np.zeros(self.level[-1], np.int64)
        for d in range(1, deep + 1):
            np.add.at(degree, self.node(d - 1, self.first[d]), 1)
        bits = np.ones(int(degree.sum()) + len(degree), bool)
        bits[np.cumsum(degree + 1) - 1] = False
        self.n_bits, self.louds = len(bits), np.packbits(bits)

    def node(self, depth: int, rows: np.ndarray) -> np.ndarray:
        """The nodes of a depth on the paths of the rows, which reach it."""
        return self.level[depth] + np.searchsorted(self.first[depth], rows, "right") - 1

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.louds, count=self.n_bits)

    def parents(self) -> np.ndarray:
        """The parent of every node but the root: the j-th one (select) stands
        after as many zeros (rank) as there are nodes before its parent."""
        ones = np.flatnonzero(self.bits())
        return ones - np.arange(len(ones))

    def find(self, key: bytes) -> int:
        """The node of a prefix, or -1, by going down the bit vector."""
        ends, node = np.flatnonzero(self.bits() == 0), 0
        for label in np.frombuffer(key, ">u8").reshape(-1, 2):
            from_, to = (ends[node - 1] + 1 if node else 0), ends[node]
            children = np.arange(from_, to) - node + 1
            hit = np.flatnonzero((self.label[children] == label).all(axis=1))
            if not len(hit):
                return -1
            node = int(children[hit[0]])
        return node


def _shared(size: np.ndarray, at: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Turns that each path has in common with the one before; -1 for the first."""
    shared = np.zeros(len(size), np.int64)
    live = np.arange(1, len(size))
    while len(live):
        d = int(shared[live[0]])
        live = live[(size[live] > d) & (size[live - 1] > d)]
        live = live[(items[at[live] + d] == items[at[live - 1] + d]).all(axis=1)]
        shared[live] += 1
    shared[:1] = -1
    return shared


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:KEY]


def _shard(rows: pa.Table, final: bool) -> Iterator[dict]:
    """Column lists of _FOUND for one shard's sorted rows: conversations (conv_id)
    or paths of unfinished nodes with sums for each level (n, kids, ...)."""
    keys = rows["key"].to_pylist()
    trie = Trie(keys)
    n_nodes, size = int(trie.level[-1]), trie.size
    sums = {s: np.full(n_nodes, NONE if s == "least" else 0, np.int64) for s in SUMS}
    chars = np.zeros(n_nodes, np.int64)
    lengths = np.frombuffer(b"".join(rows["chars"].to_pylist()), ">u4").astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    whole = rows["conv_id"].is_valid().to_numpy()
    single, many = np.flatnonzero(whole), np.flatnonzero(~whole)
    ids = rows["conv_id"].drop_null().to_numpy()
    levels = {s: np.frombuffer(b"".join(x for x in rows[s].to_pylist() if x), np.int64) for s in SUMS}
    starts = np.concatenate([[0], np.cumsum(size[many] + 1)])
    last = np.empty(len(single), np.int64)
    for d in range(len(trie.first)):
        node = trie.node(d, trie.first[d])
        if d:
            chars[node] = lengths[at[trie.first[d]] + d - 1]
        ending = np.flatnonzero(size[single] == d)
        last[ending] = trie.node(d, single[ending])
        reach = np.flatnonzero(size[many] >= d)
        for s in SUMS:
            (np.minimum if s == "least" else np.add).at(sums[s], trie.node(d, many[reach]), levels[s][starts[reach] + d])
    np.add.at(sums["n"], last, 1)
    np.minimum.at(sums["least"], last, ids)
    # nodes on the first and the last path may have members elsewhere
    open_ = np.zeros(n_nodes, bool)
    edges = [] if final else [0] + ([len(keys) - 1] if keys[-1] != keys[0] else [])
    sides = [np.array([int(trie.node(d, np.array([r]))[0]) for d in range(size[r] + 1)]) for r in edges]
    for side in sides:
        open_[side] = True
    parent = trie.parents()
    for d in range(len(trie.first) - 1, 0, -1):
        own = np.arange(trie.level[d], trie.level[d + 1])
        _close(own[~open_[own]], sums, chars)
        own = own[~open_[own]]
        up = parent[own - 1]
        np.add.at(sums["n"], up, sums["n"][own])
        np.add.at(sums["kids"], up, 1)
        np.add.at(sums["leaves"], up, sums["leaves"][own])
        np.add.at(sums["saved"], up, sums["saved"][own])
        np.minimum.at(sums["least"], up, sums["least"][own])
    _close(np.flatnonzero(~open_[:1]), sums, chars)
    # ids of the conversations that end at a node: rows of one path lie together, by id
    order = np.argsort(last, kind="stable")
    cuts = np.flatnonzero(np.diff(last[order])) + 1
    runs = [r for r in np.split(order, cuts) if len(r)]
    ends = {int(last[r[0]]): ids[r] for r in runs}
    depth = np.repeat(np.arange(len(trie.first)), np.diff(trie.level))
    row_of = np.concatenate(trie.first)
    prefix = lambda k: _digest(keys[row_of[k]][: KEY * int(depth[k])])
    done = np.flatnonzero(~open_)
    if len(done):
        up = np.where(done > 0, parent[done - 1], -1) if n_nodes > 1 else np.full(len(done), -1)
        known = (up >= 0) & ~open_[up]
        refs = {int(k): prefix(int(k)) for k in np.unique(up[(up >= 0) & ~known])}
        merged = len(many) > 0
        yield {
            "kind": [0] * len(done), "conv_id": sums["least"][done].tolist(), "depth": depth[done].tolist(),
            "parent_conv_id": [int(sums["least"][u]) if k else None for u, k in zip(up, known)],
            "n_convs": sums["n"][done].tolist(), "n_children": sums["kids"][done].tolist(), "n_leaves": sums["leaves"][done].tolist(), "saved_tokens": sums["saved"][done].tolist(),
            "ends_sha256": [hashlib.sha256(",".join(map(str, ends[k].tolist())).encode()).hexdigest() if k in ends else NO_ENDS for k in done.tolist()],
            "own": [prefix(k) for k in done.tolist()] if merged else [None] * len(done),
            "parent": [refs.get(int(u)) for u in up],
        }
    counted: set[int] = set()
    for r, side in zip(edges, sides):
        new = np.array([k not in counted for k in side.tolist()])
        counted.update(side.tolist())
        row = {"kind": [1], "key": [keys[r]], "chars": [rows["chars"][r].as_py()]}
        for s in SUMS:
            row[s] = [np.where(new, sums[s][side], NONE if s == "least" else 0).astype(np.int64).tobytes()]
        yield row
    for k in sorted(counted & set(ends)):
        for a in range(0, len(ends[k]), IDS):
            part = ends[k][a : a + IDS]
            yield {"kind": [2], "own": [prefix(k)], "conv_id": [int(part[0])], "ids": [",".join(map(str, part.tolist()))]}


def _close(nodes: np.ndarray, sums: dict[str, np.ndarray], chars: np.ndarray) -> None:
    """What a node adds for itself once its members and children are known."""
    sums["leaves"][nodes] += sums["kids"][nodes] == 0
    sums["saved"][nodes] += (sums["n"][nodes] - 1) * chars[nodes]


def _tries(rows: DataFrame, shards: int) -> DataFrame:
    """One round: rows (_PATH) dealt by ranges into tries; all in one if shards is 1."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string as parsed

    schema, final = to_arrow_schema(parsed(_FOUND)), shards == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            for found in _shard(pa.Table.from_batches(held), final):
                n = len(found["kind"])
                yield pa.RecordBatch.from_arrays([pa.array(found.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    dealt = rows.coalesce(1) if final else rows.repartitionByRange(shards, "key", "conv_id")
    return cut(dealt.sortWithinPartitions("key", "conv_id").mapInArrow(run, _FOUND))


def _end_hashes(parts: DataFrame) -> DataFrame:
    """(own, sha) from rows of ids: a node's rows go through one hash in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for own, ids in zip(batch.column("own").to_pylist(), batch.column("ids").to_pylist()):
                if own == now:
                    state.update(b",")
                elif now is not None:
                    done.append((now, state.hexdigest()))
                    state = hashlib.sha256()
                now = own
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["own", "sha"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["own", "sha"])

    return parts.repartition("own").sortWithinPartitions("own", "conv_id").select("own", "ids").mapInArrow(run, "own binary, sha string")


def _shards(rows: DataFrame, few: int, turns: int) -> int:
    """Enough to keep the cluster busy, and as many as memory asks for."""
    weight = rows.agg(F.coalesce(F.sum(F.octet_length("key") / KEY + 1), F.lit(0))).first()[0]
    busy = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(busy, int(-(-weight // few))), int(-(-weight // turns)))


def nodes(convs: DataFrame, few: int = FEW, turns: int = TURNS) -> DataFrame:
    """Every node of the trie over (conv_id, key, chars), one row for each."""
    empty = [F.lit(None).cast("binary").alias(s) for s in SUMS]
    rows = cut(convs.select("key", "chars", "conv_id", *empty))
    shards, rounds = _shards(rows, few, turns), []
    while True:
        rounds.append(found := _tries(rows, shards))
        if shards == 1:
            break
        rows = found.where("kind = 1").select("key", "chars", F.lit(None).cast("bigint").alias("conv_id"), *SUMS)
        shards = min(shards // 2, _shards(rows, few, turns))
    columns = [c.split()[0] for c in _NODE.split(", ")]
    every = [r.where("kind = 0").select(columns) for r in rounds]
    if len(rounds) == 1:
        return every[0].drop("own", "parent")
    ends = _end_hashes(rounds[0].where("kind = 2").select("own", "conv_id", "ids"))
    upper = every[1]
    for r in every[2:]:
        upper = upper.unionByName(r)
    upper = cut(upper.join(ends, "own", "left").withColumn("ends_sha256", F.coalesce("sha", "ends_sha256")).drop("sha"))
    all_ = every[0].unionByName(upper)
    waiting = all_.where("parent IS NOT NULL").drop("parent_conv_id")
    parents = upper.select(F.col("own").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    met = joined(waiting, parents, "parent", upper.agg(F.sum("n_children")).first()[0])
    return all_.where("parent IS NULL").drop("own", "parent").unionByName(met.drop("own", "parent"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(rebuilt(paths(read(spark, sf_dir, "conversations"))))



#: crc32 bit by bit; every node is a string of hexadecimal turn keys.
OP13_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), {2 * KEY}) AS key
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list({{'key': key, 'chars': length(text)}} ORDER BY turn NULLS FIRST, role, key) AS turns,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8 * length(conv_id::VARCHAR)), lambda i: ((ord(substr(conv_id::VARCHAR, (i // 8 + 1)::INT, 1)) >> (i % 8)::INT) & 1)::BIGINT)),
             lambda acc, bit: xor(acc >> 1, CASE WHEN xor(acc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END))) % {HEADS} AS h
  FROM turns GROUP BY conv_id
), whole AS (
  SELECT c.conv_id, list_concat(coalesce(r.turns, [])[:c.h], c.turns[c.h + 1 :]) AS turns
  FROM convs c LEFT JOIN convs r ON r.conv_id = c.conv_id - c.conv_id % {EVERY}
), keyed AS (SELECT conv_id, turns, array_to_string(list_transform(turns, lambda t: t.key), '') AS key, len(turns) AS size FROM whole
), members AS (
  SELECT conv_id, key, size, d, left(key, {2 * KEY} * d) AS node, CASE WHEN d = 0 THEN 0 ELSE turns[d].chars END AS chars
  FROM (SELECT *, unnest(range(size + 1)) AS d FROM keyed)
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256
  FROM members GROUP BY node, d
), kids AS (
  SELECT p.node, p.d, p.conv_id, p.n_convs, p.saved, p.ends_sha256, count(c.node) AS n_children
  FROM nodes p LEFT JOIN nodes c ON c.d = p.d + 1 AND left(c.node, {2 * KEY} * p.d) = p.node GROUP BY ALL
), sums AS (
  SELECT left(node, {2 * KEY} * a) AS top, a, sum((n_children = 0)::INT) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM kids) GROUP BY ALL
)
SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
FROM kids k JOIN sums s ON s.top = k.node AND s.a = k.d LEFT JOIN nodes p ON p.d = k.d - 1 AND p.node = left(k.node, {2 * KEY} * (k.d - 1)) AND k.d > 0
"""
