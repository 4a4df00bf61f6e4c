"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and are cut into pieces of at most LIMIT; only longer
documents are cut.  Pieces are dealt round-robin into shards of about ITEMS, so
no key can fill one, and a shard is one row of packed arrays; a task makes and
works many shards, one after another.  Every shard is worked by ISLANDS islands:
an individual is a grouping of the shard's pieces into sequences; crossover puts
whole full sequences of one parent into the other and drops the sequences there
that repeat a piece.  Pieces that lost their place first change places with
shorter ones wherever that fills a sequence further, and what is left over then
is best-fitted.  After each epoch the islands' elites migrate round the ring.  A
shard whose best fit already meets the lower bound needs no births.  At the end
the sequences that stayed poorly filled leave all shards, meet in new shards and
are packed again, starting from the grouping they came with.

Edge cases: null text is one token, the end id 0; repeated rows and ids are
pieces of their own; piece and start count within a row's document; empty
tables give empty results; other columns are not read.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from itertools import chain
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import texts_of
from .common import cut, read

LIMIT, ITEMS, ISLANDS, EPOCHS, BIRTHS, POPULATION = 2048, 4096, 2, 2, 24, 6
#: Sequences filled below this share of LIMIT are packed again at the end.
POOR = 0.97
#: Tasks for each core of the cluster, at most.
TASKS = 4
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

Bins = list[list[int]]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids with
    the end id 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import words_of

        words = words_of(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = words.encode(text) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


class Rooms:
    """Best fit: the open sequences by the room they have left."""

    def __init__(self, limit: int) -> None:
        self.limit, self.mask, self.by_room = limit, 0, {}

    def add(self, own: list[int], room: int) -> None:
        if room:
            if (held := self.by_room.get(room)) is None:
                held = self.by_room[room] = []
            held.append(own)
            self.mask |= 1 << room

    def place(self, item: int, length: int) -> list[int] | None:
        """Puts the item where the least room stays; a new sequence is returned."""
        fits = self.mask >> length
        if not fits:
            own = [item]
            self.add(own, self.limit - length)
            return own
        room = length + (fits & -fits).bit_length() - 1
        held = self.by_room[room]
        own = held.pop()
        if not held:
            self.mask &= ~(1 << room)
        own.append(item)
        self.add(own, room - length)
        return None


def homes(bins: Bins, n: int) -> np.ndarray:
    """Each of n items' bin, by number; -1 for an item in none."""
    home, sizes = np.full(n, -1), np.fromiter(map(len, bins), np.int64, len(bins))
    home[np.fromiter(chain.from_iterable(bins), np.int64, sizes.sum())] = np.repeat(np.arange(len(bins)), sizes)
    return home


def filled(bins: Bins, lengths: list[int]) -> list[int]:
    """The summed lengths of each bin."""
    get = lengths.__getitem__
    return [sum(map(get, b)) for b in bins]


def best_fit(bins: Bins, items: list[int], lengths: list[int], limit: int) -> Bins:
    """bins with the items added in the order given."""
    rooms, out = Rooms(limit), [list(b) for b in bins]
    for b, full in zip(out, filled(bins, lengths)):
        if full < limit:
            rooms.add(b, limit - full)
    for i in items:
        if (new := rooms.place(i, lengths[i])) is not None:
            out.append(new)
    return out


def fitness(bins: Bins, lengths: list[int]) -> tuple[int, int]:
    """Fewer sequences first; among equals, the more unevenly filled ones."""
    full = filled(bins, lengths)
    return len(bins), -sum(map(mul, full, full))


def swapped(bins: Bins, free: list[int], lengths: list[int], limit: int) -> tuple[Bins, list[int]]:
    """Free pieces, longest first, take the place of a shorter one in whichever
    sequence is then filled best, until none can: the same number of pieces stays
    free, of a smaller sum."""
    size, home = np.asarray(lengths), homes(bins, len(lengths))
    held = np.flatnonzero(home >= 0)
    room = limit - np.bincount(home[held], size[held], minlength=len(bins)).astype(np.int64)
    held = held[room[home[held]] > 0]
    # of the pieces held, beside their numbers: bin, length, length and room together
    at, own, most = home[held], size[held], size[held] + room[home[held]]
    free, k, tried = sorted(free, key=lambda i: -lengths[i]), 0, 0
    while tried < len(free) and len(held):
        f = free[k]
        left = most - lengths[f]
        best = int(np.where((own < lengths[f]) & (left >= 0), left, limit).argmin())
        if own[best] < lengths[f] <= most[best]:
            b, gain = at[best], lengths[f] - own[best]
            free[k], home[held[best]], home[f], tried = int(held[best]), -1, b, -1
            held[best], own[best] = f, lengths[f]
            room[b] -= gain
            if room[b]:
                same = at == b
                most[same] = own[same] + room[b]
            else:
                stay = at != b
                held, at, own, most = held[stay], at[stay], own[stay], most[stay]
        k, tried = (k + 1) % len(free), tried + 1
    order = np.argsort(home, kind="stable")[np.count_nonzero(home < 0) :]
    cuts, flat = np.searchsorted(home[order], np.arange(len(bins) + 1)).tolist(), order.tolist()
    return [flat[s:e] for s, e in zip(cuts, cuts[1:])], free


def crossover(a: Bins, b: Bins, lengths: list[int], limit: int, rng: random.Random) -> Bins:
    """Whole well-filled sequences of b go into a."""
    good = [x for x, full in zip(b, filled(b, lengths)) if full >= limit * 0.999]
    chosen = rng.sample(good, max(1, len(good) // 8)) if good else []
    have = {i for x in chosen for i in x}
    stay, lost = [], []
    for x in a:
        if have.isdisjoint(x):
            stay.append(x)
        else:
            lost += [i for i in x if i not in have]
    return _refit(stay + chosen, lost, lengths, limit, rng)


def mutate(a: Bins, lengths: list[int], limit: int, rng: random.Random) -> Bins:
    """The emptiest sequences, some with room and some others give up their pieces."""
    room = [limit - full for full in filled(a, lengths)]
    order = sorted((k for k in range(len(a)) if room[k]), key=lambda k: -room[k])
    n = rng.choice((1, 2, 4, 8))
    out = {*order[: 1 + rng.randrange(3)], *rng.sample(order, min(n, len(order))), *rng.sample(range(len(a)), min(n, len(a)))}
    return _refit([x for k, x in enumerate(a) if k not in out], [i for k in out for i in a[k]], lengths, limit, rng)


def _refit(bins: Bins, lost: list[int], lengths: list[int], limit: int, rng: random.Random) -> Bins:
    bins, lost = swapped(bins, lost, lengths, limit)
    shake = rng.choice((0.0, 0.02, 0.1))
    return best_fit(bins, sorted(lost, key=lambda i: -lengths[i] * (1 + shake * rng.random())), lengths, limit)


def evolve(lengths: list[int], starts: list[Bins], limit: int, births: int, size: int, rng: random.Random) -> Bins:
    """The best grouping after a number of births; ends early where no grouping
    could have fewer sequences.  A child as fit as another is that one again."""
    least = -(-sum(lengths) // limit)
    items = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    crowd = [*starts, best_fit([], items, lengths, limit)]
    if min(map(len, crowd)) <= least:
        return min(crowd, key=len)
    while len(crowd) < size:
        shake = rng.choice((0.02, 0.1, 0.3))
        crowd.append(best_fit([], sorted(items, key=lambda i: -lengths[i] * (1 + shake * rng.random())), lengths, limit))
    ranked = sorted(((fitness(b, lengths), k, b) for k, b in enumerate(crowd)))[:size]
    for birth in range(births):
        if len(ranked[0][2]) <= least:
            break
        one, two = sorted(rng.sample(ranked, 2)) if len(ranked) > 1 else ranked * 2
        child = mutate(one[2], lengths, limit, rng) if birth % 3 else crossover(one[2], two[2], lengths, limit, rng)
        fit = fitness(child, lengths)
        if all(fit != r[0] for r in ranked):
            ranked = sorted([*ranked, (fit, len(crowd) + birth, child)])[:size]
    return ranked[0][2]


def to_groups(places: np.ndarray) -> Bins:
    order = np.argsort(places, kind="stable")
    cuts = np.flatnonzero(np.diff(places[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)] if len(places) else []


def to_places(bins: Bins, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


_SHARD = "shard bigint, n int, lengths binary, rows binary, places binary"


def n_tasks(spark: SparkSession, n: int) -> int:
    """Tasks for n pieces of work: as many as keep the cluster busy, not more."""
    most = TASKS * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, min(n, most))


def shards(items: DataFrame, n: int, size: int) -> DataFrame:
    """n items (PIECE and, where they come from sequences, sequence_id) as rows
    of about size items each; a sequence stays together."""
    again = "sequence_id" in items.columns
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def row(table: pa.Table, shard: int) -> pa.RecordBatch:
        table = table.combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, (kept := table.select(fields)).schema) as out:
            out.write_table(kept)
        places = np.unique(table["sequence_id"].to_numpy(), return_inverse=True)[1].astype(np.int32).tobytes() if again else b""
        values = [shard, table.num_rows, table["length"].to_numpy().astype(np.int32).tobytes(), sink.getvalue().to_pybytes(), places]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names=["shard", "n", "lengths", "rows", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 24, 0, None
        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held is not None else []), batch]) if batch.num_rows else held
            while held is not None and held.num_rows > size:
                cut_at = size
                if again:  # the first new sequence from there on, if there is one yet
                    own = held["sequence_id"].to_numpy()
                    new = np.flatnonzero(own[size:] != own[size - 1 : -1])
                    if not len(new):
                        break
                    cut_at += int(new[0])
                yield row(held.slice(0, cut_at), first + made)
                made, held = made + 1, held.slice(cut_at)
        if held is not None and held.num_rows:
            yield row(held, first + made)

    tasks = n_tasks(items.sparkSession, -(-n // size))
    # by sequence where there are some, so that its grouping can be a start
    dealt = items.repartition(tasks, "sequence_id").sortWithinPartitions("sequence_id") if again else items.repartition(tasks)
    return cut(dealt.mapInArrow(run, _SHARD))


def epoch(state: DataFrame, limit: int, births: int, size: int, seed: int) -> DataFrame:
    """(shard, island, elite, n_bins) from (shard, island, lengths, places): one
    epoch of every island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int32).tolist()
                starts = [to_groups(np.frombuffer(p, np.int32)) for p in row["places"] if p]
                bins = evolve(lengths, starts, limit, births, size, random.Random(f"{seed}:{row['shard']}:{row['island']}"))
                out.append((row["shard"], row["island"], to_places(bins, len(lengths)).tobytes(), len(bins)))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["shard", "island", "elite", "n_bins"])

    return state.mapInArrow(run, "shard bigint, island int, elite binary, n_bins int")


def packed(table: DataFrame, limit: int, islands: int, epochs: int, births: int, size: int) -> DataFrame:
    """(shard, rows, elite): the best grouping that any island found."""
    tasks = n_tasks(table.sparkSession, islands * table.count())
    start = F.when(F.length("places") > 0, F.array("places")).otherwise(F.array().cast("array<binary>"))
    state = table.select("shard", "lengths", start.alias("places"), F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
    elites = None
    for e in range(epochs):
        elites = cut(epoch(state.repartition(tasks, "shard", "island"), limit, births, size, e))
        # an island gets its own elite and its neighbour's
        moved = elites.select("shard", F.explode(F.array(F.col("island"), (F.col("island") + 1) % islands)).alias("island"), "elite")
        met = moved.groupBy("shard", "island").agg(F.collect_list("elite").alias("places"))
        state = table.select("shard", "lengths").join(met, "shard").select("shard", "lengths", "places", "island")
    best = elites.groupBy("shard").agg(F.min_by("elite", F.struct("n_bins", "island")).alias("elite"))
    return table.select("shard", "rows").join(best, "shard")


def _placed(part: DataFrame, limit: int, base: int) -> DataFrame:
    """Piece rows with sequence_id, offset and filled (the sequence's length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = pa.ipc.open_stream(row["rows"]).read_all()
                places, lengths = np.frombuffer(row["elite"], np.int32), table["length"].to_numpy()
                order = np.argsort(places, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                first = np.concatenate([[True], np.diff(places[order]) != 0])
                offset = np.empty(len(places), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
                filled = np.bincount(places, lengths).astype(np.int64)[places]
                sequence = (row["shard"] * 2 + base) * (1 << 20) + places.astype(np.int64)
                for name, x in (("sequence_id", sequence), ("offset", offset), ("filled", filled)):
                    table = table.append_column(name, pa.array(x))
                yield from table.combine_chunks().to_batches()

    return part.mapInArrow(run, f"{PIECE}, sequence_id bigint, offset bigint, filled bigint")


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, items: int = ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, births: int = BIRTHS, size: int = POPULATION) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    every = cut(pieces(docs, path or tokenizer_path(), limit))
    first = packed(shards(every, every.count(), items), limit, islands, epochs, births, size)
    placed = cut(_placed(first, limit, 0))
    poor = placed.where(F.col("filled") < int(POOR * limit))
    again = packed(shards(poor.drop("offset", "filled"), poor.count(), items), limit, islands, epochs, births, size)
    done = placed.where(F.col("filled") >= int(POOR * limit)).unionByName(_placed(again, limit, 1))
    return done.drop("filled")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
