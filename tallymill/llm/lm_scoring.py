"""Language-model scores: context-tree weighting over bytes (see ctw.py), beside
a smoothed unigram base.

A text is its lower-cased words, joined by single spaces, and a line break as
the end: a string that stands for its token sequence and no other.  The model
gives each of its bytes a probability from the DEPTH bytes before it.

Counting: every task counts words and grams of its texts in bounded arrays and
sends partial counts; grams are summed, and the trees below each pair of nearest
bytes are solved apart, those of the largest pairs below each three bytes.  Only
the counts and probabilities of the 255 nodes of each single nearest byte (at
most 256 rows) and of the largest pairs (fewer than HEAVY rows of 6 KB) come to
the driver, whatever the input.

Scoring: texts are dealt into chunks of bounded size by a hash of the row.  The
most frequent grams and words, at most SHARED and SHARED_WORDS of them, are
broadcast.  A chunk sends its distinct words and grams beyond those (if there are
any) to be joined with the model and gets back tables of its own, bounded by the
chunk.  A row that
repeats so often that it would fill a chunk is scored once and its score given to
all its repeats.  A text's code length is also given in bits a byte of the string
that stands for it.

Edge cases: null text counts as empty (one token, its end); repeated rows and
ids each give their own row; null ids too; without training rows all counts are
0; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw
from .arrow import LOWER, given_back
from .common import HEAVY, crc_mod, cut, read, released

DEPTH, SEGMENT, BLOCK = 5, 1 << 20, 1 << 20
#: Bytes of text in a chunk, about; entries in a task's arrays, a few times as many before they are merged.
CHUNK, TABLE = 4 << 20, 500_000
#: Grams that are broadcast, at most (16 bytes each), and words (about 100 bytes each in a worker).
SHARED, SHARED_WORDS = 4_000_000, 1 << 18
#: Rows of a batch that is sent.
SENT = 1 << 16
#: Groups that the contexts of three bytes are dealt to.
DEALS = 1024


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def string(text: str | None) -> bytes:
    """The string that stands for a text's tokens."""
    return b" ".join(tokens(text)) + b"\n"


def words_of(strings: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(own, place, n): the distinct words of such strings, for each word its place
    among them, and how many words each string has."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    gap = (data == 32) | (data == 10)
    gaps = np.flatnonzero(gap)
    lengths, last = np.diff(gaps, prepend=-1) - 1, data[gaps] == 10
    real = lengths > 0  # the string of an empty text has none
    n = np.bincount((np.cumsum(last) - last)[real], minlength=len(strings))
    offsets = np.concatenate([[0], np.cumsum(lengths[real])])
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])])
    encoded = words.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(), n


def cuts(strings: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, real, owner) of blocks of about BLOCK bytes: the bytes, which of those
    after the first ``depth`` are predicted, and the strings that these are of.  A
    string starts from a context of line breaks; long ones go in segments that
    begin with the last bytes of the one before."""
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in parts])
        real = np.ones(lengths.sum(), bool)
        real[((np.cumsum(lengths) - lengths)[:, None] + np.arange(depth)).ravel()] = False
        return np.frombuffer(b"".join(parts), np.uint8), real[depth:], np.repeat(owners, lengths - depth)

    for k, s in enumerate(strings):
        for at in range(0, len(s), SEGMENT):
            parts.append((s[at - depth : at] if at else b"\n" * depth) + s[at : at + SEGMENT])
            owners.append(k)
            size += len(parts[-1])
            if size >= BLOCK:
                yield flush()
                parts, owners, size = [], [], 0
    if parts:
        yield flush()


def blocks(strings: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, place, owner) of blocks: the distinct grams, and for each predicted
    byte its gram's place and the string it is of."""
    for data, real, owner in cuts(strings, depth):
        yield *ctw.block_grams(data, depth, real), owner


def _counts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Partial rows (word, gram, n): one of word and gram is null.  Grams of
    texts that only are scored come with n = 0."""
    yield from _partial(batches, depth)
    given_back()


def _partial(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    words: list[tuple[pa.Array, np.ndarray]] = []
    grams: list[tuple[np.ndarray, np.ndarray]] = []
    held = held_words = 0

    for batch in batches:
        texts, remainders = batch.column("text"), batch.column("remainder").to_numpy()
        for s in range(0, len(texts), 512):
            strings, train = [string(t) for t in texts.slice(s, 512).to_pylist()], remainders[s : s + 512] != 0
            own, place, _ = words_of([x for x, of in zip(strings, train) if of])
            words.append((own, np.bincount(place, minlength=len(own))))
            held_words += len(own)
            for data, real, owner in cuts(strings, depth):
                learned = real.copy()
                learned[real] = train[owner]
                (codes, n), (others, _) = ctw.count_grams(data, depth, [learned, real & ~learned])
                grams += [(codes, n), (others, np.zeros(len(others), np.int64))]
                held += len(codes) + len(others)
                if held > 3 * TABLE:
                    grams = [_merged(grams)]
                    held = len(grams[0][0])
                    if held > 2 * TABLE:
                        yield from _rows(None, *_arrays(grams[0]))
                        grams, held = [], 0
            if held_words > 2 * TABLE:
                words = [_merged_words(words)]
                held_words = len(words[0][0])
                if held_words > TABLE:
                    yield from _rows(words[0][0], None, pa.array(words[0][1]))
                    words, held_words = [], 0
    if grams:
        grams = [_merged(grams)]
        given_back()
        yield from _rows(None, *_arrays(grams.pop()))
    if held_words:
        words = [_merged_words(words)]
        given_back()
        own, n = words.pop()
        yield from _rows(own, None, pa.array(n))


def _merged_words(words: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    encoded = pa.concat_arrays([own for own, _ in words]).dictionary_encode()
    place, n = encoded.indices.to_numpy(), np.zeros(len(encoded.dictionary), np.int64)
    np.add.at(n, place, np.concatenate([n for _, n in words]))
    return encoded.dictionary, n


def _bytes(words: pa.Array) -> list[bytes]:
    """As to_pylist(), which takes a microsecond and more for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _arrays(grams: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, pa.Array]:
    return pa.array(grams[0].view(np.int64)), pa.array(grams[1])


def _merged(grams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in grams])
    order = np.argsort(codes)
    codes, n = codes[order], np.concatenate([n for _, n in grams])[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(n, first)


def _rows(word: pa.Array | None, gram: pa.Array | None, n: pa.Array) -> Iterator[pa.RecordBatch]:
    table = pa.table({"word": pa.nulls(len(n), pa.binary()) if word is None else word.cast(pa.binary()), "gram": pa.nulls(len(n), pa.int64()) if gram is None else gram, "n": n})
    yield from table.to_batches(max_chunksize=SENT)


@dataclass(frozen=True)
class Model:
    """totals: (word, n).  grams: (gram, n, lp), lp the log10 probability of
    a gram's last byte.  n_tokens, n_words: of the training texts, the end
    counted as one; n_ends: training texts."""

    totals: DataFrame
    grams: DataFrame
    n_tokens: int
    n_words: int
    n_ends: int

    @property
    def base(self) -> Callable[[float], float]:
        """log10 of a token's smoothed probability, by its count."""
        whole = self.n_tokens + 0.1 * (self.n_words + 1)
        return lambda count: math.log10((count + 0.1) / whole)


def _solve(table: pa.Table, depth: int, top: int) -> pa.Table:
    """The trees below contexts of the ``top`` nearest bytes.  Besides a row for
    each gram, one row of null gram for each context tells the context above it
    (above: its bytes) of the symbols and node probabilities."""
    order = np.argsort(table["gram"].to_numpy().view(np.uint64))
    codes, n = table["gram"].to_numpy().view(np.uint64)[order], table["n"].to_numpy()[order]
    p, ln_pw = ctw.solve(codes, n, depth, top)
    symbols = (codes & np.uint64(255)).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(codes >> np.uint64(8 * (depth - top + 1)))) + 1).tolist(), len(codes)]
    told = []
    for s, e in zip(edges, edges[1:]):
        nodes, own = np.zeros(256), symbols[s:e]
        for level in range(8):
            nodes[(own >> (8 - level)) | (1 << level)] = ln_pw[s:e, level]
        told.append(np.concatenate([np.bincount(own, n[s:e], minlength=256), nodes]))
    above = (codes >> np.uint64(8 * (depth - top + 2))).astype(np.int32)
    grams = pa.array([*codes.view(np.int64), *[None] * len(told)], pa.int64())
    counts = pa.array([*n.tolist(), *[None] * len(told)], pa.int64())
    return pa.table({"gram": grams, "n": counts, "above": pa.array(np.concatenate([above, above[edges[:-1]]])), "p": pa.array([*p, *told], pa.list_(pa.float64()))})


def _level(rows: list[list[float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimates, weights, ln P_w) of one context from its children's rows of
    256 symbol counts and 256 node probabilities.  estimates[node, bit] is the
    KT probability of a bit, weights[node] its share in the mixture."""
    parts = np.array(rows).reshape(-1, 512)
    symbols, children = parts[:, :256].sum(axis=0), parts[:, 256:].sum(axis=0)
    counts, value = np.zeros((256, 2)), np.arange(256)
    for level in range(8):
        np.add.at(counts, ((value >> (8 - level)) | (1 << level), (value >> (7 - level)) & 1), symbols)
    ln_pe = ctw.LN_HALF + ctw.ln_kt(counts[:, 0], counts[:, 1])
    ln_pw = np.logaddexp(ln_pe, ctw.LN_HALF + children)
    return (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 1), np.exp(ln_pe - ln_pw), np.concatenate([symbols, ln_pw])


CONTEXT = "context int, kt array<double>, w array<double>, told array<double>"


def _context(table: pa.Table) -> pa.Table:
    """One context, from the rows of at most 256 contexts below it: its estimates
    and weights, and what it tells the context above."""
    kt, w, told = _level(table["p"].to_pylist())
    return pa.table({"context": table["above"][:1], "kt": pa.array([kt.ravel()]), "w": pa.array([w]), "told": pa.array([told])})


def _finish(rows: DataFrame, seconds: list, firsts: list, depth: int) -> DataFrame:
    """(gram, n, lp): the estimates of the contexts in seconds (the large pairs of
    nearest bytes, by number), of the nearest byte's context and of the root mixed
    in.  firsts: at most 256 contexts, by nearest byte; kt is null if the trees were
    solved down to the nearest byte alone.  One function does all of it: two in a
    row would hold a second Python process for each core until the run's end."""
    seconds = sorted(seconds, key=lambda r: r["context"])
    pairs = np.array([r["context"] for r in seconds], np.int64).view(np.uint64)
    kt2 = np.array([r["kt"] for r in seconds]).reshape(-1, 256, 2)
    w2 = np.array([r["w"] for r in seconds]).reshape(-1, 256)
    kt0, w0, _ = _level([r["told"] for r in firsts])
    kt1, w1 = np.full((256, 256, 2), 0.5), np.zeros((256, 256))
    for r in firsts:
        if r["kt"] is not None:
            kt1[r["context"]], w1[r["context"]] = np.array(r["kt"]).reshape(256, 2), r["w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            grams = batch.column("gram").to_numpy()
            p = batch.column("p").flatten().to_numpy().reshape(-1, 8)
            x, c, lp = grams & 255, (grams >> (8 * depth)) & 255, np.zeros(len(grams))
            pair = _place(pairs, grams.view(np.uint64) >> np.uint64(8 * (depth - 1)))
            deep = np.flatnonzero(pair >= 0)
            own = pair[deep]
            for level in range(8):
                node, bit = (x >> (8 - level)) | (1 << level), (x >> (7 - level)) & 1
                mixed = p[:, level].copy()
                w = w2[own, node[deep]]
                mixed[deep] = w * kt2[own, node[deep], bit[deep]] + (1 - w) * mixed[deep]
                mixed = w1[c, node] * kt1[c, node, bit] + (1 - w1[c, node]) * mixed
                lp += np.log10(w0[node] * kt0[node, bit] + (1 - w0[node]) * mixed)
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("n"), pa.array(lp)], names=["gram", "n", "lp"])

    return rows.mapInArrow(run, "gram bigint, n bigint, lp double")


def train(rows: DataFrame, depth: int = DEPTH) -> Model:
    """From rows (text, remainder); remainder 0 isn't learned from."""
    if not 1 <= depth <= 7:
        raise ValueError("a gram of depth + 1 bytes must fit in 64 bits, and the root needs a context byte")
    counted = rows.select("text", "remainder").mapInArrow(lambda it: _counts(it, depth), "word binary, gram bigint, n bigint")
    totals = cut(counted.groupBy("word", "gram").agg(F.sum("n").alias("n")))
    sums = totals.where("word IS NOT NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = rows.where("remainder <> 0").count()
    top = min(depth, 2)
    grams = totals.where("gram IS NOT NULL").select("gram", "n")
    schema = "gram bigint, n bigint, above int, p array<double>"
    under = lambda top: F.shiftrightunsigned("gram", 8 * (depth - top + 1))
    trees = grams.withColumn("under", under(top))
    solve = lambda df, top: df.applyInArrow(lambda t: given_back(_solve(t, depth, top)), schema)
    seconds = []
    if depth > 2:
        # pairs of nearest bytes with a large share of the grams, fewer than HEAVY, are
        # solved below three bytes, dealt by these, and then put together
        sizes = trees.groupBy("under").agg(F.count(F.lit(1)).alias("n"))
        large = cut(sizes.where(F.col("n") * HEAVY > grams.count()).select("under"))
        deal = F.pmod(F.xxhash64(under(3)), F.lit(DEALS)).alias("deal")
        fine = cut(solve(trees.join(F.broadcast(large), "under", "left_semi").select("gram", "n", deal).groupBy("deal"), 3))
        seconds = fine.where("gram IS NULL").select("above", "p").groupBy("above").applyInArrow(_context, CONTEXT).collect()  # fewer than HEAVY
        trees = trees.join(F.broadcast(large), "under", "left_anti")
    solved = cut(solve(trees.groupBy("under"), top))
    below, told = solved.where("gram IS NOT NULL").select("gram", "n", "p"), solved.where("gram IS NULL").select("above", "p")
    if seconds:
        below = below.unionByName(fine.where("gram IS NOT NULL").select("gram", "n", "p"))
        told = told.unionByName(rows.sparkSession.createDataFrame([(r["context"] >> 8, r["told"]) for r in seconds], "above int, p array<double>"))
    if top == 2:
        firsts = told.groupBy("above").applyInArrow(_context, CONTEXT).collect()  # at most 256 rows
    else:
        none = F.lit(None).cast("array<double>")
        firsts = told.select(F.col("above").alias("context"), none.alias("kt"), none.alias("w"), F.col("p").alias("told")).collect()  # at most 256 rows
    done = cut(_finish(below, seconds, firsts, depth))
    return Model(totals.where("word IS NOT NULL").select("word", "n"), done, sums[1] + ends, sums[0] + (ends > 0), ends)


def _keys(table: pa.Table, depth: int, shared: np.ndarray | None, often: dict[bytes, float] | None) -> pa.Table:
    """The distinct words and grams of a chunk that aren't among the shared ones
    (None: all are)."""
    own: set[bytes] = set()
    found: list[np.ndarray] = []
    for batch in table.to_batches(max_chunksize=512):
        strings = [string(t) for t in batch.column("text").to_pylist()]
        if often is not None:
            own.update(w for w in _bytes(words_of(strings)[0]) if w not in often)
        if shared is not None:
            for codes, _, _ in blocks(strings, depth):
                found.append(codes[_place(shared, codes) < 0])
            if len(found) > 64:
                found = [np.unique(np.concatenate(found))]
    grams = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
    words = pa.array([*own, *[None] * len(grams)], pa.binary())
    codes = pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(grams.view(np.int64))])
    return pa.table({"chunk": pa.array(np.full(len(words), table["chunk"][0].as_py(), np.int32)), "word": words, "gram": codes})


def _place(codes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Where each code asked for is among sorted codes; -1 if it isn't."""
    if not len(codes):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(codes, asked), len(codes) - 1)
    return np.where(codes[at] == asked, at, -1)


def _of_words(counted: pa.Table, base: Callable[[float], float]) -> dict[bytes, float]:
    """base of the count (value) of each word.  Taken in slices, and equal counts
    share a number: beside the table there is little else."""
    lp: dict[bytes, float] = {}
    by_count: dict[float, float] = {}
    for batch in counted.select(["word", "value"]).to_batches(max_chunksize=8192):
        batch = batch.filter(pa.compute.is_valid(batch.column("word")))
        counts = batch.column("value").to_numpy().tolist()
        by_count |= {n: base(n) for n in {*counts} - by_count.keys()}
        lp.update(zip(_bytes(batch.column("word")), map(by_count.__getitem__, counts)))
    return lp


def _split(grams: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The most frequent grams, at most ``most``, and the others if there are any.
    The cut lies between powers of two of the counts."""
    if grams.count() <= most:
        return grams, None
    power = F.floor(F.log2(F.greatest("n", F.lit(1)).cast("double"))).cast("int")
    sizes = sorted(((r[0], r[1]) for r in grams.groupBy(power).count().collect()), reverse=True)  # at most 64 rows
    low, taken = 64, 0
    for p, c in sizes:
        if taken + c > most:
            break
        low, taken = p, taken + c
    return grams.where(power >= low), grams.where(power < low)


SCORES = "n_tokens bigint, n_known bigint, n_bytes bigint, base_score double, score double"


def _scored(chunked: DataFrame, model: Model, depth: int, most: int, most_words: int) -> DataFrame:
    """(doc_id, remainder, row, SCORES) of rows (doc_id, text, remainder, row,
    chunk)."""
    spark, base = chunked.sparkSession, model.base
    often, rare = _split(model.grams, most)
    often_words, rare_words = _split(model.totals, most_words)
    some_rare, some_rare_words = rare is not None, rare_words is not None
    table = often.select("gram", "lp").toArrow()  # at most ``most`` rows
    codes = table["gram"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    shared = spark.sparkContext.broadcast((codes[order], table["lp"].to_numpy()[order]))
    shared_words = spark.sparkContext.broadcast(_of_words(often_words.select("word", F.col("n").alias("value")).toArrow(), base))  # at most ``most_words``
    keys = chunked.groupBy("chunk").applyInArrow(
        lambda t: given_back(_keys(t, depth, shared.value[0] if some_rare else None, shared_words.value if some_rare_words else None)), "chunk int, word binary, gram bigint"
    )
    none = lambda kind: F.lit(None).cast(kind)
    answers = keys.where("false").withColumn("value", none("double"))
    if rare_words is not None:
        known = keys.where("word IS NOT NULL").select("chunk", "word").join(rare_words, "word")
        answers = answers.unionByName(known.select("chunk", "word", none("bigint").alias("gram"), F.col("n").cast("double").alias("value")))
    if rare is not None:
        solved = keys.where("gram IS NOT NULL").select("chunk", "gram").join(rare, "gram")
        answers = answers.unionByName(solved.select("chunk", none("binary").alias("word"), "gram", F.col("lp").alias("value")))
    unknown, end, end_known = base(0), base(model.n_ends), int(model.n_ends > 0)

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        often, lp = shared_words.value, _of_words(answers, base)
        codes, values = shared.value
        if some_rare:
            of_grams = answers.select(["gram", "value"]).filter(pa.compute.is_valid(answers["gram"]))
            own_codes = of_grams["gram"].to_numpy().view(np.uint64)
            order = np.argsort(own_codes)
            own_codes, own_values = own_codes[order], of_grams["value"].to_numpy()[order]

        def looked_up(asked: np.ndarray) -> np.ndarray:
            if not some_rare:
                return values[np.searchsorted(codes, asked)]
            at, found = _place(codes, asked), np.empty(len(asked))
            found[at >= 0] = values[at[at >= 0]]
            found[at < 0] = own_values[np.searchsorted(own_codes, asked[at < 0])]
            return found

        out: list[list] = [[], [], [], [], []]
        for batch in docs.to_batches(max_chunksize=512):
            strings = [string(t) for t in batch.column("text").to_pylist()]
            sums = np.zeros(len(strings))
            for own, place, owner in blocks(strings, depth):
                sums += np.bincount(owner, looked_up(own)[place], minlength=len(strings))
            words, place, n = words_of(strings)
            got = np.array([often[w] if w in often else lp.get(w, math.nan) for w in _bytes(words)])[place]
            no, edges = np.isnan(got), [0, *np.cumsum(n).tolist()]
            got = np.where(no, unknown, got).tolist()
            out[0] += (n + 1).tolist()
            out[1] += (n - np.bincount(np.repeat(np.arange(len(n)), n), no, len(n)).astype(np.int64) + end_known).tolist()
            out[2] += map(len, strings)
            out[3] += [math.fsum(got[a:b]) + end for a, b in zip(edges, edges[1:])]
            out[4] += sums.tolist()
        columns = zip(("n_tokens", "n_known", "n_bytes", "base_score", "score"), out, (pa.int64(),) * 3 + (pa.float64(),) * 2)
        return pa.table({"doc_id": docs["doc_id"], "remainder": docs["remainder"], "row": docs["row"], **{k: pa.array(v, t) for k, v, t in columns}})

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda docs, answers: given_back(run(docs, answers)), f"doc_id bigint, remainder int, row bigint, {SCORES}")


def score(rows: DataFrame, model: Model, depth: int = DEPTH, chunk_bytes: int = CHUNK, most: int = SHARED, most_words: int = SHARED_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    n_bytes, bits_per_byte) from rows (doc_id, text, remainder)."""
    size, n_rows = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    n_chunks = max(1, -(-size // chunk_bytes))
    keyed = rows.select("doc_id", "text", "remainder", F.xxhash64("doc_id", "text").alias("row"))
    counts = keyed.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    often = cut(counts.where(F.col("n") * HEAVY > n_rows).where("n > 1").select("row"))  # fewer than HEAVY rows
    spread = F.pmod(F.col("row"), F.lit(n_chunks)).cast("int").alias("chunk")
    if often.isEmpty():
        found = _scored(keyed.select("*", spread), model, depth, most, most_words)
    else:
        repeats = keyed.join(F.broadcast(often), "row", "left_semi")
        once = keyed.join(F.broadcast(often), "row", "left_anti").unionByName(repeats.dropDuplicates(["row", "doc_id", "text"]))
        scored = cut(_scored(once.select("*", spread), model, depth, most, most_words))
        of = scored.join(F.broadcast(often), "row", "left_semi").withColumnsRenamed({"row": "r", "doc_id": "d"}).drop("remainder")
        same = (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))
        again = repeats.select("row", "doc_id", "remainder").join(F.broadcast(of), same).drop("r", "d")
        found = scored.join(F.broadcast(often), "row", "left_anti").unionByName(again)
    return found.select(
        "doc_id", (F.col("remainder") == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        "n_bytes", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", crc_mod(F.col("doc_id"), 10).cast("int").alias("remainder"))
    model = train(rows)
    released(spark)  # the shuffle files of the counts, else on disk beside those of the scores
    return score(rows, model)
