"""Source divergence audit: how unlike each other the sources of a language are,
and which terms set a source apart from its language.

Terms are counted in Arrow batches, one bounded table of counts for each task,
and added up by shuffles.  The row of a kept term holds its count column: the
sources where it occurs with its counts there.  Terms with equal columns give
every pair of sources the same contribution, so columns are made distinct, each
distinct one is worth its number of terms, and the pairs of a language are
evaluated once for each distinct column, in numpy, by shards of columns.  A
shard gets its languages' group totals as rows ahead of the columns; it holds
its own columns and one block of pair sums, no more.  Terms themselves are
ranked from the stored rows.

    p(count) = 1 + floor(SCALE * (count + 1) / (N + V)),  f(p, q) = floor((p - q)**2 / q)

N is the group's number of occurrences of kept terms, V the language's number of
kept terms.  All of it is integer arithmetic.

Edge cases: null text, lang and source are ''; repeated rows and ids are documents
of their own; a group without terms is compared too (all its counts are 0); in
a language without kept terms every pair has value 0; equal values are ranked by
the item's bytes; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import LOWER
from .common import cut, joined, read

MIN_DOCS, TOP, SCALE = 3, 200, 10**9
#: Letters A-Z in either case and all that isn't ASCII, in UTF-8 bytes of lower-cased text.
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Counts that a task holds before it passes them on.
HELD = 400_000
#: Cells of a block of sums or of a slice of columns: 8 bytes each, a few at once.
CELLS = 1 << 20


def _batch(lang: str, source: str, counts: Counter, docs: Counter) -> pa.RecordBatch:
    """One group's counts, with a row for the group itself: the empty term."""
    terms = pa.array([b"", *counts], pa.binary()).cast(pa.string())
    n = len(terms)
    held = [0, *(docs[t] for t in counts)]
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n), pa.array([source] * n), terms, pa.array([0, *counts.values()], pa.int64()), pa.array(held, pa.int64())],
        names=["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs), and the empty term for each group there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
                counts, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                words = TERM.findall(text.encode().translate(LOWER))
                before = len(counts)
                counts.update(words)
                docs.update(set(words))
                size += len(counts) - before
                if size > held:
                    yield from (_batch(*g, *x) for g, x in groups.items())
                    groups, size = {}, 0
        yield from (_batch(*g, *x) for g, x in groups.items())

    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = texts.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def count_columns(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, counts): a kept term with its sparse count column, and
    the empty term with all groups of the language."""
    column = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("counts")
    rows = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), column)
    return rows.where((F.col("docs") >= min_docs) | (F.col("term") == "")).drop("docs")


def group_totals(columns: DataFrame) -> DataFrame:
    """(lang, source, size, terms, kept, whole): the group's N and its number of
    terms, the language's V and N."""
    entries = columns.select("lang", (F.col("term") != "").cast("long").alias("kept"), F.explode("counts").alias("c"))
    groups = entries.groupBy("lang", "c.source").agg(F.sum("c.n").alias("size"), F.sum("kept").alias("terms"))
    langs = columns.groupBy("lang").agg(F.sum((F.col("term") != "").cast("long")).alias("kept"), F.sum("total").alias("whole"))
    return groups.join(langs, "lang")


def share(n: Column, size: Column, kept: Column) -> Column:
    """p(count), exactly."""
    top = F.lit(SCALE).cast("decimal(38,0)") * (n + 1)
    return F.lit(1) + F.call_function("div", top, (size + kept).cast("decimal(20,0)"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, size: np.ndarray) -> np.ndarray:
    """p(count) for counts n of groups with N + V = size: long division by
    thousands, so that no product leaves 64 bits."""
    whole, rest = np.divmod(n + 1, size)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + digit
    return 1 + whole


def pair_sums(sizes: np.ndarray, kept: int, starts: np.ndarray, source: np.ndarray, n: np.ndarray, terms: np.ndarray, cells: int = CELLS) -> Iterator[tuple[int, np.ndarray]]:
    """(first, sums) in blocks of rows: sums[i, j] is the sum of f over all terms
    for the sources first + i and j.  Column k has the entries starts[k] to
    starts[k + 1] of (source, n) and stands for terms[k] terms."""
    width = len(sizes)
    none = shares(np.zeros(width, np.int64), sizes + kept)
    step = max(1, cells // width)
    for first in range(0, width, step):
        sums = np.zeros((min(step, width - first), width), np.int64)
        for at in range(0, len(terms), step):
            last = min(at + step, len(terms))
            own = slice(starts[at], starts[last])
            row = np.repeat(np.arange(last - at), np.diff(starts[at : last + 1]))
            p = np.repeat(none[None], last - at, 0)
            p[row, source[own]] = shares(n[own], sizes[source[own]] + kept)
            for i in range(len(sums)):
                apart = p[:, first + i, None] - p
                sums[i] += terms[at:last] @ (apart * apart // p)
        yield first, sums


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, item, value) of a shard's columns; a language's group rows
    (kind 0) come before its columns (kind 1)."""

    def done(lang: str, head: list[dict], rows: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        totals = {h["source"]: h for h in head}  # a task may hold several shards
        if not rows and not any(h["shard"] == 0 for h in head):
            return
        names = pa.array(sorted(totals))
        sizes = np.array([totals[s]["size"] for s in names.to_pylist()], np.int64)
        parts = [t["counts"].combine_chunks() for t in rows]
        lists = pa.concat_arrays([c for p in parts for c in (p.chunks if isinstance(p, pa.ChunkedArray) else [p])]) if parts else None
        terms = np.concatenate([t["terms"].to_numpy() for t in rows]) if rows else np.empty(0, np.int64)
        if not len(terms):  # once only: the first shard answers for a language without columns
            blocks = [(0, np.zeros((len(names), len(names)), np.int64))] if head[0]["kept"] == 0 else []
        else:
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            source = pc.index_in(flat.field("source"), names).to_numpy()
            blocks = pair_sums(sizes, head[0]["kept"], offsets - offsets[0], source, flat.field("n").to_numpy(), terms)
        for first, sums in blocks:
            for i, own in enumerate(sums):
                others = np.flatnonzero(np.arange(len(names)) != first + i)
                if len(others):
                    columns = [pa.array([lang] * len(others)), pa.array([names[first + i].as_py()] * len(others)), names.take(pa.array(others)), pa.array(own[others])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value"])

    now, head, rows = None, [], []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for lang in dict.fromkeys(batch.column("lang").to_pylist()):
            own = table.filter(pc.equal(table["lang"], lang))
            if lang != now:
                if now is not None:
                    yield from done(now, head, rows)
                now, head, rows = lang, [], []
            head += own.filter(pc.equal(own["kind"], 0)).select(["source", "size", "kept", "shard"]).to_pylist()
            columns = own.filter(pc.equal(own["kind"], 1)).select(["counts", "terms"])
            rows += [columns] if columns.num_rows else []
    if now is not None:
        yield from done(now, head, rows)


def pair_values(columns: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, by shards
    of distinct count columns."""
    n = int(columns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = columns.where("term <> ''").groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("terms"))
    rows = distinct.select("lang", F.lit(1).alias("kind"), F.pmod(F.xxhash64("counts"), F.lit(n)).cast("int").alias("shard"), "counts", "terms")
    heads = totals.select("lang", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("shard"), "source", "size", "kept")
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition(n, "shard").sortWithinPartitions("lang", "kind")
    return dealt.mapInArrow(_pairs, "lang string, source string, item string, value bigint").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def term_values(columns: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every kept term that a group has and uses
    more than its language does."""

    def named(df: DataFrame) -> DataFrame:
        return df.withColumn("__g", F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", "source"))

    entries = columns.where("term <> ''").select("lang", "term", "total", F.explode("counts").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    table = named(totals).select("__g", "size", "kept", "whole", F.col("terms").alias("n"))
    every = totals.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    met = joined(named(entries.withColumnRenamed("n", "own")), table, "__g", every)
    both = met.select("lang", "source", F.col("term").alias("item"), share(F.col("own"), F.col("size"), F.col("kept")).alias("p"), share(F.col("total"), F.col("whole"), F.col("kept")).alias("q"))
    return both.where("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` ranks the other
    sources of the language, part `term` the first `top` terms of the group."""
    columns = cut(count_columns(term_counts(docs), min_docs))
    totals = cut(group_totals(columns))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(columns, totals).withColumn("rank", order)
    terms = term_values(columns, totals).withColumn("rank", order).where(F.col("rank") <= top)
    kinds = [F.col("lang"), F.col("source"), F.col("item"), F.col("value"), F.col("rank")]
    return pairs.select(F.lit("pair").alias("part"), *kinds).unionByName(terms.select(F.lit("term").alias("part"), *kinds))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), words AS (SELECT doc, lang, source, unnest(words) AS term FROM docs
), kept AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= {MIN_DOCS}
), langs AS (SELECT d.lang, count(k.term) AS v, coalesce(sum(k.total), 0) AS whole FROM (SELECT DISTINCT lang FROM docs) d LEFT JOIN kept k ON d.lang = k.lang GROUP BY d.lang
), occurs AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL
), groups AS (
  SELECT d.lang, d.source, coalesce(sum(o.n), 0) AS size
  FROM (SELECT DISTINCT lang, source FROM docs) d LEFT JOIN occurs o ON d.lang = o.lang AND d.source = o.source GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(o.n, 0) + 1)) // (g.size + l.v) AS p,
         1 + ({SCALE}::HUGEINT * (k.total + 1)) // (l.whole + l.v) AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN occurs o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM cells x JOIN cells y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM cells WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
WHERE part = 'pair' OR rank <= {TOP}
"""
