"""Document fingerprints: one-permutation MinHash of word shingles.

Each shingle is hashed once; the top bits choose one of BINS bins and a bin
keeps its smallest hash.  An empty bin borrows from a filled one that a hash of
(empty bin, filled bin) ranks first: every empty bin tries the bins in a random
order of its own that doesn't depend on the text, which is optimal
densification without an end to its tries.  The low eight bits of each bin's
minimum are stored, eight bins in a 64-bit integer.  Equal bins by chance (one
in 256) are taken out of the likeness.

Edge cases: null text counts as empty; a text of fewer words than a shingle has
one shingle, of all its words; a text without words has the empty fingerprint,
which is like another empty one (1.0) and unlike all others (0.0).  Repeated
ids keep their rows, ordered by text; null ids come first; a table of one row
is followed by itself; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, read, words

SHINGLE, BIN_BITS, CODE = 5, 7, 256
#: Ranges of ids for each shuffle partition.
RANGES = 4
BINS = 1 << BIN_BITS


def shingle_hashes(ws: Column) -> Column:
    each = F.transform(F.sequence(F.lit(0), F.size(ws) - SHINGLE), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)]))
    short = F.when(F.size(ws) > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(ws) >= SHINGLE, each).otherwise(short)


def fingerprint(text: Column) -> Column:
    """array<bigint> of BINS / 8 integers; empty for a text without words."""
    bin_of = lambda h: F.shiftrightunsigned(h, 64 - BIN_BITS)

    def minima(run: Column) -> Column:
        # sorted hashes hold each bin's together, its smallest first
        first = F.filter(run, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(run, F.greatest(i - 1, F.lit(0))))))
        return F.transform(first, lambda h: F.struct(bin_of(h).cast("int").alias("bin"), h.bitwiseAND(F.lit(CODE - 1)).cast("int").alias("code")))

    def codes(filled: Column) -> Column:
        def borrow(i: Column) -> Column:
            ranked = F.transform(filled, lambda e: F.xxhash64(i, e["bin"]).bitwiseAND(F.lit(-CODE).cast("long")).bitwiseOR(e["code"].cast("long")))
            return F.array_min(ranked).bitwiseAND(F.lit(CODE - 1).cast("long"))

        own = F.map_from_arrays(F.transform(filled, lambda e: e["bin"]), F.transform(filled, lambda e: e["code"]))
        bins = F.sequence(F.lit(0), F.lit(BINS - 1))
        return let(own, lambda m: F.transform(bins, lambda i: F.coalesce(F.try_element_at(m, i).cast("long"), borrow(i))))

    def packed(cs: Column) -> Column:
        eight = lambda j: F.aggregate(F.slice(cs, j * 8 + 1, 8), F.lit(0).cast("long"), lambda a, c: F.shiftleft(a, 8).bitwiseOR(c))
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), eight)

    def full(hashes: Column) -> Column:
        done = let(let(let(F.sort_array(hashes), minima), codes), packed)
        return F.when(F.size(hashes) > 0, done).otherwise(F.array().cast("array<bigint>"))

    return let(let(words(text), shingle_hashes), full)


def to_text(print_: Column) -> Column:
    """The fingerprint as lowercase hex digits; '' for the empty one."""
    return F.lower(F.array_join(F.transform(print_, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1, free of chance matches."""

    def unlike(x: Column) -> Column:
        # bytes that aren't zero: gather each byte's bits in its lowest one
        fold = lambda n: lambda v: v.bitwiseOR(F.shiftrightunsigned(v, n))
        for n in (4, 2, 1):
            x = let(x, fold(n))
        return F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: unlike(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    raw = (F.lit(BINS) - apart) / F.lit(float(BINS))
    fixed = F.greatest((raw - 1 / CODE) / (1 - 1 / CODE), F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(fixed)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, print)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("print", fingerprint(F.col("text")))


def with_next(rows: DataFrame, names: list[str], n_ranges: int | None = None) -> DataFrame:
    """rows with next_<name>: the values of the following row by doc_id, the
    first row's for the last.

    Rows are dealt into ranges of doc_id, several for each shuffle partition so
    that these come out even; a copy of each range's first row goes to the range
    before it too, so that every range finds its neighbours within itself and no
    task sees the whole table.  Only two numbers of each range come to the
    driver.  Rows of one id (or of none) stay in one range."""
    spark = rows.sparkSession
    n_ranges = n_ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id")
    cuts = ids.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / n_ranges for i in range(1, n_ranges)], 0.25 / n_ranges)
    cuts = sorted({min(int(x), (1 << 63) - 1) for x in cuts or []})  # doubles: near an id, not always one
    home = _at_or_below(cuts, F.col("doc_id"))
    # ranges that have rows, with their first ids; a null id is before all others
    first_of = sorted(((r["home"], r["low"]) for r in ids.groupBy(F.when(F.col("doc_id").isNotNull(), home).alias("home")).agg(F.min("doc_id").alias("low")).collect()), key=lambda x: (x[0] is not None, x))
    # an id's range is the number of later first ids at or below it
    edges = [low for _, low in first_of[1:]]
    place = F.when(F.col("doc_id").isNotNull(), _at_or_below(edges, F.col("doc_id"))).otherwise(0)
    table = F.array(*[F.lit(x).cast("long") for x in edges]) if edges else F.array().cast("array<bigint>")
    at = lambda where, turn: F.struct(where.alias("range"), F.lit(turn).alias("turn"))
    none = F.array().cast("array<struct<range:int,turn:int>>")
    first = F.col("doc_id").eqNullSafe(F.lit(first_of[0][1]).cast("long")) if first_of else F.lit(False)
    begins = (F.col("home") > 0) & (F.get(table, F.col("home") - 1) == F.col("doc_id"))
    places = F.concat(
        F.array(at(F.col("home"), 0)), F.when(begins, F.array(at(F.col("home") - 1, 1))).otherwise(none),
        F.when(first, F.array(at(F.lit(len(edges)), 2))).otherwise(none),
    )
    dealt = rows.withColumn("home", place).withColumn("at", F.explode(places)).select(*rows.columns, "at.range", "at.turn")
    by = Window.partitionBy("range").orderBy("turn", F.col("doc_id").asc_nulls_first(), "text")
    led = dealt.select("*", *[F.lead(name).over(by).alias(f"next_{name}") for name in names])
    return led.where("turn = 0").drop("range", "turn")


def _at_or_below(edges: list[int], value: Column) -> Column:
    """How many of the sorted edges are at or below value, by halving."""
    table = F.array(*[F.lit(x).cast("long") for x in edges]) if edges else F.array().cast("array<bigint>")
    steps = [1 << k for k in reversed(range(max(len(edges), 1).bit_length()))]
    halve = lambda lo, s: lo + F.when(F.coalesce(F.get(table, lo + s - 1) <= value, F.lit(False)), s).otherwise(0)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(fingerprints(read(spark, sf_dir, "documents")), ["text", "print"])
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - part), F.substring("next_text", F.lit(1), part))
    both = rows.select("doc_id", n.cast("long").alias("n_chars"), "print", "next_print", edited.alias("edited"))
    both = both.select("*", fingerprint(F.col("edited")).alias("edited_print"), F.sha2("edited", 256).alias("edited_sha256"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256",
        to_text(F.col("print")).alias("fingerprint"), to_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
