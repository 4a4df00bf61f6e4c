"""What the operators of this folder share: reading, folds, joins of uneven
keys, lineage cuts."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, stored as cut

#: White space of every word pattern here: space and tab to carriage return.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: A value that a larger share of the rows than one in HEAVY holds is joined by broadcast.
HEAVY = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row.

    Inside a lambda an outer expression would be computed again for every
    element; a lambda's variable is a value."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The runs of non-space characters, in order; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NOT_SPACE), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else changed."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of doc_id as text, modulo mod; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(mod)


def joined(rows: DataFrame, table: DataFrame, on: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of table, which has one row for a value of on (never
    null) and says in n how many of at most total rows hold it.  Values that more
    than a HEAVY-th of the rows hold, so fewer than HEAVY values, are broadcast;
    the others meet by a shuffle in which no value is large."""
    hot = table.where(F.col("n") * HEAVY > total).drop("n")
    cold = table.where(F.col("n") * HEAVY <= total).drop("n")
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(cold, on, how)
    return rows.join(F.broadcast(hot), on).unionByName(rest)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of tables that nobody holds
    any more: it learns of them when the driver collects its garbage, which may
    else be long after a loop has filled the disks with its rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(df: DataFrame) -> Column:
    """A string for each row that sorts by doc_id, nulls last, then by 128 bits of
    hashes of all columns: equal for equal rows only."""
    own = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    bits = [F.lpad(F.hex(F.xxhash64(F.lit(k), *own)), 16, "0") for k in (0, 1)]
    by_id = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(F.concat(F.lit("0"), by_id), F.lit("1")), *bits)


__all__ = ["cut", "crc_mod", "fresh", "joined", "let", "lower_ascii", "read", "row_key", "shared_folder", "words"]
