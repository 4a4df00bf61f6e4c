"""Geographic keys: state, county, tract, block.

A GEOID is the zero-padded parts in a row (2, 3, 6, 4 digits); a GISJOIN starts
with G and has a 0 after state and county.  Shorter keys leave parts out."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = ("state", "county", "tract", "block")
# The layout of both kinds of key.
#: part: digits, (start, least length) in a GEOID, the same in a GISJOIN
LAYOUT = {"state": (2, (1, 2), (2, 4)), "county": (3, (3, 5), (5, 8)), "tract": (6, (6, 11), (9, 14)), "block": (4, (12, 15), (15, 18))}


def _padded(part: str, value: Column) -> Column:
    return F.lpad(value.cast("string"), LAYOUT[part][0], "0")


def geoid(parts: Mapping[str, Column]) -> Column:
    """Missing parts (nulls) add nothing."""
    return F.concat_ws("", *[_padded(p, parts[p]) for p in PARTS if p in parts])


def gisjoin(parts: Mapping[str, Column]) -> Column:
    zero = lambda p: F.lit("0" if p in ("state", "county") else "")
    return F.concat_ws("", F.lit("G"), *[F.concat(_padded(p, parts[p]), zero(p)) for p in PARTS if p in parts])


def _parsed(key: Column, form: int) -> list[Column]:
    out = []
    for p in PARTS:
        digits, *layouts = LAYOUT[p]
        start, least = layouts[form]
        out.append(F.when(F.length(key) >= least, F.substring(key, start, digits).cast("int")).alias(p))
    return out


def parse_geoid(key: Column) -> list[Column]:
    return _parsed(key, 0)


def parse_gisjoin(key: Column) -> list[Column]:
    return _parsed(key, 1)


def contains(outer: Mapping[str, int | None]) -> Column:
    """Whether a row's place lies in outer; parts that outer leaves open match all."""
    ok = F.lit(True)
    for p in PARTS:
        if outer.get(p) is not None:
            ok = ok & (F.col(p) == F.lit(outer[p]))
    return ok


def roll_up(df: DataFrame, level: str) -> DataFrame:
    """Places cut to a level: parts below it become null."""
    below = PARTS[PARTS.index(level) + 1 :]
    return df.withColumns({p: F.lit(None).cast("int") for p in below if p in df.columns})


def select_place(df: DataFrame, columns: Mapping[str, str], where: Mapping[str, int | None]) -> DataFrame:
    """Rows of a place; columns names the column of each part.  Equalities reach
    the scan, and a table partitioned by one of them is pruned."""
    for p in PARTS:
        if where.get(p) is not None:
            df = df.where(F.col(columns[p]) == F.lit(where[p]))
    return df


def nearest_size(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, key, n): for each target the group whose row count n is nearest;
    ties go to the smaller key.  sizes is (key, n), targets a handful of rows."""
    both = sizes.join(F.broadcast(targets))
    best = F.min(F.struct(F.abs(F.col("n") - F.col("target")).alias("d"), "key", "n"))
    return both.groupBy("target").agg(best.alias("b")).select("target", "b.key", "b.n")
