"""Places of regular-expression matches, as DataFrame expressions.

Spark's regular-expression functions return strings, not places.  A text cut at
a pattern gives the gaps between its matches; gaps and matches in turn give
every start by adding up lengths, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string,score:double>>"


def none() -> Column:
    return F.array().cast(SPAN)


def find(text: Column, pattern: str, kind: str, rank: int, keep, group: int = 0, when: Column | None = None) -> Column:
    """Spans of the leftmost non-overlapping matches for which keep(group's
    text) holds.  A match that fails is dropped and not tried again.  when: a
    cheap test that every text with a match passes."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    rows = F.arrays_zip(
        F.transform(F.split(text, pattern), lambda g: F.length(g)).alias("gap"), matches.alias("match"), parts.alias("part")
    )
    zero = F.struct(F.lit(0).alias("at"), none().alias("found"))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + row["gap"]
        end = start + F.coalesce(F.length(row["match"]), F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"),
            row["match"].alias("value"), F.lit(1.0).alias("score"),
        )
        more = F.when(row["match"].isNotNull() & keep(row["part"]), F.array(span)).otherwise(none())
        return F.struct(end.alias("at"), F.concat(acc["found"], more).alias("found"))

    found = F.aggregate(rows, zero, step, lambda acc: acc["found"])
    there = text.rlike(pattern) if when is None else when & text.rlike(pattern)
    return F.when(there, found).otherwise(none())


def find_ahead(text: Column, pattern: str, kind: str, rank: int, take) -> Column:
    """Spans that begin at matches of pattern, whose group 1 looks beyond the
    match: take(group 1) is the span's text, null for none.  Of spans that
    overlap the leftmost stays."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), take)
    rows = F.arrays_zip(
        F.transform(F.split(text, pattern), lambda g: F.length(g)).alias("gap"), matches.alias("match"), parts.alias("part")
    )
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("free"), none().alias("found"))

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + row["gap"]
        end = start + F.coalesce(F.length(row["part"]), F.lit(0))
        good = row["part"].isNotNull() & (start >= acc["free"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"),
            row["part"].alias("value"), F.lit(1.0).alias("score"),
        )
        return F.struct(
            (start + F.coalesce(F.length(row["match"]), F.lit(0))).alias("at"), F.when(good, end).otherwise(acc["free"]).alias("free"),
            F.concat(acc["found"], F.when(good, F.array(span)).otherwise(none())).alias("found"),
        )

    return F.when(text.rlike(pattern), F.aggregate(rows, zero, step, lambda acc: acc["found"])).otherwise(none())


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def by_start(spans: Column) -> Column:
    """By start, then the kind's rank."""
    return F.array_sort(spans)


def by_rank(spans: Column) -> Column:
    """By the kind's rank, then start."""
    key = F.transform(spans, lambda s: F.struct(s["rank"].alias("r"), s["start"].alias("at"), s.alias("s")))
    return F.transform(F.array_sort(key), lambda x: x["s"])


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def replaced(text: Column, spans: Column, mark) -> Column:
    """text with every span (sorted by start; overlapping ones as one) replaced
    by mark(span)."""

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), mark(s)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, zero, step, lambda acc: F.concat_ws("", F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text))))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


__all__ = ["SPAN", "by_rank", "by_start", "count", "digest", "find", "find_ahead", "joined", "let", "none", "overlaps", "replaced"]
