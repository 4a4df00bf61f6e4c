"""Set queries as a relation: a row for each query, its allowed codes as bit masks.

An attribute of n codes takes ceil(n / 64) longs; a query that leaves it free has
all bits of all of them set, more than any list of codes can set.  A row of data
finds its queries by bit tests within its place, after both sides were dealt by
place; rows are counted by their codes before, so a place has at most as many
rows as its codes allow, however many persons it has.  Nothing is listed on the
driver, and repeated queries are equal masks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..domain import Domain, column

WORD = 64


def words(size: int) -> int:
    return -(-size // WORD)


def name_of(attr: str) -> str:
    """The column of an attribute's mask."""
    return f"__in_{attr}"


def _bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (code % WORD).cast("int"))


def mask(codes: Column, size: int) -> Column:
    """array<bigint> of an array of codes; null and no codes at all mean any.
    Codes outside the domain allow nothing."""
    good = F.filter(codes, lambda c: (c >= 0) & (c < size))

    def word(k: int) -> Column:
        here = F.filter(good, lambda c: c.between(WORD * k, WORD * (k + 1) - 1))
        return F.aggregate(here, F.lit(0).cast("bigint"), lambda m, c: m.bitwiseOR(_bit(c)))

    of = [word(k) for k in range(words(size))]
    free = F.coalesce(F.size(codes), F.lit(0)) <= 0
    return F.when(free, F.array(*[F.lit(-1).cast("bigint")] * words(size))).otherwise(F.array(*of))


def allows(own: Column, code: Column, size: int) -> Column:
    """Whether a mask allows a row's code; a missing one only if any is allowed."""
    inside = code.between(0, size - 1)
    at = own[0] if words(size) == 1 else F.get(own, F.floor(code / WORD).cast("int"))
    hit = F.call_function("shiftright", at, (code % WORD).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    free = own[0] == -1
    for k in range(1, words(size)):
        free = free & (own[k] == -1)
    return F.when(inside, hit).otherwise(free)


@dataclass(frozen=True)
class SetQueries:
    """df: the columns of `by`, those that name a query in its place, and one mask
    column for each attribute."""

    df: DataFrame
    domain: Domain
    by: tuple[str, ...] = ()

    @classmethod
    def of_arrays(cls, df: DataFrame, domain: Domain, codes: Mapping[str, str], by: Sequence[str] = ()) -> SetQueries:
        """From a row for each query with arrays of codes; codes names the arrays."""
        masks = [mask(column(codes[a]), domain[a]).alias(name_of(a)) for a in domain.attrs]
        rest = [column(c) for c in df.columns if c not in codes.values()]
        return cls(df.select(*rest, *masks), domain, tuple(by))

    @classmethod
    def of_relation(cls, values: DataFrame, domain: Domain, queries: DataFrame, by: Sequence[str] = ()) -> SetQueries:
        """From the queries, and a row (their columns, attr, code) for each code
        that one of them allows: masks are put together by bitwise aggregation."""
        keys, none = queries.columns, F.lit(0).cast("bigint")
        sums = []
        for a in domain.attrs:
            for k in range(words(domain[a])):
                here = (F.col("attr") == a) & F.col("code").between(WORD * k, min(WORD * (k + 1), domain[a]) - 1)
                sums.append(F.bit_or(F.when(here, _bit(F.col("code"))).otherwise(none)).alias(f"__w_{a}_{k}"))
            sums.append(F.max(F.col("attr") == a).alias(f"__has_{a}"))
        own = [column(k) for k in keys]
        found = queries.join(values.groupBy(*own).agg(*sums), keys, "left")
        masks = []
        for a in domain.attrs:
            n = range(words(domain[a]))
            named = F.when(column(f"__has_{a}"), F.array(*[column(f"__w_{a}_{k}") for k in n]))
            masks.append(F.coalesce(named, F.array(*[F.lit(-1).cast("bigint") for _ in n])).alias(name_of(a)))
        return cls(found.select(*own, *masks), domain, tuple(by))

    @property
    def masks(self) -> list[str]:
        return [name_of(a) for a in self.domain.attrs]

    def distinct(self) -> SetQueries:
        """Without repetitions in a place; the first by its other columns stays."""
        by, masks = [column(b) for b in self.by], [column(m) for m in self.masks]
        others = [column(c) for c in self.df.columns if c not in (*self.by, *self.masks)]
        first = self.df.groupBy(*by, *masks).agg(F.min(F.struct(*others)).alias("q"))
        return SetQueries(first.select(*by, "q.*", *masks), self.domain, self.by)

    def restricted(self, attr: str) -> Column:
        """Whether a query limits an attribute."""
        return ~F.forall(column(name_of(attr)), lambda w: w == -1)

    def attribute_sets(self) -> DataFrame:
        """(attrs, n): the sets of attributes that queries limit."""
        named = [F.when(self.restricted(a), F.lit(a)) for a in self.domain.attrs]
        return self.df.groupBy(F.filter(F.array(*named), lambda a: a.isNotNull()).alias("attrs")).agg(F.count(F.lit(1)).alias("n"))


def relation_answers(rows: DataFrame, queries: SetQueries, weight: str | None = None, density: bool = False, slices: int = 1) -> DataFrame:
    """The queries without their masks, and ans: the weight of the rows of the
    query's place that it counts.  rows has the columns of `by` and the domain's
    attributes.  slices: parts that a place's rows are dealt to by their codes,
    each of which meets a copy of the place's queries; a large place without
    bounds on its codes, or queries without places, need several.  density
    divides by the weight of the place's rows."""
    by, domain = list(queries.by), queries.domain
    codes = {f"__c{i}": column(a).cast("bigint") for i, a in enumerate(domain.attrs)}
    mass = column(weight).cast("double") if weight else F.lit(1.0)
    counted = rows.groupBy(*[column(b) for b in by], *[c.alias(n) for n, c in codes.items()]).agg(F.sum(mass).alias("__n"))
    dealt = counted.withColumn("__slice", F.pmod(F.xxhash64(*codes), F.lit(slices)).cast("int")).alias("c")
    asked = queries.df.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).alias("q")
    met = F.col("q.__slice") == F.col("c.__slice")
    for b in by:
        met = met & F.col(f"q.`{b}`").eqNullSafe(F.col(f"c.`{b}`"))
    for n, a in zip(codes, domain.attrs):
        met = met & allows(F.col(f"q.`{name_of(a)}`"), F.col(f"c.{n}"), domain[a])
    kept = [F.col(f"q.`{c}`").alias(c) for c in queries.df.columns if c not in queries.masks]
    sums = asked.join(dealt, met, "left").groupBy(*kept).agg(F.coalesce(F.sum("c.__n"), F.lit(0.0)).alias("ans")).alias("s")
    if not density:
        return sums
    whole = counted.groupBy(*[column(b) for b in by]).agg(F.sum("__n").alias("__all")).alias("t")
    same = F.lit(True)
    for b in by:
        same = same & F.col(f"s.`{b}`").eqNullSafe(F.col(f"t.`{b}`"))
    share = F.when(F.col("t.__all") > 0, F.col("s.ans") / F.col("t.__all")).otherwise(0.0)
    return sums.join(whole, same, "left").select(*[F.col(f"s.`{c}`").alias(c) for c in sums.columns if c != "ans"], share.alias("ans"))
