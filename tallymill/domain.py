"""Attributes with finite sizes, and tables encoded over them."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage


def _listed(attrs: str | Iterable[str]) -> list[str]:
    return [attrs] if isinstance(attrs, str) else list(attrs)


@dataclass(frozen=True)
class Domain:
    """An ordered list of attributes; attribute i takes the codes 0..shape[i]-1."""

    attrs: tuple[str, ...]
    shape: tuple[int, ...]

    def __post_init__(self) -> None:
        object.__setattr__(self, "attrs", tuple(self.attrs))
        object.__setattr__(self, "shape", tuple(int(n) for n in self.shape))
        if len(self.attrs) != len(self.shape):
            raise ValueError("every attribute needs one size")

    @classmethod
    def fromdict(cls, sizes: Mapping[str, int]) -> Domain:
        return cls(tuple(sizes), tuple(sizes.values()))

    @classmethod
    def from_json(cls, path: str, spark: SparkSession | None = None) -> Domain:
        """From whatever store Spark reads; without a session, from a local file."""
        if spark is not None:
            return cls.fromdict(json.loads(storage.read_text(spark, path)))
        with open(path) as f:
            return cls.fromdict(json.load(f))

    def to_json(self, path: str, spark: SparkSession | None = None) -> None:
        if spark is not None:
            return storage.write_text(spark, path, json.dumps(self.config))
        with open(path, "w") as f:
            json.dump(self.config, f)

    @property
    def config(self) -> dict[str, int]:
        return dict(zip(self.attrs, self.shape))

    def project(self, attrs: str | Iterable[str]) -> Domain:
        """The attributes asked for, in the order asked for."""
        return Domain.fromdict({a: self[a] for a in _listed(attrs)})

    transpose = project

    def marginalize(self, attrs: str | Iterable[str]) -> Domain:
        return self.project(self.invert(attrs))

    def invert(self, attrs: str | Iterable[str]) -> list[str]:
        gone = set(_listed(attrs))
        return [a for a in self.attrs if a not in gone]

    def axes(self, attrs: str | Iterable[str]) -> tuple[int, ...]:
        return tuple(self.attrs.index(a) for a in _listed(attrs))

    def canonical(self, attrs: str | Iterable[str]) -> tuple[str, ...]:
        asked = set(_listed(attrs))
        return tuple(a for a in self.attrs if a in asked)

    def merge(self, other: Domain) -> Domain:
        """Both domains' attributes; where both have one, this one's size holds."""
        return Domain.fromdict(self.config | {a: n for a, n in other.config.items() if a not in self})

    def contains(self, other: Domain) -> bool:
        return set(other.attrs) <= set(self.attrs)

    def size(self, attrs: str | Iterable[str] | None = None) -> int:
        return prod(self.shape if attrs is None else self.project(attrs).shape)

    def sort(self, how: str = "size") -> Domain:
        key = (lambda a: self[a]) if how == "size" else None
        return self.project(sorted(self.attrs, key=key))

    def offsets(self) -> dict[str, int]:
        """Where each attribute's block starts in a one-hot row."""
        out, at = {}, 0
        for a, n in zip(self.attrs, self.shape):
            out[a], at = at, at + n
        return out

    def __contains__(self, attr: object) -> bool:
        return attr in self.attrs

    def __getitem__(self, attr: str) -> int:
        return self.shape[self.attrs.index(attr)]

    def __iter__(self) -> Iterator[str]:
        return iter(self.attrs)

    def __len__(self) -> int:
        return len(self.attrs)


def quoted(name: str) -> str:
    """A column's name as an expression; attribute names hold '-' and '>'."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str):
    return F.col(quoted(name))


@dataclass(frozen=True)
class EncodedData:
    """A table of integer codes over a domain, with an optional weight column
    that travels along."""

    df: DataFrame
    domain: Domain
    weight: str | None = None

    def __post_init__(self) -> None:
        missing = [a for a in (*self.domain.attrs, *([self.weight] if self.weight else [])) if a not in self.df.columns]
        if missing:
            raise ValueError(f"columns are missing: {missing}")
        own = [column(a) for a in self.domain.attrs] + ([column(self.weight)] if self.weight else [])
        object.__setattr__(self, "df", self.df.select(*own))

    def project(self, attrs: str | Iterable[str]) -> EncodedData:
        return EncodedData(self.df, self.domain.project(attrs), self.weight)

    def drop(self, attrs: str | Iterable[str]) -> EncodedData:
        return self.project(self.domain.invert(attrs))

    @property
    def records(self) -> int:
        return self.df.count()

    def mass(self):
        """The weight of a row, as a column."""
        return column(self.weight).cast("double") if self.weight else F.lit(1.0)

    def datavector(self, density: bool = False) -> DataFrame:
        """(cell, value): the dense joint histogram in row-major order."""
        from .operators.marginals import answers
        from .plans.workload import QuerySpace

        space = QuerySpace(self.domain, [self.domain.attrs], ordered=False)
        found = answers(self, space, density="valid" if density else None)
        return found.select(F.col("query_id").alias("cell"), F.col("ans").alias("value"))

    @classmethod
    def synthetic(cls, spark: SparkSession, domain: Domain, n: int, seed: int = 0) -> EncodedData:
        """n uniform rows.  Codes are hashed from row number and attribute, so
        they don't depend on partitioning."""
        codes = [F.pmod(F.xxhash64("id", F.lit(seed), F.lit(i)), F.lit(size)).cast("int").alias(a) for i, (a, size) in enumerate(domain.config.items())]
        return cls(spark.range(n).select(*codes), domain)
