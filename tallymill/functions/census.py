"""Races, census tables as set queries, and their codes.

A race id numbers the non-empty subsets of six major races by size, then in the
races' order.  A table cell is a conjunction of allowed ages, sexes, races and
origins; an absent attribute allows everything."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The major races in the order of the record layout.
RACES = ("White", "Black or African American", "American Indian and Alaska Native", "Asian", "Native Hawaiian and Other Pacific Islander", "Some Other Race")
# Bands of the sex-by-age tables, first and last age.
AGE_BANDS = (
    (0, 4), (5, 9), (10, 14), (15, 17), (18, 19), (20, 20), (21, 21), (22, 24), (25, 29), (30, 34), (35, 39), (40, 44),
    (45, 49), (50, 54), (55, 59), (60, 61), (62, 64), (65, 66), (67, 69), (70, 74), (75, 79), (80, 84), (85, 115),
)
# Table codes of the historical data files.
NHGIS = {
    "P1": "H7V", "P6": "H70", "P7": "H71", "P9": "H73", "P11": "H75", "P12": "H76", "P12A": "H9A", "P12B": "H9B", "P12C": "H9C",
    "P12D": "H9D", "P12E": "H9E", "P12F": "H9F", "P12G": "H9G", "P12H": "H9H", "P12I": "H9I",
}
HLO, NOT_HLO = "HLO", "Not HLO"

SETS: list[frozenset[int]] = [frozenset(c) for k in range(1, 7) for c in combinations(range(6), k)]


def race_id(members: Iterable[int]) -> int:
    return SETS.index(frozenset(members)) + 1


def races_where(test: Callable[[frozenset[int]], bool]) -> list[int]:
    """Ids of the races whose members pass a test."""
    return [i for i, s in enumerate(SETS, 1) if test(s)]


def race_name(id_: int) -> str:
    names = [RACES[i] for i in sorted(SETS[id_ - 1])]
    return f"{names[0]} alone" if len(names) == 1 else "; ".join(names)


def parse_race(name: str) -> int:
    own = [r.lower() for r in RACES]
    parts = [p.strip().lower() for p in name.removesuffix(" alone").split(";") if p.strip()]
    return race_id(own.index(p) for p in parts)


def race_table(spark: SparkSession) -> DataFrame:
    """(race_id, mask, n_races, name), 63 rows."""
    rows = [(i, sum(1 << k for k in s), race_name(i)) for i, s in enumerate(SETS, 1)]
    t = spark.createDataFrame(rows, "race_id int, mask int, name string")
    return t.select("race_id", "mask", F.bit_count("mask").cast("int").alias("n_races"), "name")


@dataclass(frozen=True)
class Cell:
    table: str
    cell: int
    ages: tuple[int, ...] | None = None
    sexes: tuple[str, ...] | None = None
    races: tuple[int, ...] | None = None
    origins: tuple[str, ...] | None = None
    level: str = "Block"
    in_2020: bool = True

    def allowed(self) -> dict[str, tuple]:
        """Attribute -> allowed raw values, wildcards left out."""
        own = {"QAGE": self.ages, "QSEX": self.sexes, "CENRACE": self.races, "CENHISP": self.origins}
        return {a: v for a, v in own.items() if v is not None}


def _race_cells(table: str, complete: bool, **fixed) -> list[Cell]:
    """Cells 4..73 of the tables by number of races: each count of races is
    followed by its combinations; the last cell repeats all six."""
    own = {"origins": (NOT_HLO,)} | fixed
    out = [Cell(table, 4, races=tuple(races_where(lambda s: len(s) == 1)), **own)]
    out += [Cell(table, 5 + i, races=(race_id([i]),), **own) for i in range(6)]
    out.append(Cell(table, 11, races=tuple(races_where(lambda s: len(s) >= 2)), **own))
    at = 12
    for k in range(2, 7):
        out.append(Cell(table, at, races=tuple(races_where(lambda s, k=k: len(s) == k)), **own))
        members = list(combinations(range(6), k))
        for j, c in enumerate(members):
            # the adult table leaves out its last triple unless complete
            if complete or not (table == "P11" and k == 3 and j == len(members) - 1):
                out.append(Cell(table, at + 1 + j, races=(race_id(c),), **own))
        at += 1 + len(members)
    return out


def _by_age(table: str, bands: Iterable[tuple[int, int]], complete: bool = True, **fixed) -> list[Cell]:
    """Total, then for each sex its total and its age bands."""
    bands = list(bands)
    n = len(bands)
    out = [Cell(table, 1, **fixed), Cell(table, 2, sexes=("Male",), **fixed)]
    out += [Cell(table, 3 + i, ages=tuple(range(a, b + 1)), sexes=("Male",), **fixed) for i, (a, b) in enumerate(bands)]
    out.append(Cell(table, 3 + n, sexes=("Female",), **fixed))
    if complete:
        out += [Cell(table, 4 + n + i, ages=tuple(range(a, b + 1)), sexes=("Female",), **fixed) for i, (a, b) in enumerate(bands)]
    return out


def _variants() -> list[tuple[str, dict]]:
    """Table letters A..N with the races and origins that they are limited to."""
    alone = [{"races": (race_id([i]),)} for i in range(6)]
    many = {"races": tuple(races_where(lambda s: len(s) >= 2))}
    limits = [*alone, many, {"origins": (HLO,)}, *[a | {"origins": (NOT_HLO,)} for a in alone]]
    return list(zip("ABCDEFGHIJKLMN", limits))


def census_cells(complete: bool = False) -> list[Cell]:
    """All table cells.  complete adds the cells that the usual definitions miss
    (women's age bands of P12 and its variants, the last triple of P11)."""
    out = [Cell("P1", 1)]
    having = [tuple(races_where(lambda s, i=i: i in s)) for i in range(6)]
    out += [Cell("P6", 2 + i, races=r) for i, r in enumerate(having)]
    out += [Cell("P7", 3 + i, races=r, origins=(NOT_HLO,)) for i, r in enumerate(having)]
    out += [Cell("P7", 10 + i, races=r, origins=(HLO,)) for i, r in enumerate(having)]
    out += _race_cells("P9", complete)
    adult = tuple(range(18, 116))
    out += [Cell("P11", 1, ages=adult), Cell("P11", 2, ages=adult, origins=(HLO,)), Cell("P11", 3, ages=adult, origins=(NOT_HLO,))]
    out += _race_cells("P11", complete, ages=adult)
    out += _by_age("P12", AGE_BANDS, complete)
    for letter, limit in _variants()[:9]:
        out += _by_age(f"P12{letter}", AGE_BANDS, complete, **limit)
    single = [*((a, a) for a in range(100)), (100, 104), (105, 109), (110, 115)]
    out += _by_age("PCT1", single, level="Tract")
    for letter, limit in _variants():
        out += _by_age(f"PCT12{letter}", single, level="Tract", in_2020=False, **limit)
    return out


def nhgis_code(table: str, cell: int, kind: str = "_dp") -> str:
    return f"{NHGIS[table]}{cell:03}{kind}"


def cells_of(complete: bool = False, tract: bool = False, older: bool = False) -> list[Cell]:
    """The cells for use: block-level ones, tract-level ones if asked for, those
    of the older tables if asked for."""
    return [c for c in census_cells(complete) if (c.level == "Block" or tract) and (c.in_2020 or older)]


def set_relation(spark: SparkSession, cells: Iterable[Cell]) -> DataFrame:
    """(qid, attr, value): one row for each allowed raw value."""
    rows = [(q, a, str(v)) for q, c in enumerate(cells) for a, vs in c.allowed().items() for v in vs]
    return spark.createDataFrame(rows, "qid int, attr string, value string")


def by_block(cells: list[Cell], blocks: Iterable) -> list[dict[str, tuple]]:
    """Set queries: block-level cells once for each block, tract-level ones once;
    those without any predicate are left out."""
    out = [c.allowed() | {"TABBLK": (b,)} for b in blocks for c in cells if c.level == "Block"]
    return out + [c.allowed() for c in cells if c.level == "Tract" and c.allowed()]
