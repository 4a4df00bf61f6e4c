"""Schemas of allowed values, and queries and persons encoded by them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import prod

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..domain import Domain
from ..operators.setrelation import SetQueries, relation_answers
from ..operators.support import full_support
from . import census, encode, geo


#: Tasks that a place's persons are dealt to, at most.
SLICES = 16


@dataclass
class DataSchema:
    """Columns with their allowed values, in order."""

    values: dict[str, list] = field(default_factory=dict)

    @classmethod
    def infer(cls, df: DataFrame, columns: Sequence[str] | None = None) -> DataSchema:
        """Distinct values of every column, by one aggregation; nulls are left out.
        A column of more values than a list may hold is an error."""
        names = list(columns or df.columns)
        row = encode.union_domain(df, names, []).first()
        return cls({c: list(row[c]) for c in names})

    def add_column(self, name: str, values: Sequence) -> DataSchema:
        if name in self.values:
            raise ValueError(f"{name} is there already")
        self.values[name] = list(values)
        return self

    def index(self, name: str) -> int:
        return list(self.values).index(name)

    def __len__(self) -> int:
        return len(self.values)

    @property
    def domain(self) -> Domain:
        return Domain.fromdict({c: len(v) for c, v in self.values.items()})

    def row_space_size(self) -> int:
        return prod(len(v) for v in self.values.values())

    def row_space(self, spark: SparkSession) -> DataFrame:
        """Every combination of allowed values."""
        rows = full_support(spark, self.domain).drop("support_id")
        for c, v in self.values.items():
            rows = encode.decode(rows, c, v)
        return rows

    def __str__(self) -> str:
        return "\n".join(f"{c}: {len(v)} values" for c, v in self.values.items())


# The person columns and what they may hold.
PERSON = {"QAGE": list(range(116)), "QSEX": ["Female", "Male"], "CENRACE": list(range(1, 64)), "CENHISP": [census.HLO, census.NOT_HLO]}


def census_schema(persons: DataFrame, blocks: bool = True) -> tuple[DataSchema, DataFrame]:
    """The schema of recoded persons and the persons: blocks in the data (or one
    block -1), declared domains for the rest."""
    df = persons.select(
        F.col("TABBLK") if blocks else F.lit(-1).alias("TABBLK"), "QAGE",
        encode.recode_sex(F.col("QSEX")).alias("QSEX"), "CENRACE", encode.recode_origin(F.col("CENHISP")).alias("CENHISP"),
    )
    schema = DataSchema.infer(df, ["TABBLK"]) if blocks else DataSchema({"TABBLK": [-1]})
    for c, v in PERSON.items():
        schema.add_column(c, v)
    return schema, df


def census_encoder(schema: DataSchema) -> encode.Encoder:
    """All columns categorical, with the schema's values declared."""
    return encode.Encoder(encode.Config(categorical=list(schema.values), declared=schema.values))


def coded_queries(queries: Sequence[Mapping[str, Sequence]], schema: DataSchema) -> list[dict[str, list[int]]]:
    """Raw allowed values as codes."""
    place = {c: {v: i for i, v in enumerate(vs)} for c, vs in schema.values.items()}
    return [{a: [place[a][v] for v in vs] for a, vs in q.items()} for q in queries]


def random_place(df: DataFrame, key: str, seed: int = 0):
    """One of the distinct keys: with n keys in sorted order, the one that NumPy's
    legacy generator draws of n.  Keys are numbered as a table; one comes back."""
    table = encode.numbered(df, key)
    at = int(np.random.RandomState(seed).randint(table.count()))
    return table.where(F.col("code") == at).first()["value"]


def write_places(persons: DataFrame, columns: Mapping[str, str], level: str, path: str) -> None:
    """Persons by place, one folder for each place of a level, in one pass.  A
    place of many persons is written by several tasks."""
    keyed = _placed(persons, columns, level)
    keyed.repartition("geoid", F.pmod(F.xxhash64(*persons.columns), F.lit(SLICES))).write.mode("overwrite").partitionBy("geoid").parquet(path)


def _placed(persons: DataFrame, columns: Mapping[str, str], level: str) -> DataFrame:
    parts = geo.PARTS[: geo.PARTS.index(level) + 1]
    return persons.withColumn("geoid", geo.geoid({p: F.col(columns[p]) for p in parts}))


@dataclass(frozen=True)
class Release:
    """What is needed to release every place of a level, each a table with geoid.
    rows: coded persons.  domain: (geoid, attr, size).  queries: (geoid, block,
    table_name, cell, ages, sexes, races, origins): allowed codes, null for all."""

    rows: DataFrame
    domain: DataFrame
    queries: DataFrame

    def asked(self, level: str = "Block") -> SetQueries:
        """The queries of one level as masks, by block or by place."""
        person = Domain.fromdict({c: len(v) for c, v in PERSON.items()})
        own = self.queries.where(F.col("block").isNotNull() if level == "Block" else F.col("block").isNull())
        codes = {"QAGE": "ages", "QSEX": "sexes", "CENRACE": "races", "CENHISP": "origins"}
        return SetQueries.of_arrays(own if level == "Block" else own.drop("block"), person, codes, ["geoid", "block"] if level == "Block" else ["geoid"])

    def answers(self, slices: int = 1) -> DataFrame:
        """(geoid, block, table_name, cell, ans): every query of every place; block
        is null for those of the whole place."""
        rows = self.rows.withColumnRenamed("TABBLK", "block")
        blocks, whole = (relation_answers(rows, self.asked(level), slices=slices) for level in ("Block", "Tract"))
        return blocks.unionByName(whole.withColumn("block", F.lit(None).cast("int")))

    def write(self, path: str) -> None:
        """Three folders by place; those that are there already stay."""
        spark = self.rows.sparkSession
        for name, df in (("rows", self.rows), ("domain", self.domain), ("queries", self.queries)):
            if not storage.exists(spark, f"{path}/{name}/_SUCCESS"):
                df.write.mode("overwrite").partitionBy("geoid").parquet(f"{path}/{name}")


def release_places(persons: DataFrame, columns: Mapping[str, str], level: str, complete: bool = False, blocks: bool = True) -> Release:
    """Every place of a level encoded over its own blocks and the declared person
    columns, with its domain and its census queries; all places in one pass.
    Without blocks a place is one block, -1."""
    block = F.col(columns["block"]) if blocks else F.lit(-1)
    own = _placed(persons, columns, level).select(
        "geoid", block.alias("__block"), F.col("QAGE").cast("int").alias("QAGE"), encode.recode_sex(F.col("QSEX")).alias("QSEX"),
        F.col("CENRACE").cast("int").alias("CENRACE"), encode.recode_origin(F.col("CENHISP")).alias("CENHISP"),
    )
    seen = own.select("geoid", "__block").distinct()
    coded = seen.withColumn("TABBLK", (F.row_number().over(Window.partitionBy("geoid").orderBy("__block")) - 1).cast("int"))
    named = coded.select(F.col("geoid").alias("__g"), F.col("__block").alias("__b"), "TABBLK")
    rows = own.join(named, (F.col("geoid") == F.col("__g")) & F.col("__block").eqNullSafe(F.col("__b"))).select("geoid", "TABBLK", *PERSON)
    for c, values in PERSON.items():
        rows = encode.encode(rows, c, values)
    n_blocks = coded.groupBy("geoid").agg(F.count(F.lit(1)).cast("int").alias("n"))
    sizes = F.array(F.struct(F.lit("TABBLK").alias("attr"), F.col("n").alias("size")), *[F.struct(F.lit(c).alias("attr"), F.lit(len(v)).alias("size")) for c, v in PERSON.items()])
    domain = n_blocks.select("geoid", F.explode(sizes).alias("d")).select("geoid", "d.*")
    cells = persons.sparkSession.createDataFrame([_coded_cell(c) for c in census.cells_of(complete, tract=True)], CELL)
    # block cells for each block, tract cells once; the cell list is metadata
    of_blocks = coded.select("geoid", F.col("TABBLK").alias("block"), F.lit("Block").alias("of"))
    of_places = n_blocks.select("geoid", F.lit(None).cast("int").alias("block"), F.lit("Tract").alias("of"))
    queries = of_blocks.unionByName(of_places).join(F.broadcast(cells), F.col("of") == F.col("level")).drop("of", "level")
    return Release(rows, domain, queries)


CELL = "table_name string, cell int, level string, ages array<int>, sexes array<int>, races array<int>, origins array<int>"


def _coded_cell(cell: census.Cell) -> tuple:
    place = {c: {v: i for i, v in enumerate(vs)} for c, vs in PERSON.items()}
    own = cell.allowed()
    return (cell.table, cell.cell, cell.level, *[[place[c][v] for v in own[c]] if c in own else None for c in PERSON])
