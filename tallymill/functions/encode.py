"""Raw columns to integer codes and back."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..domain import Domain, column
from ..storage import stored

OTHER = "_OTHER"
#: Values of a column that are held as a list, at most; more are numbered as a table.
LISTED = 1_000_000
INF = math.inf

# Edges and attribute lists of the two known raw tables.
AGE_BINS = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, INF]
GAIN_BINS = [0, 0, 1000, 2000, 3000, 4000, 5000, 7500, 10000, 15000, 20000, 30000, 50000, INF]
LOSS_BINS = [0, 0, 1000, 2000, 3000, 4000, INF]
ADULT = {
    "categorical": ["workclass", "education", "marital-status", "occupation", "relationship", "race", "sex", "native-country", "income>50K"],
    "bins": {"age": AGE_BINS, "capital-gain": GAIN_BINS, "capital-loss": LOSS_BINS, "hours-per-week": AGE_BINS},
}
CENSUS = {
    "categorical": [
        "class_of_worker", "detailed_industry_recode", "detailed_occupation_recode", "education", "enroll_in_edu_inst_last_wk", "marital_stat",
        "major_industry_code", "major_occupation_code", "race", "hispanic_origin", "sex", "member_of_a_labor_union", "reason_for_unemployment",
        "full_or_part_time_employment_stat", "tax_filer_stat", "region_of_previous_residence", "state_of_previous_residence",
        "detailed_household_and_family_stat", "detailed_household_summary_in_household", "migration_code-change_in_msa",
        "migration_code-change_in_reg", "migration_code-move_within_reg", "live_in_this_house_1_year_ago", "migration_prev_res_in_sunbelt",
        "num_persons_worked_for_employer", "family_members_under_18", "country_of_birth_father", "country_of_birth_mother",
        "country_of_birth_self", "citizenship", "own_business_or_self_employed", "fill_inc_questionnaire_for_veterans_admin",
        "veterans_benefits", "year", "income",
    ],
    "bins": {
        "age": AGE_BINS,
        "wage_per_hour": [0, 0, 100, 200, 300, 400, 500, 600, 800, 1000, 1200, 1400, 1600, 2000, 3000, 4000, 5000, INF],
        "capital_gains": GAIN_BINS,
        "capital_losses": LOSS_BINS,
        "dividends_from_stocks": [0, 0, 100, 200, 300, 500, 1000, 2500, 5000, 10000, 25000, 50000, INF],
        "weeks_worked_in_year": [0, 0, 20, 40, 52, INF],
    },
}


@dataclass(frozen=True)
class Config:
    """categorical: columns to label.  bins: numeric columns with their edges, a
    number of equal bins, or nothing (default_bins).  declared: values of a
    categorical column beyond those in the data."""

    categorical: Sequence[str] = ()
    bins: Mapping[str, Sequence[float] | int | None] = field(default_factory=dict)
    declared: Mapping[str, Sequence] = field(default_factory=dict)


def known_config(name: str) -> Config:
    return Config(**{"adult": ADULT, "census": CENSUS}[name])


# Labels ------------------------------------------------------------------


def dictionary(df: DataFrame, attr: str, declared: Iterable = (), other: bool = False, most: int = LISTED) -> list:
    """The values of a column, sorted by their own order, with the declared ones
    and, if asked for, one for all that turn up later.  A column of more than most
    values is numbered by numbered() instead."""
    if declared:
        return sorted(set(declared) | ({OTHER} if other else set()))
    found = df.select(column(attr)).where(column(attr).isNotNull()).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"{attr} has more than {most} values: number them by numbered() and encode_numbered()")
    return sorted({r[0] for r in found} | ({OTHER} if other else set()))


#: Kinds of values by the column that holds them in a fused dictionary.
_KINDS = ("l", "d", "s")
#: Values of a column that are coded from memory, at most; more are met by a shuffle.
HELD = 100_000


def _kind(dtype: str) -> str:
    return "l" if dtype in ("tinyint", "smallint", "int", "bigint", "boolean") else "d" if dtype in ("float", "double") else "s"


def _as(value: Column, kind: str) -> Column:
    return value.cast({"l": "bigint", "d": "double", "s": "string"}[kind])


def fused_dictionary(df: DataFrame, attrs: Sequence[str], extra: Mapping[str, Iterable] | None = None) -> DataFrame:
    """(i, l, d, s, code): every value of every attribute (the i-th) in the column
    of its kind, with its place in the attribute's sorted order; extra values are
    added.  All attributes take one distinct and one sort by ranges; one count for
    each range and attribute in it reaches the driver."""
    kinds = [_kind(dict(df.dtypes)[a]) for a in attrs]

    def cell(i: int, value: Column) -> Column:
        return F.struct(F.lit(i).alias("i"), *[(_as(value, k) if k == kinds[i] else _as(F.lit(None), k)).alias(k) for k in _KINDS])

    rows = df.select(F.explode(F.array(*[cell(i, column(a)) for i, a in enumerate(attrs)])).alias("x")).select("x.*")
    named = [(i, v) for i, a in enumerate(attrs) for v in (extra or {}).get(a, ())]
    if named:
        told = df.sparkSession.range(1).select(F.explode(F.array(*[cell(i, F.lit(v)) for i, v in named])).alias("x")).select("x.*")
        rows = rows.unionByName(told)
    values = rows.where(F.coalesce(*[F.col(k).cast("string") for k in _KINDS]).isNotNull()).distinct()
    order = ["i", *_KINDS]
    held = stored(values.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    starts, before = {}, {}
    for r in sorted(held.groupBy(part.alias("part"), "i").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("n")).collect()):
        starts[r["part"], r["i"]] = before.get(r["i"], 0) - r["first"]
        before[r["i"]] = before.get(r["i"], 0) + r["n"]
    moved = df.sparkSession.createDataFrame([(p, i, n) for (p, i), n in starts.items()], "__p int, __i int, __n bigint")
    met = held.join(F.broadcast(moved), (part == F.col("__p")) & (F.col("i") == F.col("__i")))  # one row for each range and attribute
    return met.select(*order, (F.col("__at") + F.col("__n")).alias("code"))


def numbered(df: DataFrame, attr: str) -> DataFrame:
    """(value, code): every value with its place in sorted order, as a table."""
    kind = dict(df.dtypes)[attr]
    return fused_dictionary(df, [attr]).select(F.col(_kind(kind)).cast(kind).alias("value"), "code")


def code_from_memory(df: DataFrame, values: Mapping[str, Sequence], other: bool = False) -> DataFrame:
    """Attributes replaced by their places in lists of values, all in one pass of
    Arrow batches.  Unknown values become OTHER's code or, without it, an error;
    nulls become -1."""
    names = df.columns
    tables = {a: pa.array([_plain(v) for v in vs], {"l": pa.int64(), "d": pa.float64(), "s": pa.string()}[_kind(dict(df.dtypes)[a])]) for a, vs in values.items()}
    instead = {a: list(vs).index(OTHER) if other and OTHER in vs else None for a, vs in values.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for name in names:
                own = batch.column(name)
                if name in tables:
                    at = pc.index_in(own, tables[name])
                    lost = pc.and_(pc.is_valid(own), pc.is_null(at))
                    if instead[name] is None and pc.any(lost).as_py():
                        raise ValueError(f"{name}: unknown value {own.filter(lost)[0].as_py()}")
                    own = pc.if_else(pc.is_null(own), pa.scalar(-1, pa.int32()), pc.fill_null(at, -1 if instead[name] is None else instead[name]))
                columns.append(own)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(df.dtypes)
    ready = df.select(*[_as(column(c), _kind(kinds[c])).alias(c) if c in tables else column(c) for c in names])
    schema = StructType([StructField(c, IntegerType()) if c in tables else ready.schema[c] for c in names])
    return ready.mapInArrow(run, schema)


def _plain(value):
    """A value as its kind holds it."""
    return int(value) if isinstance(value, bool) else value


def encode_numbered(df: DataFrame, attr: str, table: DataFrame, to: str | None = None) -> DataFrame:
    """attr replaced by its code in table (value, code), met by a shuffle; nulls
    and values that the table lacks become -1."""
    met = df.join(table.select(F.col("value").alias("__v"), F.col("code").alias("__c")), column(attr) == F.col("__v"), "left")
    return met.withColumn(to or attr, F.coalesce("__c", F.lit(-1).cast("long"))).drop("__v", "__c")


def encode(df: DataFrame, attr: str, values: Sequence, other: bool = False, to: str | None = None) -> DataFrame:
    """attr replaced by its place in values.  Unknown values become OTHER's code
    or, without it, an error when the row is read; nulls become -1."""
    spark, name = df.sparkSession, to or attr
    kind = dict(df.dtypes)[attr]
    table = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"__v {kind}, __c int")
    joined = df.join(F.broadcast(table), column(attr) == F.col("__v"), "left")
    unknown = F.lit(list(values).index(OTHER)) if other else F.raise_error(F.concat(F.lit(f"{attr}: unknown value "), column(attr).cast("string"))).cast("int")
    code = F.when(column(attr).isNull(), F.lit(-1)).when(F.col("__c").isNull(), unknown).otherwise(F.col("__c"))
    return joined.withColumn(name, code).drop("__v", "__c")


def decode(df: DataFrame, attr: str, values: Sequence, to: str | None = None) -> DataFrame:
    table = F.array(*[F.lit(v) for v in values])
    return df.withColumn(to or attr, F.when(column(attr) >= 0, F.get(table, column(attr))))


def _back(value, kind: str):
    return bool(value) if kind == "boolean" else value


# Bins --------------------------------------------------------------------


def equal_edges(low: float, high: float, n: int) -> list[float]:
    """n bins of equal width between the extremes, open at both ends."""
    inner = np.linspace(low, high, n + 1)[1:-1]
    return [-INF, *[float(x) for x in inner], INF]


def fit_edges(df: DataFrame, bins: Mapping[str, Sequence[float] | int | None], default: int = 10) -> dict[str, list[float]]:
    """Edges of every numeric column; extremes of all of them in one pass."""
    open_ = [a for a, b in bins.items() if b is None or isinstance(b, int)]
    out = {a: [float(x) for x in b] for a, b in bins.items() if a not in open_}
    row = df.agg(*[f(column(a).cast("double")).alias(f"{i}{f.__name__}") for i, a in enumerate(bins) for f in (F.min, F.max)]).first() if bins else None
    for i, a in enumerate(bins):
        low, high = row[f"{i}min"], row[f"{i}max"]
        if a in open_:
            out[a] = equal_edges(low or 0.0, high or 0.0, bins[a] or default)
        elif low is not None and (low < out[a][0] or high > out[a][-1]):
            raise ValueError(f"{a}: {low}..{high} isn't within {out[a][0]}..{out[a][-1]}")
    return out


def bin_code(value: Column, edges: Sequence[float], repeat: str = "point") -> Column:
    """The bin [lo, hi) that a value is in; null outside all bins.  An edge
    written twice makes a bin of that value alone (repeat='point'); 'overwrite'
    gives such values to the following bin instead."""
    code = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(zip(edges, edges[1:])))):
        if lo == hi:
            if repeat == "point":
                code = F.when(value == F.lit(float(lo)), F.lit(i)).otherwise(code)
            continue
        inside = (value >= F.lit(float(lo))) & (value < F.lit(float(hi)))
        code = F.when(inside, F.lit(i)).otherwise(code)
    if repeat == "point":  # a point bin goes before the interval that starts there
        for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
            if lo == hi:
                code = F.when(value == F.lit(float(lo)), F.lit(i)).otherwise(code)
    return code


def bin_labels(edges: Sequence[float]) -> list[str]:
    """How each bin is written: a, (a, b) after a repeated edge, else [a, b)."""
    text = lambda x: "inf" if x == INF else "-inf" if x == -INF else str(int(x)) if float(x).is_integer() else repr(float(x))
    out, pairs = [], list(zip(edges, edges[1:]))
    for i, (lo, hi) in enumerate(pairs):
        if lo == hi:
            out.append(text(lo))
        else:
            out.append(f"{'(' if i and pairs[i - 1] == (lo, lo) else '['}{text(lo)}, {text(hi)})")
    return out


# Whole tables --------------------------------------------------------------


class Encoder:
    """Labels and bins of a table, fitted over one or several frames.  All labels
    take one dictionary; columns of up to most values are then lists (values),
    coded in one pass, and the others tables (value, code), met by a shuffle each."""

    def __init__(self, config: Config, other: bool = False, default_bins: int = 10, repeat: str = "point", most: int = HELD) -> None:
        self.config, self.other, self.default_bins, self.repeat, self.most = config, other, default_bins, repeat, most
        self.values: dict[str, list] = {}
        self.tables: dict[str, DataFrame] = {}
        self.sizes: dict[str, int] = {}
        self.edges: dict[str, list[float]] = {}

    @property
    def attrs(self) -> list[str]:
        return [*self.config.categorical, *self.config.bins]

    def _one(self, frames: DataFrame | Sequence[DataFrame]) -> DataFrame:
        frames = [frames] if isinstance(frames, DataFrame) else list(frames)
        own = [f.select(*[column(a) for a in self.attrs]) for f in frames]
        out = own[0]
        for f in own[1:]:
            out = out.unionByName(f)
        return out

    def fit(self, frames: DataFrame | Sequence[DataFrame]) -> Encoder:
        df, config = self._one(frames), self.config
        self.kinds = {a: k for a, k in df.dtypes if a in config.categorical}
        self.values = {a: dictionary(df, a, config.declared[a], self.other) for a in config.categorical if config.declared.get(a)}
        self.tables, self.sizes, free = {}, {a: len(v) for a, v in self.values.items()}, [a for a in config.categorical if a not in self.values]
        if free:
            fused = stored(fused_dictionary(df, free, {a: [OTHER] for a in free} if self.other else None))
            self.sizes |= {a: 0 for a in free} | {free[r["i"]]: r["n"] for r in fused.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each attribute
            small = [i for i, a in enumerate(free) if self.sizes[a] <= self.most]
            found = {a: [] for a in free}
            for r in fused.where(F.col("i").isin(small)).collect() if small else ():  # at most self.most for each attribute
                found[free[r["i"]]].append((r["code"], r[_kind(self.kinds[free[r["i"]]])]))
            for i, a in enumerate(free):
                if i in small:
                    self.values[a] = [_back(v, self.kinds[a]) for _, v in sorted(found[a])]
                else:
                    self.tables[a] = fused.where(F.col("i") == i).select(F.col(_kind(self.kinds[a])).cast(self.kinds[a]).alias("value"), "code")
        self.edges = fit_edges(df, config.bins, self.default_bins)
        return self

    def transform(self, frames: DataFrame | Sequence[DataFrame]) -> DataFrame:
        df = self._one(frames)
        bins = [bin_code(column(a).cast("double"), self.edges[a], self.repeat).alias(a) for a in self.config.bins]
        df = df.select(*[column(a) for a in self.config.categorical], *bins)
        if self.values:
            df = code_from_memory(df, self.values, self.other)
        for a, table in self.tables.items():
            met = df.join(table.select(F.col("value").alias("__v"), F.col("code").alias("__c")), column(a) == F.col("__v"), "left")
            lost = table.where(F.col("value") == OTHER).select(F.max("code").alias("__o")) if self.other else None
            if lost is not None:
                met = met.join(F.broadcast(lost)).withColumn("__c", F.coalesce("__c", "__o")).drop("__o")
            unknown = F.raise_error(F.concat(F.lit(f"{a}: unknown value "), column(a).cast("string"))).cast("long")
            df = met.withColumn(a, F.when(column(a).isNull(), F.lit(-1).cast("long")).otherwise(F.coalesce("__c", unknown))).drop("__v", "__c")
        return df.select(*[column(a) for a in self.attrs])

    def fit_transform(self, frames: DataFrame | Sequence[DataFrame]) -> DataFrame:
        return self.fit(frames).transform(frames)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        names = df.columns
        for a in self.values:
            df = decode(df, a, self.values[a])
        for a, table in self.tables.items():
            back = table.select(F.col("value").alias("__v"), F.col("code").alias("__c"))
            df = df.join(back, column(a) == F.col("__c"), "left").withColumn(a, F.col("__v")).drop("__v", "__c").select(*[column(c) for c in names])
        for a in self.config.bins:
            df = decode(df, a, bin_labels(self.edges[a]))
        return df

    @property
    def domain(self) -> Domain:
        return Domain.fromdict({a: self.sizes[a] for a in self.config.categorical} | {a: len(e) - 1 for a, e in self.edges.items()})


def constant_free(domain: Domain) -> Domain:
    """The domain without attributes of one value."""
    return Domain.fromdict({a: n for a, n in domain.config.items() if n > 1})


def out_of_domain(df: DataFrame, domain: Domain) -> DataFrame:
    """(attr, size, largest, n_bad): one pass that checks all codes."""
    parts = [F.struct(F.lit(a).alias("attr"), F.lit(n).alias("size"), F.max(column(a)).cast("int").alias("largest"), F.count(F.when((column(a) >= n) | (column(a) < -1), 1)).alias("n_bad")) for a, n in domain.config.items()]
    return df.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def split_con_cat(columns: Sequence[str], continuous: Sequence[str]) -> tuple[list[str], list[str]]:
    """(categorical, continuous) of the given columns."""
    known = set(continuous)
    return [c for c in columns if c not in known], [c for c in columns if c in known]


def union_domain(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], most: int = LISTED) -> DataFrame:
    """One row: the sorted distinct values of categorical columns and the range
    of numeric ones, over all parts of a table.  A categorical column of more than
    most values is an error: it is none."""
    parts = [F.struct(F.lit(i).alias("i"), column(a).cast("string").alias("v")) for i, a in enumerate(categorical)]
    if parts:
        many = df.select(F.explode(F.array(*parts)).alias("x")).distinct().groupBy("x.i").count().where(F.col("count") > most).first()
        if many is not None:
            raise ValueError(f"{categorical[many['i']]} has {many['count']} values")
    own = [F.array_sort(F.collect_set(column(a))).alias(a) for a in categorical]
    own += [f(column(a)).alias(f"{f.__name__}_{a}") for a in numeric for f in (F.min, F.max)]
    return df.agg(*own)


def domains_within(df: DataFrame, part: str, attr: str) -> DataFrame:
    """(part, size, low, high) of an attribute within each part of a table."""
    own = column(attr)
    return df.groupBy(column(part)).agg(F.count_distinct(own).alias("size"), F.min(own).alias("low"), F.max(own).alias("high"))


def domain_rows(spark, domain: Domain) -> DataFrame:
    """A frame that holds every code of every attribute at least once: row i has
    code i, or an attribute's last code where it has fewer."""
    n = max(domain.shape, default=0)
    return spark.range(n).select(*[F.least(F.col("id"), F.lit(size - 1)).cast("int").alias(a) for a, size in domain.config.items()])


@dataclass(frozen=True)
class Prepared:
    """df: codes, and raw numeric columns of a mixed table.  domain: of all its
    columns, 1 for raw ones."""

    df: DataFrame
    domain: Domain
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]

    def only(self, which: str) -> Prepared:
        """The 'cat' or 'num' columns of the same table."""
        own = [a for a in self.domain.attrs if a in (self.categorical if which == "cat" else self.numeric)]
        return Prepared(self.df.select(*[column(a) for a in own]), self.domain.project(own), self.categorical, self.numeric)


def part_config(every: DataFrame, part: DataFrame, categorical: Sequence[str], numeric: Sequence[str], bins: int = 10, own: Sequence[str] = ()) -> Config:
    """How one part (a state) of a table is encoded: values and ranges are those of
    the whole table, so that parts compare; columns in own (a part's districts)
    take theirs from the part alone."""
    row, mine = union_domain(every, categorical, numeric).first(), [a for a in (*categorical, *numeric) if a in own]
    of_part = union_domain(part, [a for a in mine if a in categorical], [a for a in mine if a in numeric]).first() if mine else None
    declared = {a: list((of_part if a in own else row)[a]) for a in categorical}
    edges = {a: equal_edges(*[float((of_part if a in own else row)[f"{f}_{a}"]) for f in ("min", "max")], bins) for a in numeric}
    return Config(categorical=list(categorical), bins=edges, declared=declared)


def prepare_part(every: DataFrame, part: DataFrame, categorical: Sequence[str], numeric: Sequence[str], bins: int = 10, own: Sequence[str] = (), mixed: bool = False) -> Prepared:
    """A part encoded by part_config, checked, without columns of one value; mixed
    keeps numeric columns as they are, with a domain of 1."""
    encoder = Encoder(part_config(every, part, categorical, numeric, bins, own)).fit(part)
    domain = constant_free(encoder.domain)
    if mixed:
        kept = [a for a in domain.attrs if a in categorical]
        coded = part
        for a in kept:
            coded = encode(coded, a, encoder.values[a])
        df = coded.select(*[column(a) for a in kept], *[column(a) for a in numeric])
        return Prepared(df, Domain.fromdict({a: domain[a] for a in kept} | {a: 1 for a in numeric}), tuple(categorical), tuple(numeric))
    df = encoder.transform(part).select(*[column(a) for a in domain.attrs])
    bad = out_of_domain(df, domain).where("n_bad > 0").select("attr").collect()  # at most one row for each column
    if bad:
        raise ValueError(f"codes outside their domain: {[r['attr'] for r in bad]}")
    return Prepared(df, domain, tuple(categorical), tuple(numeric))


def train_test_split(df: DataFrame, id_col: str, fraction: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Exactly round(fraction * n) rows for training, the rest for testing.  Rows
    are ranked by a hash of their id (null: an empty one) and the seed, rows of one
    id by a hash of all columns.  The rank at the cut is found by counting prefixes
    of the hashes; after the first count only the hashes of one in 4096 rows are
    kept for the next.  Of equal rows at the cut as many as are needed are taken."""
    of_row = F.md5(F.concat_ws(":", *[F.coalesce(column(c).cast("string"), F.lit("")) for c in df.columns]))
    key = F.concat(F.md5(F.concat(F.coalesce(column(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))), of_row)
    keyed = df.withColumn("__key", key)
    keys, prefix, taken, n, cut = keyed.select("__key"), "", 0, None, "g"
    while len(prefix) < 64:
        width = min(len(prefix) + 3, 64)
        sizes = sorted((r[0], r[1]) for r in keys.groupBy(F.substring("__key", 1, width)).count().collect())  # at most 4096 rows
        if n is None:
            n = round(fraction * sum(c for _, c in sizes))
        for p, c in sizes:
            if taken + c > n:
                break
            taken += c
        else:
            prefix = ""
            break
        cut = prefix = p
        if taken == n:
            break
        keys = stored(keys.where(F.col("__key").startswith(p)))
    inside = F.col("__key") < F.lit(cut)
    train, test = keyed.where(inside).drop("__key"), keyed.where(~inside).drop("__key")
    if len(prefix) < 64 or taken == n:
        return train, test
    # the cut goes through equal rows: they are numbered within their partitions
    ties = stored(keyed.where(F.col("__key") == cut).drop("__key").withColumn("__at", F.monotonically_increasing_id()))
    part, more, few = F.shiftright("__at", 33), n - taken, F.lit(False)
    for r in sorted(ties.groupBy(part.alias("part")).count().collect()):  # one row for each partition
        few = few | ((part == r["part"]) & (F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) < min(more, r["count"])))
        more -= min(more, r["count"])
        if not more:
            break
    over = keyed.where(F.col("__key") > F.lit(cut)).drop("__key")
    return train.unionByName(ties.where(few).drop("__at")), over.unionByName(ties.where(~few).drop("__at"))


# One-hot -------------------------------------------------------------------


def onehot_positions(domain: Domain) -> Column:
    """The places of a row's ones among all attributes' blocks; a code outside
    its domain (a missing one is -1) has none."""
    parts = [F.when(column(a).between(0, domain[a] - 1), column(a).cast("int") + at) for a, at in domain.offsets().items()]
    return F.array_compact(F.array(*parts))


def onehot_decode(positions: Column, domain: Domain) -> list[Column]:
    """Codes from positions, -1 where an attribute has none."""
    out = []
    for a, at in domain.offsets().items():
        own = F.filter(positions, _within(at, domain[a]))
        out.append(F.coalesce(F.get(own, 0) - at, F.lit(-1)).alias(a))
    return out


def _within(low: int, n: int):
    return lambda p: (p >= low) & (p < low + n)


def recode_sex(value: Column) -> Column:
    return F.when(value == 1, "Male").otherwise("Female")


def recode_origin(value: Column) -> Column:
    return F.when(value == 1, "Not HLO").otherwise("HLO")
