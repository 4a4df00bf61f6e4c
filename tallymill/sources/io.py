"""Tables, domains, query sets, results, answers and models on storage."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..domain import Domain, EncodedData, column
from ..plans.workload import QuerySpace

#: Columns of a result store: a hash of a run's flags, and which writing of it is the newest.
RUN, ATTEMPT = "run_key", "run_attempt"

# The attributes of each known dataset, in its engine's order.
DEFAULT_COLUMNS = {
    "adult_orig": ["age", "workclass", "fnlwgt", "education-num", "marital-status", "occupation", "relationship", "race", "sex", "capital-gain", "capital-loss", "hours-per-week", "native-country", "income>50K"],
    "adult": ["sex", "income>50K", "race", "relationship", "marital-status", "workclass", "occupation", "education", "native-country", "capital-gain", "capital-loss", "hours-per-week", "age"],
    "adult-reduced": ["sex", "income>50K", "race", "marital-status", "occupation", "education", "age"],
    "loans": [
        "loan_amnt", "funded_amnt", "funded_amnt_inv", "int_rate", "installment", "annual_inc", "dti", "delinq_2yrs", "inq_last_6mths", "mths_since_last_delinq",
        "mths_since_last_record", "open_acc", "pub_rec", "revol_bal", "revol_util", "total_acc", "total_pymnt", "total_pymnt_inv", "total_rec_prncp",
        "total_rec_int", "total_rec_late_fee", "recoveries", "collection_recovery_fee", "last_pymnt_amnt", "delinq_amnt", "pub_rec_bankruptcies",
        "settlement_amount", "settlement_percentage", "settlement_term", "term", "grade", "sub_grade", "emp_length", "home_ownership",
        "verification_status", "issue_d", "loan_status", "purpose", "zip_code", "addr_state", "earliest_cr_line", "last_pymnt_d", "next_pymnt_d",
        "last_credit_pull_d", "debt_settlement_flag", "debt_settlement_flag_date", "settlement_status", "settlement_date",
    ],
    "acs": [
        "VETWWII", "AVAILBLE", "MIGRATE1", "MARRNO", "GRADEATT", "RACE", "MARRINYR", "EDUC", "DIFFREM", "VET75X90", "EMPSTAT", "VET47X50", "MORTGAGE",
        "VETVIETN", "DIFFSENS", "HCOVANY", "LABFORCE", "FOODSTMP", "NCHILD", "NSIBS", "VETKOREA", "VET90X01", "RACWHT", "RELATE", "SEX", "NMOTHERS",
        "SCHLTYPE", "DIFFEYE", "VET55X64", "SCHOOL", "WIDINYR", "MARST", "VET01LTR", "VEHICLES", "WORKEDYR", "VETDISAB", "METRO", "DIFFMOB", "ACREHOUS",
        "NFATHERS", "NCHLT5", "SPEAKENG", "CLASSWKR", "CITIZEN", "VACANCY", "RACASIAN", "DIFFCARE", "AGE", "LOOKING", "RACBLK", "RACAMIND", "DIFFPHYS",
        "HINSCARE", "VETSTAT", "MIGTYPE1", "NCOUPLES", "HISPAN", "MULTGEN", "DIFFHEAR", "RACOTHER", "HINSCAID", "HINSVA", "OWNERSHP", "FERTYR",
        "HCOVPRIV", "DIVINYR", "RACPACIS",
    ],
    "acs-reduced": ["SEX", "FOODSTMP", "RACWHT", "RACASIAN", "RACBLK", "RACAMIND", "RACPACIS", "RACOTHER", "DIFFEYE", "DIFFHEAR", "HCOVPRIV", "HINSCAID", "HINSCARE", "OWNERSHP", "EMPSTAT"],
}


def default_columns(name: str) -> list[str] | None:
    """By dataset name: adult..., acs_XX..., each with -reduced."""
    if name in DEFAULT_COLUMNS:
        return DEFAULT_COLUMNS[name]
    stem = next((s for s in ("adult", "acs") if name.startswith(s)), None)
    return DEFAULT_COLUMNS[stem + "-reduced" * name.endswith("-reduced")] if stem else None


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str | None = None) -> DataFrame:
    """CSV with a header, JSON lines, ORC or Parquet, by the (first) path's ending;
    several paths of one kind are one table."""
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if paths[0].endswith((".csv", ".csv.gz")):
        return reader.option("header", True).option("inferSchema", schema is None).csv(paths)
    if paths[0].endswith((".json", ".jsonl")):
        return reader.json(paths)
    return reader.orc(paths) if paths[0].endswith(".orc") else reader.parquet(*paths)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    writer.option("header", True).csv(path) if path.endswith(".csv") else writer.parquet(path)


def load_encoded(spark: SparkSession, path: str, domain: Domain, cols: Sequence[str] | None = None, weight: str | None = None) -> EncodedData:
    """Codes of a table, read with the domain's columns only.  cols picks and
    orders attributes."""
    own = domain.project(cols) if cols else domain
    df = read_table(spark, path)
    picked = [column(a).cast("int").alias(a) for a in own.attrs] + ([column(weight)] if weight else [])
    return EncodedData(df.select(*picked), own, weight)


def get_data(spark: SparkSession, name: str, root: str, domain_name: str | None = None, cols: Sequence[str] | None = None) -> EncodedData:
    """root/name.csv (or .parquet) over root/domain/<domain_name>-domain.json."""
    domain = Domain.from_json(f"{root}/domain/{domain_name or name}-domain.json", spark)
    base = f"{root}/{name}"
    found = storage.exists(spark, f"{base}.parquet")
    return load_encoded(spark, f"{base}.parquet" if found else f"{base}.csv", domain, cols or default_columns(name))


def split_by(df: DataFrame, key: str, path: str) -> None:
    """One folder for each value of key; readers that filter on it read no other."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


# Query sets ----------------------------------------------------------------


def save_queries(queries: Sequence[Mapping[str, Sequence]], path: str, spark: SparkSession | None = None) -> None:
    """A query set as JSON, in any store that Spark writes if a session is given."""
    text = json.dumps([{a: list(v) for a, v in q.items()} for q in queries])
    if spark is not None:
        return storage.write_text(spark, path, text)
    with open(path, "w") as f:
        f.write(text)


def load_queries(path: str, spark: SparkSession | None = None) -> list[dict[str, list]]:
    if spark is not None:
        return json.loads(storage.read_text(spark, path))
    with open(path) as f:
        return json.load(f)


# Results -------------------------------------------------------------------


def append_results(df: DataFrame, path: str, flags: Sequence[str] | None = None) -> None:
    """Stores runs, one or several rows for each set of flags (all columns but the
    errors, unless named).  A run has a folder of its own by a hash of its flags,
    so one that is stored again takes the place of the first; of two writers at
    once the later counts."""
    own = sorted(flags if flags is not None else [c for c in df.columns if not c.startswith("error")])
    run = F.sha2(F.to_json(F.struct(*[column(c) for c in own])), 256)  # nulls are left out
    keyed = df.withColumn(RUN, run).withColumn(ATTEMPT, F.lit(f"{time.time_ns():020d}-{uuid.uuid4().hex}"))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(RUN).parquet(path)


def stored_results(spark: SparkSession, path: str) -> DataFrame | None:
    """All runs in a result store, over whatever columns any of them has."""
    if not storage.exists(spark, path):
        return None
    every = spark.read.option("mergeSchema", True).parquet(path)
    newest = every.groupBy(F.col(RUN).alias("__r")).agg(F.max(ATTEMPT).alias("__a"))
    return every.join(newest, (F.col(RUN) == F.col("__r")) & (F.col(ATTEMPT) == F.col("__a")), "left_semi").drop(RUN, ATTEMPT)


def matching_results(results: DataFrame, flags: Mapping[str, object]) -> DataFrame:
    """Rows with all these flags; nulls match nulls, and a column that the store
    lacks holds nulls."""
    for k, v in flags.items():
        results = results.where((F.col(k) if k in results.columns else F.lit(None)).eqNullSafe(F.lit(v)))
    return results


def already_run(results: DataFrame, flags: Mapping[str, object]) -> bool:
    n = matching_results(results, flags).limit(2).count()
    if n > 1:
        raise ValueError("more than one run has these flags")
    return n == 1


# Answers -------------------------------------------------------------------


def cached_answers(spark: SparkSession, path: str | Sequence[str], space: QuerySpace, folder: str, encode: Callable[[DataFrame], EncodedData] | None = None) -> DataFrame:
    """Answers of a table's files: those counted before are looked up, the others
    read.  Without encode the files hold codes."""
    from .answers import AnswerStore  # which reads tables by this module

    return AnswerStore(spark, folder, space, encode or (lambda rows: EncodedData(rows, space.domain))).answers(path)
