"""python -m tallymill.jobs split|prepare|collect ...: a table's training and test
rows, one part of a raw table as codes, the best runs of a result store.  Tables
are root/<name>.parquet (or .csv, when read) over root/domain/<name>-domain.json,
in any store that Spark reads; -mixed tables have -cat and -num ones beside them."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .domain import Domain, column
from .functions import encode
from .operators import evaluate
from .sources import io

RUN = ("dataset", "marginal", "workload", "workload_seed", "epsilon")
ERRORS = ("error_max", "error_mean", "error_mean_squared")
SUFFIXES = ("cat", "num")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallymill.jobs")
    jobs = p.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("split", help="exactly the fraction of the rows for training, the others for testing")
    one.add_argument("--dataset", required=True)
    one.add_argument("--mixed", action="store_true", help="the -mixed table, with its -cat and -num columns apart as well")
    one.add_argument("--root", default="./datasets")
    one.add_argument("--fraction", type=float, default=0.8)
    one.add_argument("--seed", type=int, default=0)
    one = jobs.add_parser("prepare", help="one part of a raw table, coded by the values and ranges of all of it")
    one.add_argument("--source", required=True, help="the raw table's path")
    one.add_argument("--part_column", required=True)
    one.add_argument("--part", required=True)
    one.add_argument("--dataset", required=True, help="the name to write it under")
    for name in ("categorical", "numeric", "own"):
        one.add_argument(f"--{name}", default="", help="columns, joined by commas" + "; coded by the part's own values" * (name == "own"))
    one.add_argument("--bins", type=int, default=10)
    one.add_argument("--mixed", action="store_true", help="numeric columns stay as they are")
    one.add_argument("--root", default="./datasets")
    one = jobs.add_parser("collect", help="the run of least error for each data set, workload and budget")
    one.add_argument("--results", required=True)
    one.add_argument("--out", help="where to write them, as CSV if it ends in .csv")
    one.add_argument("--error_metric", choices=("max", "mean", "mean_squared"), default="max")
    one.add_argument("--dataset")
    one.add_argument("--marginal", type=int)
    one.add_argument("--max_iters", type=int)
    return p


def _write(df: DataFrame, domain: Domain, root: str, name: str) -> None:
    df.select(*[column(a) for a in domain.attrs]).write.mode("overwrite").parquet(f"{root}/{name}.parquet")
    domain.to_json(f"{root}/domain/{name}-domain.json", df.sparkSession)


def split(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The names of the tables written."""
    name = args.dataset + "-mixed" * args.mixed
    domain = Domain.from_json(f"{args.root}/domain/{name}-domain.json", spark)
    base, out = f"{args.root}/{name}", []
    rows = io.read_table(spark, f"{base}.parquet" if storage.exists(spark, f"{base}.parquet") else f"{base}.csv").select(*[column(a) for a in domain.attrs])
    parts = {name: domain}
    for s in SUFFIXES if args.mixed else ():
        own = args.dataset + f"-{s}"
        if storage.exists(spark, f"{args.root}/domain/{own}-domain.json"):
            parts[own] = Domain.from_json(f"{args.root}/domain/{own}-domain.json", spark)
    # rows have no id: they are ranked by all their columns, equal ones by number
    for half, df in zip(("train", "test"), encode.train_test_split(rows, domain.attrs[0], args.fraction, args.seed)):
        for own, of in parts.items():
            _write(df, of, args.root, f"{own}-{half}")
            out.append(f"{own}-{half}")
    return out


def prepare(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    listed = lambda text: [x for x in text.split(",") if x]
    every = io.read_table(spark, args.source)
    part = every.where(column(args.part_column).cast("string") == args.part)
    done = encode.prepare_part(every, part, listed(args.categorical), listed(args.numeric), args.bins, listed(args.own), args.mixed)
    tables = {args.dataset + "-mixed" * args.mixed: done} | ({f"{args.dataset}-{s}": done.only(s) for s in SUFFIXES} if args.mixed else {})
    for name, own in tables.items():
        _write(own.df, own.domain, args.root, name)
    return list(tables)


def collect(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    results = io.stored_results(spark, args.results)
    if results is None:
        raise ValueError(f"no results in {args.results}")
    asked = {k: v for k in ("dataset", "marginal", "max_iters") if (v := getattr(args, k)) is not None}
    best = evaluate.best_runs(io.matching_results(results, asked), [c for c in RUN if c in results.columns], f"error_{args.error_metric}", rounds=False)
    best = best.withColumn("rounds", (F.col("T") * F.col("workload")).cast("int"))
    best = best.select(*[c for c in ("dataset", "marginal", "workload", "epsilon", "T", "rounds", "max_iters", *ERRORS) if c in best.columns])
    if args.out:
        io.write_table(best.coalesce(1), args.out, mode="overwrite")  # one row for each configuration
    return best


def main() -> None:
    args, spark = parser().parse_args(), SparkSession.builder.getOrCreate()
    if args.job == "collect":
        collect(spark, args).show(1000, truncate=False)
    else:
        print(*{"split": split, "prepare": prepare}[args.job](spark, args), sep="\n")


if __name__ == "__main__":
    main()
