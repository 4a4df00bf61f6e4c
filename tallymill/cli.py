"""python -m tallymill.cli <algorithm> --root ... --dataset ...: fits a release
and appends its errors to a result store.  A run whose flags are stored already
isn't repeated."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .operators import evaluate, fit, models, privacy, setquery
from .operators import marginals as m
from .operators import support as sup
from .plans.workload import QuerySpace, all_workloads, random_workloads
from .sources import io

#: mw and ep fit a histogram and nondp a product model without noise; --public starts
#: mwem, pep, mw, ep from a public table's rows and gem from a model fitted to it.
HISTOGRAMS, PRODUCTS = ("mwem", "pep", "mw", "ep"), ("gem", "rap", "iter", "nondp")
NOISELESS = ("mw", "ep", "nondp")
#: Answers that fit in the driver's memory, for models that live there.
MOST_ANSWERS = 50_000_000
ERRORS = ("error_max", "error_mean", "error_mean_squared")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallymill")
    p.add_argument("algorithm", choices=[*HISTOGRAMS, *PRODUCTS])
    p.add_argument("--root", required=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--public", help="a public table of the same domain, to start from")
    p.add_argument("--set_queries", help="a query set to fit to (nondp only)")
    p.add_argument("--results")
    for name, kind, default in (
        ("marginal", int, 3), ("workload", int, 32), ("workload_seed", int, 0), ("epsilon", float, 1.0), ("T", float, 10), ("alpha", float, 0.5),
        ("max_iters", int, 100), ("max_idxs", int, 10_000), ("lr", float, 1e-4), ("eta_min", float, None), ("K", int, 1000), ("dim", int, 512),
        ("samples_per_round", int, 1), ("seed", int, 0),
    ):
        p.add_argument(f"--{name}", type=kind, default=default)
    for name in ("recycle", "average", "ema_weights", "network"):
        p.add_argument(f"--{name}", action="store_true")
    return p


#: The type of each flag's column, whatever one run's value is.
KINDS = {
    a.dest: "boolean" if a.nargs == 0 else {int: "bigint", float: "double"}.get(a.type, "string") for a in parser()._actions if a.dest not in ("help", "root", "results")
}


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, float]:
    """The errors of one run, from the result store if its flags are stored there."""
    flags = {k: v for k, v in vars(args).items() if k in KINDS}
    before = io.stored_results(spark, args.results) if args.results else None
    if before is not None and io.already_run(before, flags):
        return io.matching_results(before, flags).select(*ERRORS).first().asDict()
    errors = _errors(spark, args)
    if args.results:
        schema = ", ".join(f"{k} {KINDS[k]}" for k in flags) + "".join(f", {e} double" for e in ERRORS)
        io.append_results(spark.createDataFrame([(*flags.values(), *(errors[e] for e in ERRORS))], schema), args.results, list(flags))
    return errors


def _errors(spark: SparkSession, args: argparse.Namespace) -> dict[str, float]:
    data = io.get_data(spark, args.dataset, args.root)
    public = io.get_data(spark, args.public, args.root) if args.public else None
    if args.set_queries:
        return _set_errors(spark, args, data)
    every = all_workloads(data.domain, args.marginal)
    chosen = every if args.workload >= len(every) else random_workloads(data.domain, args.workload, args.marginal, args.workload_seed)
    space, n = QuerySpace(data.domain, chosen), data.records
    rounds = int(args.T) if args.T > 1 and args.T == int(args.T) else privacy.resolve_rounds(args.T, len(chosen))
    eps0 = None if args.algorithm in NOISELESS else privacy.per_round(args.epsilon, privacy.default_delta(n), rounds, args.alpha)[0]
    true = fit.stored(m.answers(data, space))
    if args.algorithm in HISTOGRAMS:
        start = sup.public_support(public) if public is not None else sup.uniform(sup.full_support(spark, data.domain), data.domain.size())
        hist = fit.Histogram(start, space)
        chooser = fit.Chooser(n=n, eps0=eps0, alpha=args.alpha, seed=args.seed, single=args.algorithm != "pep")
        if args.algorithm in ("mwem", "mw"):
            fit.multiplicative_weights(hist, true, rounds, chooser, args.recycle)
        else:
            fit.entropy_projection(hist, true, rounds, chooser, args.max_iters)
        found = hist.answers(args.average)
    else:
        model = models.ResidualModel(data.domain, args.K, args.dim, seed=args.seed) if args.network else models.FixedModel(data.domain, args.K, args.seed)
        if public is not None:
            models.fit_exact(model, space, _vector(m.answers(public, space), space.n_queries), args.max_iters, args.lr, seed=args.seed)
        vector = _vector(true, space.n_queries)
        if args.algorithm == "nondp":
            models.fit_exact(model, space, vector, rounds, args.lr, batch=args.max_idxs, seed=args.seed)
        else:
            config = models.FitConfig(
                style=args.algorithm, rounds=rounds, alpha=args.alpha, lr=args.lr, eta_min=args.eta_min, max_iters=args.max_iters, max_idxs=args.max_idxs,
                samples_per_round=args.samples_per_round, ema_weights=args.ema_weights, seed=args.seed,
            )
            models.fit_private(model, space, vector, n, eps0, config)
        return _compared(vector, m.soft_answers(model.probabilities(), space))
    return evaluate.errors(true, found).first().asDict()


def _set_errors(spark: SparkSession, args: argparse.Namespace, data) -> dict[str, float]:
    if args.algorithm != "nondp":
        raise ValueError("set queries are fitted by nondp")
    asked = setquery.distinct(io.load_queries(args.set_queries, spark))
    space = setquery.SetSpace(data.domain, asked)
    vector = _vector(setquery.set_answers(data, asked).withColumnRenamed("qid", "query_id"), len(asked))
    model = models.FixedModel(data.domain, args.K, args.seed)
    models.fit_exact(model, space, vector, int(args.T), args.lr, batch=args.max_idxs, seed=args.seed)
    return _compared(vector, setquery.soft_set_answers(model.probabilities(), space))


def _vector(answers: DataFrame, n: int) -> np.ndarray:
    """Answers by query, for a model on the driver; an error if there are too many."""
    if n > MOST_ANSWERS:
        raise ValueError(f"{n} answers are more than a driver should hold: choose fewer workloads")
    table, out = answers.select("query_id", "ans").toArrow(), np.zeros(n)
    out[table["query_id"].to_numpy()] = table["ans"].to_numpy()
    return out


def _compared(true: np.ndarray, found: np.ndarray) -> dict[str, float]:
    gap = np.abs(true - found)
    return dict(zip(ERRORS, (float(gap.max()), float(gap.mean()), float((gap**2).mean()))))


def main() -> None:
    print(run(SparkSession.builder.getOrCreate(), parser().parse_args()))


if __name__ == "__main__":
    main()
