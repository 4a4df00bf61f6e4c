"""Budget of zero-concentrated differential privacy, and its mechanisms."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise import gumbel, normal

#: Relative width of the bracket at which a root counts as found.
CLOSE = 1e-14


def _crossing(f: Callable[[float], float], low: float, high: float) -> float:
    """Where an increasing function crosses 0, by halving the bracket between a
    point below it and one above; high is doubled until it lies above."""
    while f(high) < 0:
        low, high = high, 2 * high
    while high - low > CLOSE * max(abs(low), abs(high)):
        mid = low + (high - low) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def cdp_delta(rho: float, eps: float) -> float:
    """The delta for which rho-zCDP gives (eps, delta)-DP.  For every order a > 1,
    delta <= exp((a - 1)(a rho - eps)) (1 - 1/a)^a / (a - 1); the least bound is
    where the logarithm's derivative, (2a - 1) rho - eps + ln(1 - 1/a), is 0.  It
    rises with a, from minus infinity."""
    if rho == 0:
        return 0.0
    slope = lambda x: (2 * x + 1) * rho - eps + math.log(x / (1 + x))  # noqa: E731  # x = a - 1
    x = _crossing(slope, 0.0, 1.0 + eps / rho)
    a = 1 + x
    return min(1.0, math.exp(x * (a * rho - eps) + a * math.log(x / a)) / x)


def cdp_eps(rho: float, delta: float) -> float:
    """The least eps for which rho-zCDP gives (eps, delta)-DP."""
    if delta >= 1 or rho == 0:
        return 0.0
    return _crossing(lambda e: delta - cdp_delta(rho, e), 0.0, rho + 1)


def cdp_rho(eps: float, delta: float) -> float:
    """The largest rho for which rho-zCDP gives (eps, delta)-DP."""
    if delta >= 1:
        return 0.0
    return _crossing(lambda r: cdp_delta(r, eps) - delta, 0.0, eps + 1) if delta > 0 else 0.0


def default_delta(n: int) -> float:
    return 1.0 / n**2


def per_round(eps: float, delta: float, rounds: int, alpha: float | None = None) -> tuple[float, float]:
    """(eps0, rho): with alpha a round spends alpha eps0 on selecting and
    (1 - alpha) eps0 on measuring; without, eps0 on one of them."""
    rho = cdp_rho(eps, delta)
    share = 1.0 if alpha is None else alpha**2 + (1 - alpha) ** 2
    return math.sqrt(2 * rho / (rounds * share)), rho


def resolve_rounds(rounds: float, n_workloads: int) -> int:
    """A fraction is of the workloads; 1.0 is all of them."""
    n = int(rounds * n_workloads) if isinstance(rounds, float) else rounds
    if not 0 < n <= n_workloads:
        raise ValueError(f"{n} rounds for {n_workloads} workloads")
    return n


def workload_sensitivity(n: int) -> float:
    """L2 sensitivity of a whole marginal when one row is replaced."""
    return math.sqrt(2) / n


def gumbel_score(score: Column, eps: float, sensitivity: float, seed: int | str, key: Column) -> Column:
    """What the exponential mechanism takes the largest of."""
    return score * F.lit(eps / sensitivity) + gumbel(seed, key)


def exponential(scores: DataFrame, eps: float, sensitivity: float, seed: int | str, key: str = "query_id", score: str = "score") -> DataFrame:
    """One row (key, score): chosen with probability in proportion to
    exp(eps score / sensitivity), by adding Gumbel noise and taking the largest
    (ties: the smallest key).  eps 0 chooses evenly.  Scores of -infinity and
    nulls are never chosen."""
    open_ = scores.where(F.col(score).isNotNull() & (F.col(score) > F.lit(-math.inf)))
    noisy = gumbel_score(F.col(score), eps, sensitivity, seed, F.col(key))
    best = F.max(F.struct(F.round(noisy, 9).alias("x"), (-F.col(key)).alias("k"), F.col(key).alias("key"), F.col(score).alias("score")))
    return open_.agg(best.alias("b")).where("b IS NOT NULL").select(F.col("b.key").alias(key), F.col("b.score").alias(score))


def gaussian(values: DataFrame, eps: float, sensitivity: float, seed: int | str, key: str = "query_id", value: str = "ans") -> DataFrame:
    """values with noise of deviation sensitivity / eps."""
    return values.withColumn(value, F.col(value) + normal(seed, F.col(key)) * F.lit(sensitivity / eps))


def clipped(values: DataFrame, value: str = "ans") -> DataFrame:
    return values.withColumn(value, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))))


def workload_scores(scores: DataFrame) -> DataFrame:
    """(wid, score): a workload's largest query score; scores is (query_id, wid, score)."""
    return scores.groupBy("wid").agg(F.max("score").alias("score"))


def inverse_cdf(weights: DataFrame, u: float, key: str, weight: str = "w") -> DataFrame:
    """(key): the first key at which the running share of weights reaches u; null
    for an empty table.  Keys are numbers; sums run within ranges of them."""
    from .support import running

    rows, edges = running(weights, key, weight)
    return rows.where(F.col("hi") / F.lit(edges[-1]) >= F.lit(u)).agg(F.min(key).alias(key))
