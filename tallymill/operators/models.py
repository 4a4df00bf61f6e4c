"""Product models: a batch of rows whose attributes are independent
distributions, from a table of logits or from a residual network, fitted to
answers by gradient steps.  A model's size doesn't depend on the data, so it
lives on the driver; Spark computes the true answers and draws the rows."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..domain import Domain
from ..functions import noise
from ..plans.workload import QuerySpace
from . import privacy
from .marginals import soft_answers
from .setquery import SetSpace, soft_set_answers, soft_set_gradient


def softmax_blocks(logits: np.ndarray, domain: Domain) -> np.ndarray:
    out = np.empty_like(logits)
    for a, at in domain.offsets().items():
        x = logits[:, at : at + domain[a]]
        e = np.exp(x - x.max(axis=1, keepdims=True))
        out[:, at : at + domain[a]] = e / e.sum(axis=1, keepdims=True)
    return out


def softmax_gradient(p: np.ndarray, up: np.ndarray, domain: Domain) -> np.ndarray:
    out = np.empty_like(p)
    for a, at in domain.offsets().items():
        s = slice(at, at + domain[a])
        out[:, s] = p[:, s] * (up[:, s] - (up[:, s] * p[:, s]).sum(axis=1, keepdims=True))
    return out


def answers_gradient(p: np.ndarray, space: QuerySpace, up: np.ndarray) -> np.ndarray:
    """The loss's gradient by p, from its gradient by the answers: for each
    attribute of a workload the other attributes' probabilities multiply."""
    at, out = space.domain.offsets(), np.zeros_like(p)
    for w in space.workloads:
        own = up[w.offset : w.offset + w.n_cells]
        if not own.any():  # only workloads of queries that count
            continue
        cube, letters = own.reshape(w.sizes), "abcdefgh"[: len(w.attrs)]
        parts = [p[:, at[a] : at[a] + n] for a, n in zip(w.attrs, w.sizes)]
        for i, (a, n) in enumerate(zip(w.attrs, w.sizes)):
            others = [j for j in range(len(parts)) if j != i]
            spec = ",".join([letters, *[f"z{letters[j]}" for j in others]]) + f"->z{letters[i]}"
            if others:
                out[:, at[a] : at[a] + n] += np.einsum(spec, cube, *[parts[j] for j in others], optimize=True) / len(p)
            else:
                out[:, at[a] : at[a] + n] += cube[None, :] / len(p)
    return out


def model_answers(p: np.ndarray, space: QuerySpace | SetSpace, wids: list[int] | None = None) -> np.ndarray:
    """Answers of a model's rows to marginal or set queries."""
    return soft_set_answers(p, space) if isinstance(space, SetSpace) else soft_answers(p, space, wids)


def model_gradient(p: np.ndarray, space: QuerySpace | SetSpace, up: np.ndarray) -> np.ndarray:
    return soft_set_gradient(p, space, up) if isinstance(space, SetSpace) else answers_gradient(p, space, up)


@dataclass
class Adam:
    lr: float = 1e-3
    beta: tuple[float, float] = (0.9, 0.999)
    step_: int = 0
    state: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.step_ += 1
        for k, g in grads.items():
            m, v = self.state.get(k, (np.zeros_like(g), np.zeros_like(g)))
            m, v = self.beta[0] * m + (1 - self.beta[0]) * g, self.beta[1] * v + (1 - self.beta[1]) * g * g
            self.state[k] = (m, v)
            fair_m, fair_v = m / (1 - self.beta[0] ** self.step_), v / (1 - self.beta[1] ** self.step_)
            params[k] -= self.lr * fair_m / (np.sqrt(fair_v) + 1e-8)


class FixedModel:
    """rows x places logits, standard normal at first."""

    def __init__(self, domain: Domain, rows: int, seed: int = 0) -> None:
        self.domain = domain
        self.params = {"logits": np.random.default_rng(seed).standard_normal((rows, sum(domain.shape)))}

    def probabilities(self) -> np.ndarray:
        return softmax_blocks(self.params["logits"], self.domain)

    def backward(self, p: np.ndarray, up: np.ndarray) -> dict[str, np.ndarray]:
        return {"logits": softmax_gradient(p, up, self.domain)}

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        """The parameters, in any store that Spark writes if a session is given."""
        held = io.BytesIO()
        np.savez(held, **self.params)
        if spark is not None:
            return storage.write_bytes(spark, path, held.getvalue())
        with open(path, "wb") as f:
            f.write(held.getvalue())

    def load(self, path: str, spark: SparkSession | None = None) -> None:
        if spark is not None:
            held = io.BytesIO(storage.read_bytes(spark, path))
        else:
            with open(path, "rb") as f:
                held = io.BytesIO(f.read())
        with np.load(held) as table:
            self.params = {k: table[k] for k in table.files}


class ResidualModel(FixedModel):
    """Noise through blocks of linear, batch normalisation and ReLU, each beside
    its own input, and a last linear layer to the logits."""

    def __init__(self, domain: Domain, rows: int, width: int = 32, hidden: tuple[int, ...] | None = None, seed: int = 0, resample: bool = False) -> None:
        self.domain, self.rows, self.width, self.resample = domain, rows, width, resample
        self.rng = np.random.default_rng(seed)
        self.noise = self.rng.standard_normal((rows, width))
        self.params, at = {}, width
        self.depth = len(hidden or (2 * width, 2 * width))
        for i, h in enumerate(hidden or (2 * width, 2 * width)):
            bound = 1 / math.sqrt(at)
            self.params |= {f"w{i}": self.rng.uniform(-bound, bound, (at, h)), f"b{i}": self.rng.uniform(-bound, bound, h), f"g{i}": np.ones(h), f"s{i}": np.zeros(h)}
            at += h
        bound = 1 / math.sqrt(at)
        self.params |= {"w": self.rng.uniform(-bound, bound, (at, sum(domain.shape))), "b": np.zeros(sum(domain.shape))}

    def probabilities(self) -> np.ndarray:
        if self.resample:
            self.noise = self.rng.standard_normal((self.rows, self.width))
        x, self.seen = self.noise, []
        for i in range(self.depth):
            z = x @ self.params[f"w{i}"] + self.params[f"b{i}"]
            spread = np.sqrt(z.var(axis=0) + 1e-5)
            n = (z - z.mean(axis=0)) / spread
            h = n * self.params[f"g{i}"] + self.params[f"s{i}"]
            self.seen.append((x, n, spread, h > 0))
            x = np.concatenate([np.maximum(h, 0), x], axis=1)
        self.last = x
        return softmax_blocks(x @ self.params["w"] + self.params["b"], self.domain)

    def backward(self, p: np.ndarray, up: np.ndarray) -> dict[str, np.ndarray]:
        d = softmax_gradient(p, up, self.domain)
        grads = {"w": self.last.T @ d, "b": d.sum(axis=0)}
        dx = d @ self.params["w"].T
        for i in reversed(range(self.depth)):
            x, n, spread, on = self.seen[i]
            h = on.shape[1]
            dh, through = dx[:, :h] * on, dx[:, h:]
            grads[f"g{i}"], grads[f"s{i}"] = (dh * n).sum(axis=0), dh.sum(axis=0)
            dn = dh * self.params[f"g{i}"]
            dz = (dn - dn.mean(axis=0) - n * (dn * n).mean(axis=0)) / spread
            grads[f"w{i}"], grads[f"b{i}"] = x.T @ dz, dz.sum(axis=0)
            dx = through + dz @ self.params[f"w{i}"].T
        return grads


@dataclass
class FitConfig:
    """style: 'gem' fits the past queries whose error is high against a running
    mean, 'rap' random past queries with a persistent optimiser, 'iter' past
    queries drawn in proportion to their errors."""

    style: str = "gem"
    rounds: int = 10
    alpha: float = 0.5
    lr: float = 1e-2
    eta_min: float | None = None
    max_iters: int = 100
    max_idxs: int = 10_000
    samples_per_round: int = 1
    norm: int = 2
    ema_beta: float = 0.5
    ema_factor: float = 0.5
    ema_weights: bool = True
    ema_weights_beta: float = 0.9
    single: bool = False
    seed: int = 0


def _cosine(top: float, low: float, t: int, rounds: int) -> float:
    return low + (top - low) * (1 + math.cos(math.pi * t / max(rounds, 1))) / 2


def _choose(scores: np.ndarray, eps: float, sensitivity: float, rng: np.random.Generator) -> int:
    return int(np.argmax(scores * eps / sensitivity + rng.gumbel(size=len(scores))))


def fit_private(model: FixedModel, space: QuerySpace, true: np.ndarray, n: int, eps0: float, config: FitConfig) -> list[dict[str, float]]:
    """Rounds of selecting, measuring and gradient steps; returns the error of
    each round.  model ends with its fitted (or averaged) parameters."""
    rng = np.random.default_rng(config.seed)
    past: list[int] = []
    measured: list[float] = []
    log, running, held = [], None, []
    adam = Adam(config.lr)
    keep = max(1, round(config.rounds / 2))
    for t in range(config.rounds):
        found = soft_answers(model.probabilities(), space)
        for _ in range(config.samples_per_round):
            gap = np.abs(true - found)
            gap[past] = -np.inf
            if not np.isfinite(gap).any():
                break
            if config.single:
                cells, sensitivity = [_choose(gap, config.alpha * eps0, 1 / n, rng)], 1 / n
            else:
                tops = np.array([gap[w.offset : w.offset + w.n_cells].max() for w in space.workloads])
                w = space.workloads[_choose(tops, config.alpha * eps0, 1 / n, rng)]
                cells, sensitivity = list(range(w.offset, w.offset + w.n_cells)), privacy.workload_sensitivity(n)
            noise = rng.normal(0, sensitivity / ((1 - config.alpha) * eps0), len(cells))
            past += cells
            measured += np.clip(true[cells] + noise, 0, 1).tolist()
        own, want = np.array(past), np.array(measured)
        wids = sorted({space.workload_of(q).wid for q in past})
        top = np.abs(want - found[own]).max()
        running = top if running is None else config.ema_beta * running + (1 - config.ema_beta) * top
        rate = config.lr if config.eta_min is None else _cosine(config.lr, config.eta_min, t, config.rounds)
        if config.style != "rap":
            adam = Adam(rate)
        best, bad = math.inf, 0
        for i in range(config.max_iters):
            if config.style == "gem":
                adam.lr = _cosine(rate, 1e-8, i, config.max_iters)
            p = model.probabilities()
            off = want - soft_answers(p, space, wids)[own]
            if config.style == "gem":
                pick = np.flatnonzero(np.abs(off) >= config.ema_factor * running)
                pick = pick[np.argsort(np.abs(off[pick]), kind="stable")][-config.max_idxs :]
            elif config.style == "rap":
                pick = rng.permutation(len(own))[: config.max_idxs]
            else:
                pick = rng.choice(len(own), min(config.max_idxs, len(own)), p=np.abs(off) / np.abs(off).sum()) if off.any() else np.empty(0, int)
            if not len(pick):
                break
            e = off[pick]
            if config.style == "rap":
                loss, slope = float((e**2).sum()), -2 * e
            else:
                size = np.linalg.norm(e, config.norm)
                loss = float(size / len(e))
                slope = -np.sign(e) * (np.abs(e) / max(size, 1e-12)) ** (config.norm - 1) / len(e)
            up = np.zeros(space.n_queries)
            np.add.at(up, own[pick], slope)
            adam.step(model.params, model.backward(p, answers_gradient(p, space, up)))
            if config.style == "rap":  # fixed values: when such a fit counts as done
                bad = 0 if loss < best * (1 - 1e-7) else bad + 1
                best = min(best, loss)
                if loss < 1e-8 or bad > 10:
                    break
        if config.style == "gem" and config.ema_weights:
            held = [*held, {k: v.copy() for k, v in model.params.items()}][-keep:]
        gap = np.abs(true - soft_answers(model.probabilities(), space))
        log.append({"round": t, "error_max": float(gap.max()), "error_mean": float(gap.mean()), "error_mean_squared": float((gap**2).mean())})
    if held:
        mean = held[0]
        for params in held[1:]:
            mean = {k: config.ema_weights_beta * mean[k] + (1 - config.ema_weights_beta) * v for k, v in params.items()}
        model.params = mean
    return log


def fit_exact(model: FixedModel, space: QuerySpace | SetSpace, true: np.ndarray, steps: int, lr: float = 1e-2, by_error: bool = False, batch: int = 10_000, seed: int = 0) -> list[float]:
    """Gradient fit to all answers, of marginal or set queries, without privacy, in shuffled batches or
    batches drawn by error; keeps the best parameters.  Returns largest errors."""
    rng, adam, log = np.random.default_rng(seed), Adam(lr), []
    best, kept = math.inf, None
    for _ in range(steps):
        p = model.probabilities()
        off = true - model_answers(p, space)
        log.append(float(np.abs(off).max()))
        if log[-1] < best:
            best, kept = log[-1], {k: v.copy() for k, v in model.params.items()}
        order = rng.choice(len(off), min(batch, len(off)), p=np.abs(off) / np.abs(off).sum()) if by_error and off.any() else rng.permutation(len(off))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            up = np.zeros(space.n_queries)
            np.add.at(up, pick, -2 * off[pick] / len(pick))
            adam.step(model.params, model.backward(p, model_gradient(p, space, up)))
    if kept is not None:
        model.params = kept
    return log


def sample_rows(
    spark: SparkSession, p: np.ndarray, domain: Domain, n: int, how: str = "sample", seed: int = 0, sums: dict[str, list[tuple[str, int]]] | None = None
) -> DataFrame:
    """(id, codes): n rows of codes.  Row i comes from distribution i mod K, drawn
    by numbers hashed from the seed, i and the attribute's place, or, for
    how='max', its likeliest codes.  sums: attributes of two codes that are
    1 where another attribute has any of the codes listed (attribute, code).  The
    model is broadcast: its size is fixed."""
    shared = spark.sparkContext.broadcast(p)
    blocks = [(a, at, domain[a]) for a, at in domain.offsets().items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            rows, out = shared.value[ids % len(shared.value)], {}
            for k, (a, at, size) in enumerate(blocks):
                own = rows[:, at : at + size]
                if how == "max":
                    out[a] = own.argmax(axis=1)
                else:
                    out[a] = np.minimum((batch.column(f"u{k}").to_numpy()[:, None] >= np.round(own.cumsum(axis=1), 12)).sum(axis=1), size - 1)
            for a, parts in (sums or {}).items():
                out[a] = np.any([out[b] == v for b, v in parts], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(out[a].astype(np.int32)) for a, _, _ in blocks]], names=["id", *[a for a, _, _ in blocks]])

    schema = "id bigint, " + ", ".join(f"`{a}` int" for a, _, _ in blocks)
    draws = [noise.uniform(seed, F.col("id"), F.lit(k)).alias(f"u{k}") for k in range(len(blocks))] if how != "max" else []
    return spark.range(n).select("id", *draws).mapInArrow(run, schema)


def summed(p: np.ndarray, domain: Domain, sums: dict[str, list[tuple[str, int]]]) -> np.ndarray:
    """p where the places of each attribute of sums (two codes: no, yes) follow
    from others': yes is the sum of the listed places, at most 1."""
    at, out = domain.offsets(), p.copy()
    for a, parts in sums.items():
        yes = np.minimum(sum(p[:, at[b] + v] for b, v in parts), 1.0)
        out[:, at[a]], out[:, at[a] + 1] = 1 - yes, yes
    return out
