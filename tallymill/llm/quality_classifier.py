"""Quality classifier: a regularised quadratic discriminant over transformed
document statistics.

Each class has a Gaussian whose covariance is shrunk toward the pooled one and
toward a multiple of the identity.  A score is the logistic of the two log
densities' difference, from Mahalanobis distances by Cholesky factors that are
computed once.  Class sums come from one aggregation over all training rows;
only they reach the driver (two rows, whatever the input).  classify() fits to
all labelled rows; keep_good() to at most FIT_ROWS of them, the first by a hash
of their ids, so that only labelled texts are read twice.

Some statistics ask for junk that is known from web text: words said twice in a
row (stutter), table bars (pipes), other symbols, repeated lines.

Edge cases: null text counts as empty and is scored; labels of null quality or
of unknown documents are not used; a document labelled twice counts twice;
without rows of both classes every score is the smoothed share of label 1;
repeated rows and ids each give their own row; empty tables give empty results.
Statistics look at whole texts and at nothing but texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import per_batch, texts_of
from .common import crc_mod, cut, read

FEATURES = ("log_words", "distinct", "stutter", "pipes", "symbols", "word_length", "stops", "repeated_lines", "digits")
SHRINK, RIDGE, THRESHOLD = 0.2, 0.02, 0.3
#: Labelled rows that a stage fits to, at most (20 bytes each when broadcast).
FIT_ROWS = 1_000_000


def statistics(text: str) -> tuple[float, ...]:
    """The transformed statistics of one text.  Shares are smoothed by PRIOR
    words of an ordinary text, so that short texts lie near the middle."""
    ws = text.split()
    n, lines = len(ws), [x for x in text.split("\n") if x]
    share = lambda k, of, usual=0.0, prior=20: float(np.sqrt((k + usual * prior) / (of + prior)))
    return (
        float(np.log1p(n)),
        share(len(set(ws)), n, 0.8),
        share(sum(map(eq, ws, ws[1:])), n),
        share(text.count("|"), n),
        share(sum(map(text.count, "#*$%&<>")), n),
        float(np.log((sum(map(len, ws)) + 100) / (n + 20))),
        share(text.count(".") + text.count(","), n, 0.15),
        share(len(lines) - len(set(lines)), len(lines), 0.0, 5),
        share(sum(map(text.count, "0123456789")), n),
    )


def _features(batch: pa.RecordBatch) -> dict:
    found = np.array([statistics(t) for t in texts_of(batch)], dtype=np.float64).reshape(-1, len(FEATURES))
    return {"doc_id": batch.column("doc_id"), "remainder": batch.column("remainder")} | {f: found[:, i] for i, f in enumerate(FEATURES)}


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, remainder, statistics): remainder is crc32(doc_id) mod 5."""
    rows = docs.select("doc_id", crc_mod(F.col("doc_id"), 5).cast("int").alias("remainder"), "text")
    return per_batch(rows, _features, "doc_id bigint, remainder int, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass(frozen=True)
class Discriminant:
    """share: of label 1, smoothed.  means, factors (inverse Cholesky factors of
    the covariances), offsets (ln prior - ln det / 2) by class; None when a
    class had no rows."""

    share: float
    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    offsets: tuple[float, float] | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(x), self.share)
        zero, one = (o - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets))
        return 1 / (1 + np.exp(-np.clip(one - zero, -500, 500)))


def discriminant(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK, ridge: float = RIDGE) -> Discriminant:
    """From each class's count, sum of x and sum of x x'."""
    n = [sums[c][0] if c in sums else 0 for c in (0, 1)]
    share = (n[1] + 1) / (sum(n) + 2)
    if not all(n):
        return Discriminant(share)
    means = [sums[c][1] / n[c] for c in (0, 1)]
    scatter = [sums[c][2] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * scatter[0] + n[1] * scatter[1]) / sum(n)
    factors, offsets = [], []
    for c in (0, 1):
        own = (1 - shrink) * scatter[c] + shrink * pooled
        own = (1 - ridge) * own + ridge * max(np.trace(pooled), 1e-9) / len(own) * np.eye(len(own))
        low = np.linalg.cholesky(own)
        factors.append(np.linalg.inv(low))
        offsets.append(float(np.log((n[c] + 1) / (sum(n) + 2)) - np.log(np.diag(low)).sum()))
    return Discriminant(share, tuple(means), tuple(factors), tuple(offsets))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """From all statistics rows whose doc_id has a label of 0 or 1."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__y")).where("__y IN (0, 1)")
    both = stats.join(known, F.col("doc_id") == F.col("__id"))
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    rows = both.groupBy("__y").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f) for f in FEATURES]).alias("x"),
        F.array(*[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])) for i, j in pairs]).alias("xx"),
    ).collect()
    sums = {}
    for r in rows:
        square = np.zeros((d, d))
        for (i, j), v in zip(pairs, r["xx"]):
            square[i, j] = square[j, i] = v
        sums[r["__y"]] = (r["n"], np.array(r["x"]), square)
    return discriminant(sums)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """stats with score."""

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy() for c in columns])))

    return stats.withColumn("score", score(*FEATURES))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    stats = cut(features(docs))
    rows = scored(stats, fit(stats.where("remainder <> 0"), labels))
    return rows.select("doc_id", (F.col("remainder") == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose texts are predicted 1, all columns as they are.
    The text itself is scored where it lies; no row is matched by its id."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(FIT_ROWS)
    known = cut(known)
    ids = known.select(F.col("doc_id").alias("__known")).distinct()
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("__known"), "left_semi")
    model = fit(features(texts).where("remainder <> 0"), known)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t or "") for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))))

    return docs.where(score("text") >= THRESHOLD)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
