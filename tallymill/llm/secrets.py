"""Secret scans: patterned secrets, and strings of high sliding-window entropy.

Edge cases: null text counts as empty and has no span; empty tables give empty
results; repeated rows and ids each give their own row; other columns of the
input, whatever their names, are not read.  Every text is scanned whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import let, read

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ("assign", "access", "hex", "entropy")

#: Values that are known to be harmless though they look random.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",  # UUID
    r"(?i)0123456789|abcdefghij|qwertyuiop",
    # paths and names of several parts: words that may end in a short number, or short numbers
    r"^[/_=-]*(?:[A-Za-z]+[0-9]{0,3}|[0-9]{1,4})(?:[/_=-]+(?:[A-Za-z]+[0-9]{0,3}|[0-9]{1,4}))+[/_=-]*$",
)
#: Character classes, the first that fits, with the bits a character that the best
#: window of a candidate must reach.
CLASSES = (
    ("digits", r"^[0-9]+$", 3.1),
    ("hexadecimal", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0),
    ("one case", r"^(?:[a-z]+|[A-Z]+)$", 3.9),
    ("letters", r"^[A-Za-z]+$", 4.0),
    ("mixed", r"^", 3.75),
)


@dataclass(frozen=True)
class Entropy:
    """window: characters in a window."""

    window: int = 20
    classes: Sequence[tuple[str, str, float]] = CLASSES
    allowed: Sequence[str] = ALLOWED


def window_entropy(value: Column, window: int) -> Column:
    """The largest Shannon entropy, in bits a character, over the windows of
    value; texts shorter than the window are one window.

    The counts of the value's characters are carried from step to step: at each
    step one character enters and, once the window is full, one leaves.  With S
    the sum of c log2 c over the counts c, entropy is log2 n - S / n, and a step
    changes S by the two counts that it touches alone."""
    table = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    gain = lambda k: F.get(table, k + 1) - F.get(table, k)

    def scan(places: Column) -> Column:
        """places: of each character among the different ones."""
        n = F.least(F.size(places), F.lit(window))

        def step(acc: Column, i: Column) -> Column:
            on, off = F.get(places, i), F.when(i >= n, F.get(places, i - n))

            def enter(counts: Column) -> Column:
                less = F.coalesce(gain(F.get(counts, off)), F.lit(0.0))
                total = acc["s"] - less + gain(F.get(counts, on))
                more = F.transform(counts, lambda c, k: F.when(k == on, c + 1).otherwise(c))
                least = F.when(i >= n - 1, F.least(acc["least"], total)).otherwise(acc["least"])
                return F.struct(more.alias("counts"), total.alias("s"), least.alias("least"))

            left = F.transform(acc["counts"], lambda c, k: F.when(k == off, c - 1).otherwise(c))
            return let(left, enter)

        zero = F.struct(F.transform(F.sequence(F.lit(0), F.array_max(places)), lambda _: F.lit(0)).alias("counts"), F.lit(0.0).alias("s"), F.lit(float("inf")).alias("least"))
        least = F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), zero, step, lambda a: a["least"])
        return F.log2(n.cast("double")) - least / n

    def coded(chars: Column) -> Column:
        return let(F.array_distinct(chars), lambda own: F.transform(chars, lambda c: (F.array_position(own, c) - 1).cast("int")))

    return F.when(F.length(value) == 0, F.lit(0.0)).otherwise(let(let(F.split(value, ""), coded), scan))


def random_looking(value: Column, rule: Entropy) -> Column:
    """Whether a candidate reaches the entropy of its character class and isn't
    allowed."""
    need = F.lit(float("inf"))
    for _, pattern, bits in reversed(rule.classes):
        need = F.when(value.rlike(pattern), F.lit(bits)).otherwise(need)
    harmless = F.lit(False)
    for pattern in rule.allowed:
        harmless = harmless | value.rlike(pattern)
    return F.when(harmless, F.lit(False)).otherwise(F.round(window_entropy(value, rule.window), 9) >= need)


def secret_spans(text: Column, rule: Entropy = Entropy()) -> tuple[Column, Column]:
    """(base spans by start, entropy spans).  An entropy span may lie in a base
    span, where it marks the value alone."""
    assign = spans.find(text, ASSIGN, "assign", 0, lambda v: F.length(v) >= 8, group=2, when=text.contains("=") | text.contains(":"))
    access = spans.find(text, r"AKIA[A-Z0-9]++", "access", 1, lambda v: F.length(v) >= 16, when=text.contains("AKIA"))
    hexes = spans.find(text, r"[0-9a-f]{32,}+", "hex", 2, lambda v: F.lit(True))
    long = spans.find(text, r"[A-Za-z0-9+/_=-]{%d,}+" % rule.window, "entropy", 3, lambda v: random_looking(v, rule))
    return spans.by_start(F.concat(assign, access, hexes)), long


def secret_scan(docs: DataFrame, rule: Entropy = Entropy(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, found): arrays of span structs with start, end (code
    points, end exclusive), kind, value and score."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base, long = secret_spans(F.col("text"), rule)
    return rows.select("doc_id", F.struct(base.alias("base"), long.alias("long")).alias("p")).select(
        "doc_id", F.col("p.base").alias("base"), spans.by_start(F.concat("p.base", "p.long")).alias("found")
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        spans.digest(spans.joined(F.col("base"))).alias("base_sha256"),
        spans.joined(F.col("found")).alias("spans"),
    )
