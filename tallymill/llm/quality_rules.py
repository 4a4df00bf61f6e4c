"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document; the ledger keeps its measurements
and one failure bit for each rule, and is stored beside the rules' names and
bits.  Policies are versioned sets of bits applied to the stored ledger later,
and ablations are bitwise aggregates over it; neither reads a text again.

Edge cases: null text has no words and no lines; empty tables give empty
results; repeated rows and ids each give their own row; other columns are not
read.  Every text is measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_SPACE, let, read, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """name, and a SQL condition over the measurements that says the rule fails."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("stuttering", "5 * n_stutter > n_words"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
#: version -> bits that reject
POLICIES = {
    "v1": BASE,
    "v2": BASE | BIT["many_symbols"] | BIT["repeated_lines"],
    "v3": sum(BIT.values()),
}
CURRENT = "v3"


def covered_words(ws: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more.

    Hashes of windows tell whether any can repeat; only then are the windows
    themselves sorted and compared.  A repeated window adds the words that the
    one before it doesn't cover."""
    n = F.size(ws) - WINDOW

    def hashes(step: int, values: Column) -> Column:
        return F.transform(
            F.when(F.size(values) > step, F.sequence(F.lit(0), F.size(values) - step - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.xxhash64(F.get(values, i), F.get(values, i + step)),
        )

    def exact(_: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.array_join(F.slice(ws, i + 1, WINDOW), " ").alias("w"), i.alias("i")))

        def places(run: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(run, i)["w"] == F.get(run, j)["w"], F.lit(False))
            near = lambda i: (i > 0) & same(F.greatest(i - 1, F.lit(0)), i) | same(i, i + 1)
            at = F.filter(F.sequence(F.lit(0), n), near)
            return F.array_sort(F.transform(at, lambda i: F.get(run, i)["i"]))

        def add(acc: Column, i: Column) -> Column:
            more = F.least(F.lit(WINDOW), i - acc["last"])
            return F.struct(i.alias("last"), (acc["sum"] + more).alias("sum"))

        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(let(F.array_sort(windows), places), zero, add, lambda acc: acc["sum"])

    eights = let(let(hashes(1, ws), lambda h: hashes(2, h)), lambda h: hashes(4, h))
    return F.when(n < 0, F.lit(0)).otherwise(let(eights, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h))))


def measures(text: Column) -> Column:
    """All measurements of a text, as a struct of longs."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_SPACE))

    def of_words(ws: Column) -> Column:
        return let(lines, lambda ls: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            covered_words(ws).cast("long").alias("n_repeat_words"),
            F.size(F.filter(ws, lambda w, i: (i > 0) & (w == F.get(ws, F.greatest(i - 1, F.lit(0)))))).cast("long").alias("n_stutter"),
        ))

    return let(words(text), of_words)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements, fail_bits)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    measured = rows.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*")
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(BIT[rule.name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def write_ledger(rows: DataFrame, path: str) -> None:
    """The ledger as Parquet, with the rules that its bits stand for."""
    rows.write.parquet(f"{path}/ledger")
    spark = rows.sparkSession
    spark.createDataFrame([(r.name, BIT[r.name], r.fails) for r in RULES], "rule string, bit long, fails string").coalesce(1).write.parquet(f"{path}/rules")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A stored ledger; an error if its bits stand for other rules than these."""
    held = {r["rule"]: (r["bit"], r["fails"]) for r in spark.read.parquet(f"{path}/rules").collect()}  # one row a rule
    if held != {r.name: (BIT[r.name], r.fails) for r in RULES}:
        raise ValueError("this ledger was made by other rules")
    return spark.read.parquet(f"{path}/ledger")


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with kept: no failure among the policy's bits."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0)


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """One row for each rule of a policy: how many documents fail it, how many
    fail nothing else in the policy (what dropping the rule would bring back),
    and the bits that ever fail together with it.  One pass over the ledger."""
    mask = POLICIES[version]
    own = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    parts = []
    for rule in RULES:
        if bit := BIT[rule.name] & mask:
            hit = own.bitwiseAND(F.lit(bit).cast("long")) != 0
            parts.append(F.struct(
                F.lit(rule.name).alias("rule"), F.count(F.when(hit, 1)).alias("n_failed"), F.count(F.when(own == bit, 1)).alias("n_only"),
                F.coalesce(F.bit_or(F.when(hit, own)), F.lit(0).cast("long")).alias("seen_with"),
            ))
    return rows.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select(F.lit(version).alias("version"), "r.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(read(spark, sf_dir, "documents")))
    failed = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "fail_bits",
    )


def _sql() -> str:
    bits = " + ".join(f"(CASE WHEN {r.fails} THEN {BIT[r.name]} ELSE 0 END)" for r in RULES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1
), c AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         (SELECT count(*) FROM (SELECT unnest(range(2, len(ws) + 1)) AS i) WHERE ws[i] = ws[i - 1])::BIGINT AS n_stutter
  FROM w LEFT JOIN c USING (rid)
), f AS (SELECT *, ({bits})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & {BASE}) <> 0 AS base_failed, (fail_bits & {POLICIES[CURRENT]}) = 0 AS kept, fail_bits
FROM f
"""


OP4_SQL = _sql()
