"""Small tables with every awkward row: nulls, empty and long texts, repeated
rows and ids, and extra columns whose names clash with the operators' own."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp string, home int, at int, chunk int, __id int"
TABLE = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng: random.Random, n: int) -> str:
    syllables = ["th", "er", "an", "Re", "on", "é", "ß", "est", "or", "ti"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", ",", "."]) for _ in range(n))


def rows(seed: int = 1, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 3, 4, 5, 6, 30, 120, 400])) for _ in range(n)]
    texts[3] = texts[2]
    texts[5] = texts[4] + " extra"
    texts[6] = texts[7].replace(",", "", 1) if len(texts) > 7 else ""
    texts += ["", " \t\n", "one", "ONE", "x " * 3000, "\n\n", "a\x0bb\x0cc", "漢字 😀 words   kept"]
    out = [(i * 3, t) for i, t in enumerate(texts)]
    out += [(1, None), (2, None), (9, texts[0]), (9, texts[0]), (None, texts[1]), (None, None)]
    return out


def frame(spark, pairs):
    wide = [(i, t, "en", f"src{(i or 0) % 3}" if i != 1 else None, len(t or ""), 0.5, "fp", 7, 8, 9, 10) for i, t in pairs]
    return spark.createDataFrame(wide, SCHEMA)


def table(spark, pairs, path) -> str:
    """A folder with documents as a table."""
    df = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in pairs], TABLE)
    df.repartition(3).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return str(path)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
