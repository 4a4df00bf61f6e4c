"""The corpus pipeline: each stage works on the documents that its predecessor
kept, is written as Parquet and read again.

Edge cases, in every stage: a null text counts as empty (and stays null where it
is passed on), repeated rows are rows of their own until near duplicates go, null
ids are kept, other columns pass through to the last stage whatever their names,
and an empty table gives an empty result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallymill.llm.common import read, shared_folder
from tallymill.llm.mixing import mix
from tallymill.llm.packing import pack
from tallymill.llm.pii import redact
from tallymill.llm.quality_classifier import keep_good
from tallymill.llm.simhash import Near, keep_one
from tallymill.storage import remove

#: SQL has no quadratic discriminant, fingerprint graph or genetic search.
ORACLE_SQL = None

#: Near duplicates: 0.8 of the five-word shingles shared, exactly; three bits only propose.
NEAR = Near(radius=3, exact=0.8)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of least id; rows
    of one id with unlike texts both stay."""
    return keep_one(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated toward the target weights of their sources."""
    mixed = mix(docs)
    return mixed.drop(*[c for c in mixed.columns if c not in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before it are removed once they are read."""
    docs, before = read(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
