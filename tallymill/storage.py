"""Intermediate tables: stored in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.  A session on
    one machine that names none (a test) gets a folder of its own; on a cluster
    that is an error, since no such folder would be seen by all."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallymill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder; what follows reads it there
    and doesn't depend on the executors that made it.  Spark removes the files of
    tables that nobody holds any more if the session sets
    spark.cleaner.referenceTracking.cleanCheckpoints."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def path_of(spark: SparkSession, path: str):
    """(file system, Hadoop path): whatever store Spark itself can read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = path_of(spark, path)
    return fs.exists(at)


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, length, time of change) of the files in a folder and below, or of a
    file; names that start with _ or . are left out, as Spark's readers do."""
    fs, at = path_of(spark, path)
    if not fs.exists(at):
        return []
    found, base = fs.listFiles(at, True), fs.makeQualified(at).toString()
    out = []
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        if not re.search("(^|/)[_.]", name.removeprefix(base)):
            out.append((name, f.getLen(), f.getModificationTime()))
    return sorted(out)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = path_of(spark, path)
    fs.delete(at, True)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, whole."""
    fs, at = path_of(spark, path)
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, at = path_of(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    return read_bytes(spark, path).decode("utf-8")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))
