"""A store of partial answers that add up: sums by cell of some input files each.

A batch is a folder of sums (query_id, ans), the whole weight under -1, and a
manifest of the files that it counts, by path, length and time of change, written
last.  Answers of a table add the batches whose files are all still as they were,
and count the files that are in none.  Batches that share a file are never added
together, so two runs that count the same files at once do no harm, nor does a
run that died before its manifest.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..domain import EncodedData
from ..operators.marginals import finished, sums
from ..plans.workload import QuerySpace

WHOLE = -1
#: Batches of a store that are added into one by compact().
MANY = 64


@dataclass(frozen=True)
class Batch:
    path: str
    files: frozenset[tuple[str, int, int]]


def space_key(space: QuerySpace) -> str:
    text = json.dumps([space.domain.config, [w.attrs for w in space.workloads]])
    return hashlib.sha256(text.encode()).hexdigest()[:32]


class AnswerStore:
    """Answers to a space's queries.  encode takes the raw rows of files to
    EncodedData row by row, since files are counted apart."""

    def __init__(self, spark: SparkSession, folder: str, space: QuerySpace, encode: Callable[[DataFrame], EncodedData]) -> None:
        self.spark, self.space, self.encode = spark, space, encode
        self.folder = f"{folder}/{space_key(space)}"

    def batches(self) -> list[Batch]:
        """Those with a manifest, the ones of most files first."""
        out = []
        for path, _, _ in storage.files(self.spark, f"{self.folder}/manifests"):
            told = json.loads(storage.read_text(self.spark, path))
            out.append(Batch(told["sums"], frozenset(tuple(f) for f in told["files"])))
        return sorted(out, key=lambda b: (-len(b.files), b.path))

    def _add(self, found: DataFrame, files: Sequence[tuple], name: str) -> Batch:
        path = f"{self.folder}/sums/{name}-{uuid.uuid4().hex}"
        found.write.parquet(path)
        storage.write_text(self.spark, f"{self.folder}/manifests/{name}.json", json.dumps({"sums": path, "files": sorted(files)}))
        return Batch(path, frozenset(files))

    def _sums(self, rows: DataFrame) -> DataFrame:
        data = self.encode(rows)
        whole = data.df.agg(F.coalesce(F.sum(data.mass()), F.lit(0.0)).alias("ans")).select(F.lit(WHOLE).cast("bigint").alias("query_id"), "ans")
        return sums(data, self.space).unionByName(whole)

    def add_rows(self, rows: DataFrame, name: str) -> None:
        """Rows from elsewhere (a stream's batch), under a name of their own; rows
        added again under one name take the place of the first ones."""
        self._add(self._sums(rows), [(name, 0, 0)], hashlib.sha256(name.encode()).hexdigest()[:32])

    def _current(self, files: Sequence[tuple]) -> tuple[list[Batch], set[tuple]]:
        """Batches that together count some of the files once, and the other files."""
        left, chosen = set(files), []
        for b in self.batches():
            if b.files <= left:
                chosen.append(b)
                left -= b.files
        return chosen, left

    def added(self) -> list[Batch]:
        """Batches of rows that came from elsewhere."""
        return [b for b in self.batches() if all(n == 0 and t == 0 for _, n, t in b.files)]

    def counts(self, path: str | Sequence[str] | None = None) -> DataFrame:
        """(query_id, ans): sums of the table's rows, new files counted now; without
        a path, of the rows that were added."""
        if path is None:
            chosen, _ = self._current([f for b in self.added() for f in b.files])
        else:
            files = [f for p in ([path] if isinstance(path, str) else path) for f in storage.files(self.spark, p)]
            chosen, new = self._current(files)
            if new:
                names = sorted(f for f, _, _ in new)
                found = self._sums(self._read(names))
                chosen.append(self._add(found, sorted(new), hashlib.sha256(json.dumps(sorted(new)).encode()).hexdigest()[:32]))
        if not chosen:
            return self.spark.createDataFrame([(WHOLE, 0.0)], "query_id bigint, ans double")
        return self.spark.read.parquet(*[b.path for b in chosen]).groupBy("query_id").agg(F.sum("ans").alias("ans"))

    def _read(self, names: list[str]) -> DataFrame:
        from .io import read_table

        return read_table(self.spark, names)

    def answers(self, path: str | Sequence[str] | None = None, density: str | None = "valid") -> DataFrame:
        """(query_id, ans) of every query, as marginals.answers gives them."""
        found = self.counts(path)
        whole = found.where(F.col("query_id") == WHOLE).select(F.col("ans").alias("__all"))
        return finished(found.where(F.col("query_id") != WHOLE), self.space, density, whole)

    def compact(self, many: int = MANY) -> None:
        """Adds the smallest batches together, of files and of rows apart, so that
        a store of many small additions stays short.  Their sums stay for readers."""
        for own in ([b for b in self.batches() if b not in self.added()], self.added()):
            taken: list[Batch] = []
            for b in sorted(own, key=lambda b: len(b.files))[:many]:
                if all(b.files.isdisjoint(t.files) for t in taken):
                    taken.append(b)
            if len(taken) > 1:
                found = self.spark.read.parquet(*[b.path for b in taken]).groupBy("query_id").agg(F.sum("ans").alias("ans"))
                files = sorted(f for b in taken for f in b.files)
                self._add(found, files, hashlib.sha256(json.dumps(files).encode()).hexdigest()[:32])
