"""Arrow batches for the operators that leave the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A-Z to a-z, other bytes as they are.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


#: Rows that a function sees at once: what it makes of them is many times their size.
ROWS = 500


def given_back(result: pa.Table | None = None) -> pa.Table | None:
    """The result of a function that has ended.  Memory that the allocators of Arrow
    and of the C library keep for later goes back to the system: a Python worker
    that waits for its next task, or stage, shares the executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
    return result


def per_batch(df: DataFrame, fn: Callable[..., dict], schema: str, *args) -> DataFrame:
    """df with fn(batch, *args) -> columns applied to slices of every Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                columns = fn(batch.slice(at, ROWS), *args)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as strings; null is ''."""
    return [x or "" for x in batch.column(name).to_pylist()]


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key; each may hold many
    groups.  Only the last, unfinished group is held back between batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
