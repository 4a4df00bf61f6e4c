"""Random numbers hashed from a seed and an id: they don't depend on how rows
are partitioned, and a task that runs again draws the same.  Who releases
answers must keep the seed secret."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int | str, *ids: Column) -> Column:
    """In (0, 1): the first 52 bits of md5(seed:id...), and half a step."""
    text = F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def gumbel(seed: int | str, *ids: Column) -> Column:
    return -F.ln(-F.ln(uniform(seed, *ids)))


def normal(seed: int | str, *ids: Column) -> Column:
    """Standard normal, by the polar angle of two uniforms."""
    return F.sqrt(-2 * F.ln(uniform(f"{seed}:r", *ids))) * F.cos(F.lit(2 * math.pi) * uniform(f"{seed}:a", *ids))
