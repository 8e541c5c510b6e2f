"""What a plan does, and whether a side is small enough to broadcast."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a join side is broadcast by this package's own choice.
BROADCAST_BYTES = 8 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint where the estimate is within the limit; beyond it the
    optimiser (with AQE) chooses a shuffled join."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def explain(df: DataFrame) -> str:
    """The physical plan as text, without starting a job."""
    return df._jdf.queryExecution().executedPlan().toString()


def operators(df: DataFrame) -> list[str]:
    """Names of the physical plan's nodes, from the top."""
    out = []
    for line in explain(df).splitlines():
        m = re.match(r"[\s:+*()\d-]*([A-Z]\w+)", line)
        if m:
            out.append(m[1])
    return out


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[([^\]]*)\]", explain(df))


def read_columns(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^>]*)>", explain(df))
