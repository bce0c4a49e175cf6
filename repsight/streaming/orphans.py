"""Child rows without a parent row, found while both tables stream in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphan_stream(children: DataFrame, parents: DataFrame, key: str, ts: str, delay: str, span: str) -> DataFrame:
    """Rows of ``children`` that no row of ``parents`` of the same ``key`` precedes by at most ``span``.

    A stream-stream left outer join: a child waits in state until the watermark
    rules out that its parent still comes, and a parent until no child of its
    span can come, so the state holds ``delay`` and ``span`` at most.
    """
    child = children.withWatermark(ts, delay)
    parent = parents.select(F.col(key).alias("__key"), F.col(ts).alias("__ts")).withWatermark("__ts", delay)
    near = (F.col(ts) >= F.col("__ts")) & (F.col(ts) <= F.col("__ts") + F.expr(f"INTERVAL {span}"))
    joined = child.join(parent, (F.col(key) == F.col("__key")) & near, "left")
    return joined.where(F.col("__key").isNull()).drop("__key", "__ts")
