"""Data-quality checks implied by the table constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Nulls per NOT NULL column: one partial aggregate, unpivoted with ``stack``."""
    agg = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return agg.select(F.lit(table).alias("table"), F.expr(f"stack({len(columns)}, {pairs}) AS (column, nulls)"))


def key_summary(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and keys seen more than once (primary-key check)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_keys"),
    ).select(F.lit(table).alias("table"), F.lit(",".join(keys)).alias("key"), "rows", "distinct_keys", "duplicate_keys")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent row (foreign-key check, ``left_anti``)."""
    p = parent.select(F.col(parent_key).alias("__k")).distinct()
    return child.join(p, child[child_key] == p["__k"], "left_anti")
