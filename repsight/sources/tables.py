"""Readers for parquet tables, with explicit column pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Read ``{base}/{name}.parquet`` (or a folder of parquet files).

    Selecting the columns here keeps the scan's ReadSchema narrow even before
    Catalyst prunes the rest of the plan.
    """
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
