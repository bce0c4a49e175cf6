"""Helpers shared by the training-data operators."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_training_fold(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is not 0; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0, F.lit(False))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0 (a null id counts as the empty text's crc, which is 0)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def binary(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def hash_below(of: Column, rows: Column, wanted: int) -> Column:
    """Whether a row is in a sample of about ``wanted`` of ``rows`` rows (all, if fewer): its hash lies in that share of all hashes."""
    share = F.least(F.lit(wanted) / F.greatest(rows, F.lit(1)), F.lit(1.0))
    return F.xxhash64(of) / F.lit(2.0**64) + 0.5 <= share


def split_points(df: DataFrame, key: str, buckets: int, per_bucket: int = 64) -> list[str]:
    """At most ``buckets - 1`` increasing values of the string column ``key``.

    They come from a random sample of about ``buckets * per_bucket`` keys and
    only balance the buckets; they decide no result.
    """
    wanted = buckets * per_bucket
    share = min(1.0, wanted / max(1, df.count()))
    keys = sorted(r[0] for r in df.select(key).where(F.rand(17) < share).collect())
    if not keys:
        return []
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)})


def bucket_of(key: Column, points: list[str]) -> Column:
    """Number of split points at or below the key: buckets follow the key's order."""

    @F.pandas_udf("int")
    def at(values: pd.Series) -> pd.Series:
        return values.map(lambda v: bisect_right(points, v)).astype("int32")

    return at(key)


FOLD_BLOCK = 256


def fold_sql(items: str, kind: str, state: str, emit: str, start: str) -> str:
    """SQL of a fold along an array that emits values on the way; its work grows with the length to the power 1.5.

    ``items`` gives the array, ``start`` the first state, ``state`` the next one and ``emit`` an array of type
    ``kind`` of what an item ``x`` adds, both from ``acc.st`` and ``x``.  Appending to one list in a fold copies it at
    every item; here a list is only as long as a block, and the blocks' lists are joined at the end.
    """
    inner = f"""aggregate(slice(it, b * {FOLD_BLOCK} + 1, {FOLD_BLOCK}), named_struct('st', o.st, 'part', cast(array() AS {kind})),
      (acc, x) -> named_struct('st', {state}, 'part', concat(acc.part, {emit})))"""
    return f"""transform(array({items}), it -> aggregate(sequence(0, (size(it) - 1) div {FOLD_BLOCK}),
  named_struct('st', {start}, 'out', cast(array() AS array<{kind}>)),
  (o, b) -> transform(array({inner}), i -> named_struct('st', i.st, 'out', concat(o.out, array(i.part))))[0],
  o -> flatten(o.out)))[0]"""


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of an Arrow stream, one batch in memory at a time."""
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(c.to_pylist() for c in batch.columns)):
            yield dict(zip(names, values))
