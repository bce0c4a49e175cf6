"""Control messages as JSON text (S2): parse, default, reject.

A message is ``{"type": ..., "value": ...}``; ``value`` may be any JSON scalar
(``"squats"``, ``3``, ``true``) and is kept as its text.  Text that is not a
JSON object with a ``type`` goes to the rejects with a reason, as the
analysed loop skips it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROL_JSON = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType())])


def parse_controls(raw: DataFrame, text_col: str = "message") -> tuple[DataFrame, DataFrame]:
    """(controls, rejects) from JSON text; other columns are carried along."""
    parsed = raw.withColumn("__m", F.from_json(F.col(text_col), CONTROL_JSON, {"mode": "PERMISSIVE"}))
    ok = F.col("__m").isNotNull() & F.col("__m")["type"].isNotNull()
    keep = [c for c in raw.columns if c != text_col]
    controls = parsed.where(ok).select(*keep, F.col("__m")["type"].alias("type"), F.col("__m")["value"].alias("value"))
    rejects = parsed.where(~ok).select(
        *keep, F.col(text_col),
        F.when(F.try_parse_json(F.col(text_col)).isNull(), F.lit("malformed JSON"))
        .otherwise(F.lit("no type")).alias("reject_reason"),
    )
    return controls, rejects
