"""Typed JSON messages (S2, S10) on the VARIANT type: values keep the type that the JSON text gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K

NUMBER = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"
WHOLE = r"^\s*[+-]?[0-9]{1,18}\s*$"


def envelope(kind: str, message: Column, status: Column | None = None) -> Column:
    """An outgoing message as JSON text; ``status`` only for messages of kind data."""
    fields = [F.lit(kind).alias("type"), message.alias("message")]
    return F.to_json(F.struct(*fields, *([status.alias("status")] if status is not None else [])))


def read_envelopes(rows: DataFrame, text_col: str = "envelope") -> DataFrame:
    """Add ``type``, ``message`` and ``status`` of outgoing messages, read from their JSON text."""
    message = F.try_parse_json(F.col(text_col))
    get = lambda name: F.try_variant_get(message, f"$.{name}", "string").alias(name)
    return rows.select("*", get("type"), get("message"), get("status"))


def whole_number(value: Column) -> Column:
    """A JSON value as a 32-bit whole number, null where it is none.

    A number is cut towards zero (3.7 gives 3), true and false are 1 and 0, a
    text must hold a whole number ("3", not "3.7"); null, lists and objects
    are none.
    """
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.when(kind.rlike(NUMBER), F.try_variant_get(value, "$", "double").try_cast("bigint"))
    number = number.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
    number = number.when((kind == "STRING") & text.rlike(WHOLE), F.trim(text).try_cast("bigint"))
    return number.try_cast("int")


def typed_controls(raw: DataFrame, text_col: str = "message") -> DataFrame:
    """Control messages with their typed value: ``type``, ``value`` (text), ``goal`` and ``reject_reason``.

    Every input row comes out once.  ``goal`` is the whole number of a ``reps``
    message (a missing value means the default); a ``reps`` message without one
    is rejected, as is text that is no JSON object with a type.
    """
    parsed = raw.withColumn("__m", F.try_parse_json(F.col(text_col)))
    kind = F.try_variant_get("__m", "$.type", "string")
    value = F.try_variant_get("__m", "$.value", "variant")
    default = F.lit(int(K.CONTROL_DEFAULTS["reps"]))
    goal = F.when(kind == "reps", F.when(value.isNull(), default).otherwise(whole_number(value)))
    reason = (
        F.when(F.col("__m").isNull(), "malformed JSON").when(kind.isNull(), "no type")
        .when((kind == "reps") & goal.isNull(), "no whole number")
    )
    keep = [c for c in raw.columns if c != text_col]
    return parsed.select(
        *keep, kind.alias("type"), F.try_variant_get("__m", "$.value", "string").alias("value"), goal.alias("goal"),
        reason.alias("reject_reason"),
    )
