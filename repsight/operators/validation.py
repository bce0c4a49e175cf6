"""One validation step with two outputs and its counts.

A row is checked against named rules in order; it passes, or is rejected with
the name of the first rule that it breaks.  The counts are observed while the
rows are read, so they cost no pass of their own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as K
from .exercises import REGISTRY

REASON = "reject_reason"


def setting_rules(exercise: str = "exercise", strictness: str = "strictness") -> dict[str, Column]:
    """Rules of a session's settings: the exercise is registered, the strictness is a known level in any case of letters."""
    return {
        "unknown exercise": F.col(exercise).isin(*REGISTRY),
        "unknown strictness": F.lower(F.col(strictness)).isin(*K.STRICTNESS_DEGREES),
    }


def coordinate_rule(*columns: str) -> dict[str, Column]:
    """Coordinates are present, finite numbers."""
    fine = F.lit(True)
    for c in columns:
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return {"broken coordinates": fine}


def checked(rows: DataFrame, rules: Mapping[str, Column], observation: Observation | None = None) -> DataFrame:
    """``rows`` with ``reject_reason``, null where all rules hold (a rule that gives null is broken).

    ``observation`` receives, once an action has read all rows, their number as
    ``rows`` and that of each reason's rejects under its name.
    """
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    out = rows.withColumn(REASON, reason)
    if observation is None:
        return out
    counts = [F.count_if(F.col(REASON) == name).alias(name) for name in rules]
    return out.observe(observation, F.count(F.lit(1)).alias("rows"), *counts)


def split(rows: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rejected rows with their reason)."""
    out = checked(rows, rules)
    return out.where(F.col(REASON).isNull()).drop(REASON), out.where(F.col(REASON).isNotNull())
