"""Registered queries: per-frame state and repetition counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round6
from ..operators.reps import pose_frame_state, signal_frame_state
from ..sources import adapters as A
from .registry import query


def events_state(spark: SparkSession, base: str) -> DataFrame:
    return signal_frame_state(A.events_signal(spark, base), ["workout_id"], A.EVENT_ORDER)


def lineitem_state(spark: SparkSession, base: str) -> DataFrame:
    return signal_frame_state(A.lineitem_signal(spark, base), ["workout_id"], A.LINEITEM_ORDER)


def rep_totals(state: DataFrame) -> DataFrame:
    return state.groupBy("workout_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.max("rep_count").cast("bigint").alias("reps"),
    )


@query("rep_counts")
def rep_counts(spark: SparkSession, base: str) -> DataFrame:
    """Flagship: repetitions and frames per workout (angle signal from events)."""
    return rep_totals(events_state(spark, base))


@query("frame_state")
def frame_state(spark: SparkSession, base: str) -> DataFrame:
    """Per frame: number, latch position, running repetitions and form (events)."""
    s = events_state(spark, base)
    return s.select(
        "workout_id", "frame", round6("angle").alias("angle"), "down",
        "rep_count", F.col("form").alias("form_ok"),
    )


@query("scale_frame_state")
def scale_frame_state(spark: SparkSession, base: str) -> DataFrame:
    """Per-frame state over lineitem (one workout per supplier): the scale run."""
    s = lineitem_state(spark, base)
    return s.select("workout_id", "frame", "down", "rep_count", F.col("form").alias("form_ok"))


@query("scale_rep_counts")
def scale_rep_counts(spark: SparkSession, base: str) -> DataFrame:
    return rep_totals(lineitem_state(spark, base))


def pushup_state(spark: SparkSession, base: str, strictness: str = "loose") -> DataFrame:
    return pose_frame_state(A.pushup_poses(spark, base), ["workout_id"], A.EVENT_ORDER, "push-ups", strictness)


def squat_state(spark: SparkSession, base: str, strictness: str = "loose") -> DataFrame:
    return pose_frame_state(A.squat_poses(spark, base), ["workout_id"], A.EVENT_ORDER, "squats", strictness)


def _form_view(s: DataFrame) -> DataFrame:
    return s.select(
        "workout_id", "frame", "left_side", "down", "rep_count", "form_ok", "form_issues",
        round6("rep").alias("rep_angle"), round6("aux").alias("aux_angle"),
    )


@query("pushup_form")
def pushup_form(spark: SparkSession, base: str) -> DataFrame:
    return _form_view(pushup_state(spark, base))


@query("pushup_reps")
def pushup_reps(spark: SparkSession, base: str) -> DataFrame:
    return rep_totals(pushup_state(spark, base))


@query("squat_form")
def squat_form(spark: SparkSession, base: str) -> DataFrame:
    return _form_view(squat_state(spark, base))


@query("squat_reps")
def squat_reps(spark: SparkSession, base: str) -> DataFrame:
    return rep_totals(squat_state(spark, base))
