"""Schemas of the domain tables."""

from __future__ import annotations

from pyspark.sql import types as T

from .constants import N_LANDMARKS

LANDMARK = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("visibility", T.DoubleType()),
    ]
)
POSE = T.ArrayType(LANDMARK)

# Native frame stream: one row per decoded frame of a session, in ``seq`` order.
FRAMES = T.StructType(
    [
        T.StructField("session_id", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("landmarks", POSE),
    ]
)

# Native control stream: JSON-ish control messages of a session.
CONTROLS = T.StructType(
    [
        T.StructField("session_id", T.LongType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

ANGLE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("joint_indices", T.ArrayType(T.IntegerType())),
    ]
)

WORKOUT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("workout_name", T.StringType(), False),
        T.StructField("timestamp_start", T.TimestampNTZType(), False),
        T.StructField("rep_goal", T.IntegerType(), False),
        T.StructField("series_number", T.IntegerType()),
        T.StructField("strictness_crit", T.StringType(), False),
        T.StructField("strictness_definition", T.DoubleType(), False),
        T.StructField("left_side", T.BooleanType(), False),
        T.StructField("ldmrks_of_interest", T.MapType(T.IntegerType(), T.StringType()), False),
    ]
)

WORKOUT_ANALYSIS = T.StructType(
    [
        T.StructField("workout_id", T.LongType(), False),
        T.StructField("frame", T.IntegerType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("rep_count", T.IntegerType(), False),
        T.StructField("down", T.BooleanType(), False),
        T.StructField("form_issues", T.StringType(), False),
        T.StructField("angles_data", T.ArrayType(ANGLE), False),
    ]
)


def raw_landmark_columns() -> list[str]:
    cols = []
    for i in range(N_LANDMARKS):
        cols += [f"landmark_{i}_x", f"landmark_{i}_y"]
    return cols


RAW_LANDMARKS = T.StructType(
    [
        T.StructField("frame", T.IntegerType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("workout_id", T.LongType(), False),
    ]
    + [T.StructField(c, T.DoubleType()) for c in raw_landmark_columns()]
)

LANDMARK_DIM = T.StructType(
    [
        T.StructField("index", T.IntegerType(), False),
        T.StructField("side", T.StringType()),
        T.StructField("name", T.StringType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("workout_id", T.LongType(), False),
        T.StructField("response", T.StringType()),
    ]
)
