"""Registered queries on native pose sessions (frames with landmarks + controls)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round6
from ..operators import analytics as AN
from ..operators import pose_sessions as PS
from ..sources import adapters as A
from .registry import query
from .sets import map_text, micros


def native_segments(spark: SparkSession, base: str, gaps: bool = False) -> tuple[DataFrame, DataFrame]:
    frames, controls = A.native_sessions(spark, base, gaps)
    return PS.pose_segments(PS.native_messages(frames, controls)), frames


def native_tables(spark: SparkSession, base: str):
    seg, frames = native_segments(spark, base)
    return PS.set_tables(seg, frames)


@query("pose_session_frames")
def pose_session_frames(spark: SparkSession, base: str) -> DataFrame:
    """Per kept frame of pose sessions: set, frame, latch, form and both angles."""
    seg, _ = native_segments(spark, base)
    return seg.select(
        "session_id", "seq", "series_number", F.col("frame").cast("bigint").alias("frame"), "left_side", "down",
        F.col("reps").cast("bigint").alias("reps"), "done", "form_ok", "form_issues", "exercise",
        round6("rep").alias("rep_angle"), round6("aux").alias("aux_angle"),
    )


@query("set_ids")
def set_ids(spark: SparkSession, base: str) -> DataFrame:
    """The number of every completed set, 1 to n without gaps."""
    from ..operators.store import number_rows

    seg, _ = native_segments(spark, base)
    key = ["session_id", "series_number"]
    return number_rows(seg.groupBy(key).agg(F.max("done").alias("done")).where("done").select(key), key).select(*key, "id")


@query("pose_session_sets")
def pose_session_sets(spark: SparkSession, base: str) -> DataFrame:
    """The ``workout`` table of completed sets of pose sessions."""
    w, _an, _raw = native_tables(spark, base)
    return w.select(
        "id", "workout_name", micros("timestamp_start").alias("timestamp_start_us"),
        F.col("rep_goal").cast("bigint").alias("rep_goal"), F.col("series_number").cast("bigint").alias("series_number"),
        "strictness_crit", "strictness_definition", "left_side",
        map_text(F.col("ldmrks_of_interest")).alias("ldmrks_of_interest"),
    )


@query("pose_session_summary")
def pose_session_summary(spark: SparkSession, base: str) -> DataFrame:
    """Analytics pack on the stored tables of pose sessions: start frame, reps, durations."""
    w, an, _raw = native_tables(spark, base)
    params = AN.set_params(w, an)
    trim = AN.trimmed(an, params)
    meta = AN.set_metadata(w, an).select(F.col("id").alias("workout_id"), "duration")
    out = (
        params.select("workout_id", "frame_start")
        .join(meta, "workout_id", "left")
        .join(AN.total_reps(trim), "workout_id", "left")
        .join(AN.avg_rep_time(AN.rep_spans(trim)), "workout_id", "left")
    )
    return out.select(
        "workout_id", "frame_start", round6("duration").alias("duration"), "total_repetitions",
        round6("average_time_repetitions").alias("average_time_repetitions"),
    )


@query("frame_messages")
def frame_messages(spark: SparkSession, base: str) -> DataFrame:
    """The JSON response of every processed frame of pose sessions."""
    from ..operators import exercises as X
    from ..operators.text import frame_message

    seg, frames = native_segments(spark, base)
    j = seg.join(frames.select("session_id", "seq", "landmarks"), ["session_id", "seq"], "inner")
    angles = X.angles_data(F.col("exercise"), F.col("rep"), F.col("aux"), F.col("left_side"))
    msg = frame_message(F.col("landmarks"), F.col("reps"), F.col("form_ok"), F.col("form_issues"), angles,
                        F.col("down"), F.col("has_pose"), coord_decimals=4)
    return j.select("session_id", "seq", msg.alias("message"))


MESSAGE = (
    "landmarks array<struct<x:double,y:double>>, rep_count bigint, form_ok boolean, form_message string,"
    " display_angles array<struct<name:string,value:double,joint_indices:array<int>>>, is_down_phase boolean"
)


@query("frame_responses")
def frame_responses(spark: SparkSession, base: str) -> DataFrame:
    """What a client reads from the JSON response of every processed frame, with
    and without a pose, coordinates unrounded (S10, P10, P12)."""
    from ..operators import exercises as X
    from ..operators.text import frame_message

    seg, frames = native_segments(spark, base, gaps=True)
    j = seg.join(frames.select("session_id", "seq", "landmarks"), ["session_id", "seq"], "inner")
    angles = X.angles_data(F.col("exercise"), F.col("rep"), F.col("aux"), F.col("left_side"))
    msg = frame_message(F.col("landmarks"), F.col("reps"), F.col("form_ok"), F.col("form_issues"), angles,
                        F.col("down"), F.col("has_pose"))
    m = F.col("m")
    read = j.select("session_id", "seq", "series_number", "done", F.from_json(msg, MESSAGE).alias("m"))

    def total(axis: str):
        return round6(F.aggregate(m["landmarks"], F.lit(0.0), lambda a, p: a + p[axis]))

    return read.select(
        "session_id", "seq", "series_number", "done", m["rep_count"].alias("rep_count"), m["form_ok"].alias("form_ok"),
        m["form_message"].alias("form_message"), m["is_down_phase"].alias("is_down_phase"),
        F.size(m["landmarks"]).cast("bigint").alias("n_landmarks"), total("x").alias("sum_x"), total("y").alias("sum_y"),
        F.array_join(m["display_angles"]["name"], ",").alias("angle_names"),
    )
