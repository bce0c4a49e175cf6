"""Registered queries over the stored set tables (analytics pack)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import invert_map, round6
from ..operators import analytics as AN
from ..operators.reps import pose_frame_state
from ..operators.scan import checkpoint, number_frames
from ..operators.tables import analysis_rows, raw_landmark_rows, workout_rows
from ..sources import adapters as A
from .registry import query


def set_state(spark: SparkSession, base: str) -> DataFrame:
    """Per-frame state of one set per user (mixed exercises and strictness)."""
    poses = A.set_poses(spark, base)
    return pose_frame_state(poses, ["workout_id"], A.EVENT_ORDER, F.col("exercise"), F.col("strictness"))


def set_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The stored ``workout`` and ``workout_analysis`` tables of the sets.

    The per-frame state is materialised once (as the stored tables are in the
    analysed application); every analytic reads it instead of recomputing the
    scans.
    """
    st = checkpoint(set_state(spark, base))
    return workout_rows(st), analysis_rows(st)


def raw_table(spark: SparkSession, base: str) -> DataFrame:
    """The stored landmarks; frames are numbered before their poses are built, so 33 points cross no exchange."""
    numbered = number_frames(A.set_events(spark, base), ["workout_id"], A.EVENT_ORDER, "chunk")
    poses = A.with_set_pose(numbered).select("workout_id", "ts", "event_id", "chunk", "frame", "landmarks")
    return raw_landmark_rows(poses)


def map_text(m: Column) -> Column:
    """A map as sorted ``key:value`` text."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"])),
        ",",
    )


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock (NTZ) timestamp, independent
    of the session time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def list_text(arr: Column) -> Column:
    return F.array_join(arr, ",", "None")


@query("start_frame")
def start_frame(spark: SparkSession, base: str) -> DataFrame:
    _w, an = set_tables(spark, base)
    return AN.start_frames(an)


@query("set_metadata")
def set_metadata(spark: SparkSession, base: str) -> DataFrame:
    w, an = set_tables(spark, base)
    m = AN.set_metadata(w, an)
    return m.select(
        "id", "workout_name", micros("timestamp_start").alias("timestamp_start_us"),
        F.col("rep_goal").cast("bigint").alias("rep_goal"),
        F.col("series_number").cast("bigint").alias("series_number"),
        "strictness_crit", "strictness_definition", "left_side",
        map_text(F.col("ldmrks_of_interest")).alias("ldmrks_of_interest"),
        micros("end_time").alias("end_time_us"), round6("duration").alias("duration"),
    )


@query("landmark_index_by_part")
def landmark_index_by_part(spark: SparkSession, base: str) -> DataFrame:
    """The landmark index of each body part of interest, per set: its stored map the other way round."""
    w, _an = set_tables(spark, base)
    return w.select("id", F.explode(invert_map("ldmrks_of_interest")).alias("body_part", "landmark")).select(
        "id", "body_part", F.col("landmark").cast("bigint").alias("landmark")
    )


def _trim(spark: SparkSession, base: str) -> DataFrame:
    w, an = set_tables(spark, base)
    return AN.trimmed(an, AN.set_params(w, an))


@query("total_reps")
def total_reps(spark: SparkSession, base: str) -> DataFrame:
    return AN.total_reps(_trim(spark, base))


@query("rep_spans")
def rep_spans(spark: SparkSession, base: str) -> DataFrame:
    s = AN.rep_spans(_trim(spark, base))
    return s.withColumn("duration", round6("duration"))


@query("avg_rep_time")
def avg_rep_time(spark: SparkSession, base: str) -> DataFrame:
    a = AN.avg_rep_time(AN.rep_spans(_trim(spark, base)))
    return a.withColumn("average_time_repetitions", round6("average_time_repetitions"))


@query("issue_histogram")
def issue_histogram(spark: SparkSession, base: str) -> DataFrame:
    return AN.issue_histogram(_trim(spark, base))


@query("issue_frames")
def issue_frames(spark: SparkSession, base: str) -> DataFrame:
    return AN.issue_frames(_trim(spark, base))


@query("worst_reps")
def worst_reps(spark: SparkSession, base: str) -> DataFrame:
    return AN.worst_reps(_trim(spark, base)).withColumn("rank", F.col("rank").cast("bigint"))


@query("angle_names")
def angle_names(spark: SparkSession, base: str) -> DataFrame:
    _w, an = set_tables(spark, base)
    return AN.angle_names(an).select(F.array_join("angle_names", ",").alias("angle_names"))


def _pivot_view(p: DataFrame) -> DataFrame:
    cols = ["workout_id", "frame"]
    for n in AN.all_angle_names():
        cols += [round6(f"{n}_angle").alias(f"{n}_angle"), list_text(F.col(f"{n}_indices")).alias(f"{n}_indices")]
    return p.select(*cols)


@query("angle_pivot_issues")
def angle_pivot_issues(spark: SparkSession, base: str) -> DataFrame:
    return _pivot_view(AN.angle_pivot(_trim(spark, base), issues_only=True))


@query("angle_pivot_all")
def angle_pivot_all(spark: SparkSession, base: str) -> DataFrame:
    return _pivot_view(AN.angle_pivot(_trim(spark, base)))


def _stats_view(s: DataFrame) -> DataFrame:
    return s.select(
        "workout_id", "column", F.col("count").cast("bigint").alias("count"),
        *[round6(c).alias(c) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")],
    )


@query("angle_stats")
def angle_stats(spark: SparkSession, base: str) -> DataFrame:
    return _stats_view(AN.angle_stats(_trim(spark, base)))


@query("landmark_stats")
def landmark_stats(spark: SparkSession, base: str) -> DataFrame:
    w, an = set_tables(spark, base)
    return _stats_view(AN.landmark_stats(raw_table(spark, base), AN.set_params(w, an)))


@query("landmarks_of_interest")
def landmarks_of_interest(spark: SparkSession, base: str) -> DataFrame:
    """Per frame and landmark of interest, SQL-rounded coordinates (long form)."""
    w, an = set_tables(spark, base)
    c = AN.interest_coordinates(raw_table(spark, base), AN.set_params(w, an))
    return c.withColumn("value", round6("value"))
