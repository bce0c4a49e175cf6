"""The three stored tables of a set, their writers and the wide flatten.

``workout``           one row a set (metadata, side, landmarks of interest)
``workout_analysis``  one row a frame, nested ``angles_data``
``raw_landmarks``     one row a frame, 66 coordinate columns

Writers append by column name; a set's three tables are saved as one (see
``save_sets`` and ``operators.store``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..schemas import RAW_LANDMARKS, WORKOUT, WORKOUT_ANALYSIS
from . import exercises as X
from .store import SetStore


def analysis_rows(state: DataFrame, ts_col: str = "ts") -> DataFrame:
    """``workout_analysis`` rows from a pose frame state (``pose_frame_state``)."""
    return state.select(
        F.col("workout_id").cast("bigint").alias("workout_id"),
        F.col("frame").cast("int").alias("frame"),
        F.col(ts_col).alias("timestamp"),
        F.col("rep_count").cast("int").alias("rep_count"),
        F.col("down"),
        F.col("form_issues"),
        X.angles_data(F.col("exercise"), F.col("rep"), F.col("aux"), F.col("left_side")).alias("angles_data"),
    )


def workout_rows(
    state: DataFrame,
    rep_goal: str = "rep_goal",
    strictness: str = "strictness",
    series_number: str | None = None,
    start_col: str = "ts",
) -> DataFrame:
    """``workout`` rows: settings at the set's first frame (partial aggregate, no window).

    ``timestamp_start`` is the first frame's time of the set.
    """
    first = F.min_by(
        F.struct(
            F.col("exercise"),
            F.col(rep_goal).cast("int").alias("rep_goal"),
            (F.col(series_number).cast("int") if series_number else F.lit(1)).alias("series_number"),
            F.lower(F.col(strictness)).alias("strictness"),
            F.col("left_side"),
        ),
        F.col("frame"),
    )
    agg = state.groupBy("workout_id").agg(first.alias("s"), F.min(start_col).alias("timestamp_start"))
    s = F.col("s")
    return agg.select(
        F.col("workout_id").cast("bigint").alias("id"),
        s["exercise"].alias("workout_name"),
        "timestamp_start",
        s["rep_goal"].alias("rep_goal"),
        s["series_number"].alias("series_number"),
        s["strictness"].alias("strictness_crit"),
        X.deviation_of(s["strictness"]).alias("strictness_definition"),
        s["left_side"].alias("left_side"),
        X.interest_map(s["exercise"], s["left_side"]).alias("ldmrks_of_interest"),
    )


def flatten_landmarks(df: DataFrame, pose_col: str = "landmarks", keep: tuple[str, ...] = ()) -> DataFrame:
    """66 columns ``landmark_{i}_x``/``_y`` from the pose array (columnar, no UDF).

    A missing landmark gives nulls (null-safe ``get``).
    """
    pose = F.col(pose_col)
    cols = []
    for i in range(K.N_LANDMARKS):
        p = F.get(pose, i)
        cols += [p["x"].alias(f"landmark_{i}_x"), p["y"].alias(f"landmark_{i}_y")]
    return df.select(*keep, *cols)


def raw_landmark_rows(numbered_poses: DataFrame, ts_col: str = "ts") -> DataFrame:
    flat = flatten_landmarks(
        numbered_poses.withColumns(
            {
                "frame": F.col("frame").cast("int"),
                "timestamp": F.col(ts_col),
                "workout_id": F.col("workout_id").cast("bigint"),
            }
        ),
        keep=("frame", "timestamp", "workout_id"),
    )
    return flat


def conform(df: DataFrame, schema) -> DataFrame:
    """Select by column name in the table's order with the table's types (append BY NAME)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_table(df: DataFrame, path: str, schema=None, range_keys: tuple[str, ...] = ()) -> None:
    """Append ``df`` as parquet by column name.

    ``range_keys``: range-partition the write so files cluster by key; range
    bounds come from a sample, so a hot key is split over several files.
    """
    out = conform(df, schema) if schema is not None else df
    if range_keys:
        n = out.sparkSession.conf.get("spark.sql.shuffle.partitions")
        out = out.repartitionByRange(int(n), *range_keys).sortWithinPartitions(*range_keys)
    out.write.mode("append").parquet(path)


SET_TABLES = {
    "workout": (WORKOUT, ("id",)),
    "workout_analysis": (WORKOUT_ANALYSIS, ("workout_id", "frame")),
    "raw_landmarks": (RAW_LANDMARKS, ("workout_id", "frame")),
}


def set_store(spark: SparkSession, base_path: str) -> SetStore:
    return SetStore(spark, base_path, SET_TABLES)


def save_sets(workout: DataFrame, analysis: DataFrame, raw: DataFrame, base_path: str, batch: str = "0") -> bool:
    """Store the three tables of completed sets as one: in all of them or in none.

    ``batch`` names the save; saving it again changes nothing and gives False.
    """
    last = workout.agg(F.max("id")).first()[0]
    tables = {"workout": workout, "workout_analysis": analysis, "raw_landmarks": raw}
    return set_store(workout.sparkSession, base_path).save(batch, tables, last)


def read_sets(spark: SparkSession, base_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Open stored tables (S11): ``workout``, ``workout_analysis``, ``raw_landmarks``."""
    store = set_store(spark, base_path)
    return store.read("workout"), store.read("workout_analysis"), store.read("raw_landmarks")
