"""Registered queries on poses: angles, side, strictness, flatten, JSON, overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .. import constants as K
from ..functions.numeric import round6
from ..operators import exercises as X
from ..operators import geometry as G
from ..operators.reps import pose_frame_state, pose_level_states
from ..operators.scan import number_frames
from ..operators.tables import flatten_landmarks
from ..schemas import ANGLE
from ..sources import adapters as A
from ..sources.landmarks import landmark_dimension as dim_table
from .registry import query

CANVAS_W, CANVAS_H = 640.0, 480.0

# (output name, joints) of the angles reported per side by ``joint_angles``.
JOINT_ANGLE_SPECS = [
    ("elbow", ("wrist", "elbow", "shoulder")),
    ("knee", ("ankle", "knee", "hip")),
    ("hip", ("shoulder", "hip", "knee")),
]


def embedding_frames(spark: SparkSession, base: str, *derived: Column) -> DataFrame:
    """Numbered frames of embedding poses; ``derived`` columns are computed map side and replace the
    pose before the exchange of the numbering."""
    poses = A.embedding_poses(spark, base)
    if derived:
        poses = poses.select("workout_id", "chunk", *A.EMBEDDING_ORDER, *derived)
    return number_frames(poses, ["workout_id"], A.EMBEDDING_ORDER, "chunk")


@query("joint_angles")
def joint_angles(spark: SparkSession, base: str) -> DataFrame:
    """Six joint angles per frame (both sides) from embedding poses."""
    pose = F.col("landmarks")
    cols = {}
    for side, label in (("L", "left"), ("R", "right")):
        for name, joints in JOINT_ANGLE_SPECS:
            ix = [X.part_index(p, side) for p in joints]
            cols[f"{label}_{name}"] = X.point_angle(pose, *ix)
    f = embedding_frames(spark, base, *[c.alias(n) for n, c in cols.items()])
    return f.select("workout_id", "frame", *[round6(n).alias(n) for n in cols])


@query("side_detection")
def side_detection(spark: SparkSession, base: str) -> DataFrame:
    """Facing side per set from its first frame (W5): partial ``min_by``, no window."""
    p = A.pushup_poses(spark, base)
    return p.groupBy("workout_id").agg(
        F.min_by(X.side_flag(F.col("landmarks")), F.struct(*A.EVENT_ORDER)).alias("left_side")
    )


@query("strictness_sweep")
def strictness_sweep(spark: SparkSession, base: str) -> DataFrame:
    """Frames, good frames and repetitions per exercise and strictness level.

    The levels of an exercise are judged in one pass over its poses.
    """
    levels = list(K.STRICTNESS_DEGREES)
    parts = []
    for ex, poses in (("push-ups", A.pushup_poses), ("squats", A.squat_poses)):
        st = pose_level_states(poses(spark, base), ["workout_id"], A.EVENT_ORDER, ex, levels)
        per_set = st.groupBy("workout_id").agg(
            F.count(F.lit(1)).alias("frames"),
            *[F.count(F.when(F.col(f"form_ok_{lv}"), 1)).alias(f"good_{lv}") for lv in levels],
            *[F.max(f"rep_count_{lv}").alias(f"reps_{lv}") for lv in levels],
        )
        totals = per_set.agg(
            F.sum("frames").alias("frames"),
            *[F.sum(f"good_{lv}").alias(f"good_{lv}") for lv in levels],
            *[F.sum(f"reps_{lv}").cast("bigint").alias(f"reps_{lv}") for lv in levels],
        )
        rows = F.array(*[
            F.struct(F.lit(ex).alias("exercise"), F.lit(lv).alias("strictness"), F.col("frames").alias("frames"),
                     F.col(f"good_{lv}").alias("good_frames"), F.col(f"reps_{lv}").alias("reps"))
            for lv in levels
        ])
        parts.append(totals.select(F.inline(rows)))
    return parts[0].unionByName(parts[1])


@query("landmarks_wide")
def landmarks_wide(spark: SparkSession, base: str) -> DataFrame:
    """66-column landmark rows (P8, P12), columnar, no UDF."""
    f = embedding_frames(spark, base)
    return flatten_landmarks(f, keep=("workout_id", "frame"))


@query("angles_json_roundtrip")
def angles_json_roundtrip(spark: SparkSession, base: str) -> DataFrame:
    """``angles_data`` to JSON text and back to the nested type, then unnested."""
    st = pose_frame_state(A.pushup_poses(spark, base), ["workout_id"], A.EVENT_ORDER, "push-ups", "loose")
    nested = st.select(
        "workout_id", "frame",
        F.to_json(X.angles_data(F.col("exercise"), F.col("rep"), F.col("aux"), F.col("left_side"))).alias("angles_json"),
    )
    back = nested.select(
        "workout_id", "frame", F.inline(F.from_json("angles_json", ArrayType(ANGLE)))
    )
    return back.select(
        "workout_id", "frame", "name", round6("value").alias("value"),
        F.array_join(F.col("joint_indices").cast("array<string>"), ",").alias("joint_indices"),
    )


@query("landmark_dimension")
def landmark_dimension(spark: SparkSession, base: str) -> DataFrame:
    """Per landmark of the dimension: frames with it and mean position.

    The 33-row dimension is broadcast (fixed size); the per-landmark means are
    partial aggregates.
    """
    f = A.embedding_poses(spark, base)
    lm = f.select(F.posexplode("landmarks").alias("index", "lm"))
    agg = lm.groupBy("index").agg(
        F.count(F.lit(1)).alias("frames"), F.avg(F.col("lm")["x"]).alias("mean_x"), F.avg(F.col("lm")["y"]).alias("mean_y")
    )
    d = F.broadcast(dim_table(spark))
    return agg.join(d, "index", "inner").select(
        F.col("index").cast("bigint").alias("index"), "side", "name", "frames",
        round6("mean_x").alias("mean_x"), round6("mean_y").alias("mean_y"),
    )


@query("skeleton_segments")
def skeleton_segments(spark: SparkSession, base: str) -> DataFrame:
    """Drawable edges per frame (J8).  33 points of x and y cross the exchange: the 35 edges take twice that."""
    points = F.transform("landmarks", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    f = embedding_frames(spark, base, points.alias("landmarks"))
    s = G.skeleton_segments(f, CANVAS_W, CANVAS_H, ("workout_id", "frame"))
    return s.select(
        "workout_id", "frame", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"),
        *[round6(c).alias(c) for c in ("x1", "y1", "x2", "y2")],
    )


@query("overlay_angles")
def overlay_angles(spark: SparkSession, base: str) -> DataFrame:
    """Arc bearings and labels of the push-up display angles on embedding poses."""
    pose = F.col("landmarks")
    left = X.side_flag(pose)
    feats = {}
    for feat in ("rep", "aux"):
        l_ix = [X.part_index(p, "L") for p in X.COMPUTE_TRIPLES["push-ups"][feat]]
        r_ix = [X.part_index(p, "R") for p in X.COMPUTE_TRIPLES["push-ups"][feat]]
        feats[feat] = F.when(left, X.point_angle(pose, *l_ix)).otherwise(X.point_angle(pose, *r_ix))
    angles = X.angles_data(F.lit("push-ups"), feats["rep"], feats["aux"], left)
    f = embedding_frames(spark, base, G.angle_arcs(pose, angles, CANVAS_W, CANVAS_H).alias("arcs"))
    return f.select("workout_id", "frame", F.inline("arcs")).select(
        "workout_id", "frame", "name", *[round6(c).alias(c) for c in ("cx", "cy", "start_rad", "end_rad")], "label"
    )


@query("letterbox")
def letterbox(spark: SparkSession, base: str) -> DataFrame:
    """Letterbox geometry (F18) for a frame size derived from each embedding row."""
    em = A.read_table(spark, base, "embeddings", ["vec_id", "label"])
    sized = em.select(
        "vec_id",
        (F.lit(320) + (F.col("vec_id") % 7) * 160).alias("width"),
        (F.lit(240) + (F.col("label") % 5) * 120).alias("height"),
    )
    return G.letterbox(sized, "width", "height").select(
        "vec_id", F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"),
        "new_w", "new_h", "x_off", "y_off",
    )
