"""Overlay geometry of the client, as columns (no pixels are drawn).

Skeleton segments (J8), angle arcs and labels (J9, F16, F17, F8) and the
letterbox fit of a video frame into a square (F18).  The edge list is a fixed
35-element literal (size bound proven), so it is expanded per frame with
``inline`` instead of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import js_to_fixed0


def skeleton_segments(poses: DataFrame, width: float, height: float, keys: tuple[str, ...]) -> DataFrame:
    """One row per drawable edge of each frame: endpoints scaled to the canvas.

    An edge is skipped when either landmark is missing (the client's check).
    """
    edges = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("dst")) for a, b in K.SKELETON_EDGES])
    e = poses.select(*keys, "landmarks", F.inline(edges))
    p1 = F.get(F.col("landmarks"), F.col("src"))
    p2 = F.get(F.col("landmarks"), F.col("dst"))
    return e.where(p1.isNotNull() & p2.isNotNull()).select(
        *keys, "src", "dst",
        (p1["x"] * width).alias("x1"), (p1["y"] * height).alias("y1"),
        (p2["x"] * width).alias("x2"), (p2["y"] * height).alias("y2"),
    )


def angle_arcs(landmarks: Column, angles: Column, width: float, height: float) -> Column:
    """Arcs and labels of the displayed angles, as an array that replaces the pose.

    Bearings of both limbs from the joint, ``atan2(dy, dx)`` in canvas
    coordinates, and the label ``name: N°`` with ``toFixed(0)`` rounding.
    Angles whose three points are not all present are skipped.
    """

    def points(a: Column) -> list[Column]:
        return [F.get(landmarks, F.get(a["joint_indices"], i)) for i in range(3)]

    def present(a: Column) -> Column:
        p1, p2, p3 = points(a)
        return p1.isNotNull() & p2.isNotNull() & p3.isNotNull()

    def arc(a: Column) -> Column:
        (x1, y1), (x2, y2), (x3, y3) = [(p["x"] * width, p["y"] * height) for p in points(a)]
        return F.struct(
            a["name"].alias("name"), x2.alias("cx"), y2.alias("cy"),
            F.atan2(y1 - y2, x1 - x2).alias("start_rad"), F.atan2(y3 - y2, x3 - x2).alias("end_rad"),
            F.concat(a["name"], F.lit(": "), js_to_fixed0(a["value"]).cast("string"), F.lit("°")).alias("label"),
        )

    return F.transform(F.filter(angles, present), arc)


def angle_overlay(angles: DataFrame, width: float, height: float, keys: tuple[str, ...]) -> DataFrame:
    """One row per arc of each frame (``angles_data`` + ``landmarks``), see ``angle_arcs``."""
    return angles.select(*keys, F.inline(angle_arcs(F.col("landmarks"), F.col("angles_data"), width, height)))


def letterbox(df: DataFrame, width: str, height: str, target: int = K.LETTERBOX_TARGET) -> DataFrame:
    """Fit ``width x height`` into a ``target`` square keeping the aspect ratio.

    Adds ``new_w, new_h, x_off, y_off`` (integer pixels, floor as the client).
    """
    w, h = F.col(width), F.col(height)
    tall = h > w
    new_w = F.when(tall, F.floor(w * (F.lit(target) / h))).otherwise(F.lit(target)).cast("bigint")
    new_h = F.when(tall, F.lit(target)).otherwise(F.floor(h * (F.lit(target) / w))).cast("bigint")
    return df.withColumns(
        {
            "new_w": new_w,
            "new_h": new_h,
            "x_off": F.when(tall, F.floor((F.lit(target) - new_w) / 2)).otherwise(F.lit(0)).cast("bigint"),
            "y_off": F.when(tall, F.lit(0)).otherwise(F.floor((F.lit(target) - new_h) / 2)).cast("bigint"),
        }
    )
