"""Per-frame state of a set: frame number, latch, repetitions and form.

Three entry points:

``signal_frame_state``  an angle signal whose form flag is given per frame;
``pose_frame_state``    33-point poses -> angles -> form rules -> latch;
``pose_level_states``   the same under several strictness levels at once.

All are one exchange on ``(key, chunk)`` followed by chunked scans
(``operators.scan``); no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import exercises as X
from .scan import hysteresis_latch, hysteresis_latches, number_frames


def signal_frame_state(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: str = "chunk",
    angle: str = "angle",
    form: str = "form",
) -> DataFrame:
    """Frame number, event, down, rep, rep_count for a given (angle, form) signal."""
    numbered = number_frames(df, keys, order, chunk, lags={"prev_form": (form, False)})
    return hysteresis_latch(
        numbered, keys, order, chunk, angle, "prev_form", "prev_form", K.DOWN_THRESHOLD, K.UP_THRESHOLD
    )


def pose_frame_state(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    exercise: Column | str,
    strictness: Column | str,
    chunk: str = "chunk",
    pose_col: str = "landmarks",
    keep_pose: bool = False,
) -> DataFrame:
    """Full per-frame analysis of pose frames.

    ``exercise``/``strictness`` are literals or per-row columns.  Adds
    ``frame``, ``left_side``, ``rep`` (latch angle), ``aux`` (second angle),
    ``down``, ``rep_count``, ``form_ok`` and ``form_issues``.
    """
    ex = F.lit(exercise) if isinstance(exercise, str) else exercise
    st = F.lit(strictness) if isinstance(strictness, str) else strictness
    feats = X.with_features(df.withColumn("exercise", ex), F.col("exercise"), X.deviation_of(st), pose_col)
    if not keep_pose:
        feats = feats.drop(pose_col)
    lags = {}
    for side in X.SIDES:
        lags[f"pfu_{side}"] = (f"fu_{side}", False)
        lags[f"pfd_{side}"] = (f"fd_{side}", False)
    # the features are checkpointed before window and summary read them: they prune their
    # input differently, so over a plain exchange the map side would run for each
    numbered = number_frames(feats, keys, order, chunk, lags=lags, firsts={"left_side": "left_first"},
                             materialize=True, keep_partitioning=True)
    picked = X.pick_side(numbered.drop("left_first"), "left_side")
    latched = hysteresis_latch(
        picked, keys, order, chunk, "rep", "pfu", "pfd", K.DOWN_THRESHOLD, K.UP_THRESHOLD
    )
    down = F.col("down")
    bits = F.when(down, F.col("idn")).otherwise(F.col("iu"))
    return latched.withColumns(
        {
            "form_ok": F.when(down, F.col("fd")).otherwise(F.col("fu")),
            "form_issues": X.message(F.col("exercise"), bits, down, F.col("aux")),
        }
    ).drop("iu", "idn", "pfu", "pfd", "event")


def pose_level_states(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    exercise: str,
    levels: Sequence[str],
    chunk: str = "chunk",
    pose_col: str = "landmarks",
) -> DataFrame:
    """``pose_frame_state`` of the same frames under each of the strictness ``levels``.

    Poses, angles and numbering are those of one pass, the levels' latches
    share one sort and checkpoint.  Adds ``frame``, ``left_side``, ``rep``,
    ``aux`` and, for each level, ``down_{level}``, ``rep_count_{level}``,
    ``form_ok_{level}`` and ``form_issues_{level}``.
    """
    ex = F.col("exercise")
    feats = X.add_primitives(df.withColumn("exercise", F.lit(exercise)), ex, pose_col).drop(pose_col)
    for level in levels:
        feats = X.add_rules(feats, ex, X.deviation_of(F.lit(level)), suffix=f"_{level}")
    sided = [(side, level) for side in X.SIDES for level in levels]
    flags = {f"r_{level}_{side}": X.pack_flags([f"{f}_{side}_{level}" for f in X.FLAGS]) for side, level in sided}
    feats = X.drop_primitives(feats.withColumns(flags)).drop(
        *[f"{f}_{side}_{level}" for side, level in sided for f in X.FLAGS]
    )
    numbered = number_frames(
        feats, keys, order, chunk, lags={f"p{r}": (r, 0) for r in flags}, firsts={"left_side": "left_first"},
        materialize=True, keep_partitioning=True,
    )
    names = ["rep", "aux", *[f"{p}r_{level}" for level in levels for p in ("", "p")]]
    picked = numbered.withColumns(
        {n: F.when(F.col("left_side"), F.col(f"{n}_L")).otherwise(F.col(f"{n}_R")) for n in names}
    ).drop("left_first", *[f"{n}_{side}" for n in names for side in X.SIDES])
    was = {f"p{f}_{level}": X.unpack_flags(F.col(f"pr_{level}"))[f] for level in levels for f in ("fu", "fd")}
    picked = picked.withColumns(was).drop(*[f"pr_{level}" for level in levels])
    latched = hysteresis_latches(
        picked, keys, order, chunk, {f"_{lv}": ("rep", f"pfu_{lv}", f"pfd_{lv}") for lv in levels},
        K.DOWN_THRESHOLD, K.UP_THRESHOLD,
    )
    cols = {}
    for level in levels:
        down, own = F.col(f"down_{level}"), X.unpack_flags(F.col(f"r_{level}"))
        cols[f"form_ok_{level}"] = F.when(down, own["fd"]).otherwise(own["fu"])
        bits = F.when(down, own["idn"]).otherwise(own["iu"])
        cols[f"form_issues_{level}"] = X.message(ex, bits, down, F.col("aux"))
    return latched.withColumns(cols).drop(*[f"{n}_{level}" for level in levels for n in ("r", "pfu", "pfd", "event", "rep_inc")])
