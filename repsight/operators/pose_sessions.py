"""Pose sessions end to end: frames with landmarks + control messages -> sets.

This is the path for native data (``schemas.FRAMES`` and ``schemas.CONTROLS``).
It differs from ``sessions.segment`` in one respect: a set's facing side is
fixed by the first pose frame of the set, and it selects the landmarks that
every later frame of the set is judged on.  Set boundaries depend on
completions, and completions depend on the side, so the side is resolved
exactly:

1. features, the latch and the per-attempt repetitions are computed for
   both sides (chunked scans, as everywhere);
2. per attempt, a transition over the states {new set (N), left (L),
   right (R)} is built: from N the attempt's first pose frame picks the side;
   the attempt ends in N if it completes with the side it runs on;
3. the per-attempt transitions are composed in log2(attempts) rounds of
   pointer doubling (each round one join of the small attempt table with
   itself shifted by 2^k) to give the state entering every attempt;
4. each frame takes the values of its attempt's side, and the sets are
   closed as in ``sessions.close_sets``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..schemas import POSE
from ..sources.landmarks import pose_is_complete
from . import exercises as X
from .scan import Scan, checkpoint, hysteresis_latches, number_frames, prefix_scan
from .sessions import ORDER, active_frames, close_sets, settings_asof
from .store import number_rows

NEW, LEFT, RIGHT = 0, 1, 2


def native_messages(frames: DataFrame, controls: DataFrame, chunk_shift: int = 16) -> DataFrame:
    """One ordered message stream per session from frame and control tables."""
    c = controls.select(
        "session_id", "seq",
        (F.col("ts") if "ts" in controls.columns else F.lit(None)).cast("timestamp_ntz").alias("ts"),
        "type", "value", F.lit(None).cast(POSE).alias("landmarks"),
    )
    f = frames.select(
        "session_id", "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit("frame").alias("type"),
        F.lit(None).cast("string").alias("value"), F.col("landmarks").cast(POSE).alias("landmarks"),
    )
    return c.unionByName(f).withColumn("chunk", F.shiftright(F.col("seq"), chunk_shift))


def _compose(t: list[Column], inner: list[Column]) -> list[Column]:
    """(t o inner)(x) = t(inner(x)) for the 3-state transitions given as columns."""
    arr = F.array(*t)
    return [F.element_at(arr, (i + 1).cast("int")) for i in inner]


def attempt_sides(frames: DataFrame, starts: DataFrame) -> DataFrame:
    """Side each attempt runs on (``left`` boolean, null before any pose frame).

    ``frames``: active frames with ``left_first``, ``has_pose``, ``done_L``,
    ``done_R``; ``starts``: one row per (session_id, attempt).
    """
    agg = frames.groupBy("session_id", "attempt").agg(
        F.min_by("left_first", F.when(F.col("has_pose"), F.col("seq"))).alias("f_left"),
        F.max(F.col("done_L").cast("int")).alias("d_l"),
        F.max(F.col("done_R").cast("int")).alias("d_r"),
    )
    att = starts.join(agg, ["session_id", "attempt"], "left")
    f = F.when(F.col("f_left").isNull(), F.lit(None)).when(F.col("f_left"), F.lit(LEFT)).otherwise(F.lit(RIGHT))
    d_l = F.coalesce(F.col("d_l"), F.lit(0)) == 1
    d_r = F.coalesce(F.col("d_r"), F.lit(0)) == 1
    from_new = F.when(f.isNull(), F.lit(NEW)).when(
        F.when(f == LEFT, d_l).otherwise(d_r), F.lit(NEW)
    ).otherwise(f)
    p = att.select(
        "session_id", "attempt",
        from_new.alias("t0"),
        F.when(d_l, F.lit(NEW)).otherwise(F.lit(LEFT)).alias("t1"),
        F.when(d_r, F.lit(NEW)).otherwise(F.lit(RIGHT)).alias("t2"),
        f.alias("f"),
    )
    p = checkpoint(p)
    base = p.select("session_id", "attempt", "f")
    top = p.agg(F.max("attempt")).first()[0] or 0
    step = 1
    while step < top:
        prev = p.select(
            "session_id", (F.col("attempt") + step).alias("attempt"),
            F.col("t0").alias("q0"), F.col("t1").alias("q1"), F.col("t2").alias("q2"),
        )
        j = p.join(prev, ["session_id", "attempt"], "left")
        t = [F.col("t0"), F.col("t1"), F.col("t2")]
        inner = [F.coalesce(F.col(f"q{i}"), F.lit(i)) for i in range(3)]
        c = _compose(t, inner)
        p = checkpoint(j.select("session_id", "attempt", c[0].alias("t0"), c[1].alias("t1"), c[2].alias("t2")))
        step *= 2
    # state entering attempt a = (composition up to a - 1) applied to NEW
    entering = p.select("session_id", (F.col("attempt") + 1).alias("attempt"), F.col("t0").alias("state_in"))
    res = base.join(entering, ["session_id", "attempt"], "left").withColumn(
        "state_in", F.coalesce(F.col("state_in"), F.lit(NEW))
    )
    side = F.when(F.col("state_in") == NEW, F.col("f")).otherwise(F.col("state_in"))
    return res.select("session_id", "attempt", F.when(side.isNull(), F.lit(None)).otherwise(side == LEFT).alias("left"))


def pose_segments(messages: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Kept frames of all sets with per-frame analysis columns.

    Output columns: session_id, seq, ts, attempt, epoch, exercise, goal,
    strictness, rule_strictness, has_pose, left_side, series_number, frame,
    down, reps, done, form_ok, form_issues, rep (angle), aux (angle).
    """
    # rule variants are computed map side and the pose is dropped before any
    # exchange; each frame later picks the variant of its as-of settings
    pose = F.col("landmarks")
    narrow = X.pack_variants(X.rule_variants(
        messages.withColumn(
            "has_pose", (F.col("type") == "frame") & pose.isNotNull() & F.coalesce(pose_is_complete(pose), F.lit(False))
        )
    ))
    s = settings_asof(narrow, chunk)
    frames = active_frames(s, F.col("has_pose"))
    frames = frames.where(F.col("exercise").isin(*X.REGISTRY))
    feats = X.select_variant(frames, F.col("exercise"), F.col("rule_strictness"))

    keys = ["session_id", "attempt", "epoch"]
    posed = feats.where("has_pose")
    lags = {f"{p}_{sd}": (f"{f}_{sd}", False) for sd in X.SIDES for p, f in (("pfu", "fu"), ("pfd", "fd"))}
    posed = number_frames(posed, keys, ORDER, chunk, frame_col="__lf", lags=lags, materialize=True,
                          keep_partitioning=True).drop("__lf")
    both = {f"_{sd}": (f"rep_{sd}", f"pfu_{sd}", f"pfd_{sd}") for sd in X.SIDES}
    posed = hysteresis_latches(posed, keys, ORDER, chunk, both, K.DOWN_THRESHOLD, K.UP_THRESHOLD)
    posed = posed.withColumnsRenamed({f"rep_inc_{sd}": f"inc_{sd}" for sd in X.SIDES}).drop(
        *[f"{n}_{sd}" for sd in X.SIDES for n in ("event", "rep_count")]
    )
    unposed = feats.where(~F.col("has_pose")).withColumns(
        {"down_L": F.lit(None).cast("boolean"), "down_R": F.lit(None).cast("boolean"),
         "inc_L": F.lit(False), "inc_R": F.lit(False)}
    )
    allf = posed.unionByName(unposed, allowMissingColumns=True)
    allf = prefix_scan(
        allf, ["session_id", "attempt"], ORDER, chunk,
        [Scan("reps_L", F.col("inc_L").cast("bigint"), "sum"), Scan("reps_R", F.col("inc_R").cast("bigint"), "sum")],
        keep_partitioning=True,
    )
    goal = F.col("goal")
    allf = allf.withColumns(
        {"done_L": (goal > 0) & (F.col("reps_L") >= goal), "done_R": (goal > 0) & (F.col("reps_R") >= goal)}
    )
    starts = s.where((F.col("type") == "start") & (F.col("terminated") == 0)).select("session_id", "attempt")
    # one row per (attempt, chunk), so the frames join on the partitioning they have and a hot attempt stays split
    att = ["session_id", "attempt"]
    sides = checkpoint(allf.select(*att, chunk).distinct().join(attempt_sides(allf, starts), att))
    picked = allf.join(sides, [*att, chunk], "left").withColumnRenamed("left", "left_side")
    lf = F.coalesce(F.col("left_side"), F.lit(False))
    picked = picked.withColumns(
        {
            "down": F.when(lf, F.col("down_L")).otherwise(F.col("down_R")),
            "rep_inc": F.when(lf, F.col("inc_L")).otherwise(F.col("inc_R")),
        }
    )
    picked = X.pick_side(picked.drop("reps_L", "reps_R", "done_L", "done_R", "down_L", "down_R", "inc_L", "inc_R"),
                         "left_side")
    kept = close_sets(picked, chunk)
    down = F.col("down")
    bits = F.when(down, F.col("idn")).otherwise(F.col("iu"))
    return kept.withColumns(
        {
            "form_ok": F.when(F.col("has_pose"), F.when(down, F.col("fd")).otherwise(F.col("fu"))),
            "form_issues": F.when(F.col("has_pose"), X.message(F.col("exercise"), bits, down, F.col("aux"))),
        }
    ).drop("iu", "idn", "fu", "fd", "pfu", "pfd", "left_first")


def set_tables(
    segments: DataFrame, frames: DataFrame | None = None, after: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The three stored tables from ``pose_segments`` (+ native frames for landmarks).

    Only completed sets are stored, numbered ``after + 1 ..`` without gaps in
    the order of (session_id, series_number) (S7); ``after`` is the greatest
    number stored before.  ``timestamp_start`` is the time of the session's first message (carried by
    the settings scan): the session object's creation time in the analysed
    loop, so a set's duration includes earlier sets.
    """
    key = ["session_id", "series_number"]
    stored = segments.groupBy("session_id", "series_number").agg(F.max(F.col("done").cast("int")).alias("stored"))
    stored = number_rows(stored.where("stored = 1").select(key), key, "workout_id", after)
    posed = segments.where("has_pose").join(stored, key)
    wid = F.col("workout_id")
    start_col = "session_start" if "session_start" in segments.columns else "ts"
    session_start = segments.groupBy("session_id").agg(F.min(start_col).alias("timestamp_start"))
    first = F.min_by(F.struct("exercise", "goal", "strictness", "left_side"), F.col("seq"))
    w = posed.groupBy(*key, "workout_id").agg(first.alias("s")).join(session_start, "session_id")
    s = F.col("s")
    workout = w.select(
        wid.alias("id"), s["exercise"].alias("workout_name"), "timestamp_start",
        s["goal"].cast("int").alias("rep_goal"), F.col("series_number").cast("int").alias("series_number"),
        s["strictness"].alias("strictness_crit"), X.deviation_of(s["strictness"]).alias("strictness_definition"),
        s["left_side"].alias("left_side"), X.interest_map(s["exercise"], s["left_side"]).alias("ldmrks_of_interest"),
    )
    analysis = posed.select(
        wid.alias("workout_id"), F.col("frame").cast("int").alias("frame"), F.col("ts").alias("timestamp"),
        F.col("reps").cast("int").alias("rep_count"), "down", "form_issues",
        X.angles_data(F.col("exercise"), F.col("rep"), F.col("aux"), F.col("left_side")).alias("angles_data"),
    )
    raw = None
    if frames is not None:
        from .tables import flatten_landmarks

        keyed = posed.select("session_id", "seq", wid.alias("workout_id"), F.col("frame").cast("int").alias("frame"),
                             F.col("ts").alias("timestamp"))
        j = keyed.join(frames.select("session_id", "seq", "landmarks"), ["session_id", "seq"], "inner")
        raw = flatten_landmarks(j, keep=("frame", "timestamp", "workout_id"))
    return workout, analysis, raw
