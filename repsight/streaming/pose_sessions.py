"""Incremental pose sessions (T1-T4 on native frames + controls).

1. stateless: the form rules are evaluated by Spark expressions for every
   (exercise, strictness, side) combination (``exercises.add_rules``), each
   combination's flags are packed into one number, and the 33-point array is
   dropped;
2. stateful (``applyInPandasWithState`` keyed by session): settings as of
   each message, then attempt by attempt the set's side (from the first pose
   frame of the set, kept until its completion), the latch per
   (attempt, epoch) on the selected rules, repetitions, completion and
   frame numbering;
3. stateless: message texts and angle records from the selected values.

Step 2 is one pass over plain lists: a session has a few messages in a
micro-batch, where the calls of a vectorised form cost far more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from .. import constants as K
from ..operators import exercises as X
from ..sources.landmarks import pose_is_complete
from .frames import with_state
from .sessions import Settings, frame_of, gathered, ordered, until_unknown

def feature_columns(messages: DataFrame) -> DataFrame:
    """Stateless step: every rule variant as a column; the pose array is dropped."""
    pose = F.col("landmarks")
    out = messages.withColumn(
        "has_pose", (F.col("type") == "frame") & pose.isNotNull() & F.coalesce(pose_is_complete(pose), F.lit(False))
    )
    return X.rule_variants(out)


STATE_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("attempt", T.LongType()), ("epoch", T.LongType()), ("exercise", T.StringType()), ("goal", T.LongType()),
        ("strictness", T.StringType()), ("rule_strictness", T.StringType()),
        ("latch_attempt", T.LongType()), ("latch_epoch", T.LongType()),
        ("down", T.BooleanType()), ("pfu", T.BooleanType()), ("pfd", T.BooleanType()),
        ("reps", T.LongType()), ("attempt_done", T.BooleanType()), ("side", T.StringType()),
        ("set_no", T.LongType()), ("set_frames", T.LongType()), ("session_start", T.TimestampNTZType()),
    ]]
)

OUTPUT_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in [
        ("session_id", T.LongType()), ("seq", T.LongType()), ("series_number", T.LongType()), ("frame", T.LongType()),
        ("left_side", T.BooleanType()), ("down", T.BooleanType()), ("reps", T.LongType()), ("done", T.BooleanType()),
        ("form_ok", T.BooleanType()), ("bits", T.IntegerType()), ("exercise", T.StringType()),
        ("rep", T.DoubleType()), ("aux", T.DoubleType()), ("has_pose", T.BooleanType()), ("goal", T.LongType()),
        ("strictness", T.StringType()), ("ts", T.TimestampNTZType()), ("session_start", T.TimestampNTZType()),
    ]]
)

INITIAL = (0, 0, K.INITIAL_EXERCISE, K.INITIAL_GOAL, K.INITIAL_STRICTNESS, K.INITIAL_STRICTNESS,
           -1, -1, False, False, False, 0, False, None, 0, 0, None)


def packed_rules(features: DataFrame) -> DataFrame:
    """What the state function reads, with the rule variants packed: each column costs time for every session of a micro-batch."""
    return X.pack_variants(features).select("session_id", "seq", "ts", "type", "value", "has_pose", "left_first", "angles", "rules")


def advance_pose_session(pdf: pd.DataFrame, st: tuple, tags: dict[str, str]) -> tuple[pd.DataFrame, tuple]:
    """(kept frames, next state) from the ordered messages with ``packed_rules``: one pass over settings, one over frames."""
    now = Settings(*st[:6])
    latch, (down, pfu, pfd, reps, finished, side, set_no, set_frames, start) = (st[6], st[7]), st[8:]
    pdf = ordered(pdf)
    counted = now.attempt  # the attempt that reps and finished belong to
    session = int(pdf["session_id"].to_numpy()[:1].astype("int64")[0])  # a null id has the least number
    start = pdf["ts"].iloc[0] if start is None else start
    at: dict[int, list[tuple]] = {}  # active frames by attempt, with their settings
    for i, (kind, value) in enumerate(zip(pdf["type"].tolist(), pdf["value"].tolist())):
        if kind != "frame":
            now.apply(kind, value)
        elif now.attempt > 0 and now.exercise in tags:
            at.setdefault(now.attempt, []).append((i, now.epoch, now.exercise, now.goal, now.strictness, now.rule))
    posed, seqs, angles, rules = (pdf[c].tolist() for c in ("has_pose", "seq", "angles", "rules"))
    rows, places = [], []
    for attempt, frames in at.items():
        if counted != attempt:
            counted, reps, finished = attempt, 0, False
        if finished:
            continue  # the attempt already completed: the rest is inactive
        if side is None:
            first = next((f[0] for f in frames if posed[f[0]]), None)
            side = None if first is None else "L" if pdf["left_first"].iloc[first] else "R"
        left = side == "L"
        aux_at, rep_at, rule_at = X.variant_places(list(tags), side or "R")
        for i, epoch, exercise, goal, strictness, level in frames:
            if latch != (attempt, epoch):
                latch, down, pfu, pfd = (attempt, epoch), False, False, False
            has_pose, angle, which = bool(posed[i]), angles[i][rep_at[exercise]], rule_at.get((exercise, level))
            rule = 0 if which is None else int(rules[i][which])
            fu, fd = bool(rule & 1), bool(rule & 2)
            if has_pose:  # a frame without a pose leaves the latch as it is
                if angle is not None and angle <= K.DOWN_THRESHOLD and pfu:
                    down = True
                elif angle is not None and angle >= K.UP_THRESHOLD and pfd:
                    reps += down
                    down = False
                pfu, pfd = fu, fd
            finished = goal > 0 and reps >= goal
            places.append(i)
            rows.append((
                session, seqs[i], set_no + 1, set_frames if has_pose else -1, left, down, reps, finished,
                fd if down else fu, rule >> 33 if down else rule >> 2 & X.ISSUES, exercise, angle, angles[i][aux_at],
                has_pose, goal, strictness,
            ))
            set_frames += has_pose
            if finished:
                set_no, set_frames, side = set_no + 1, 0, None
                break
    if latch != (now.attempt, now.epoch):
        down = pfu = pfd = False
    if counted != now.attempt:
        reps, finished = 0, False
    new = (*now.values(), now.attempt, now.epoch, down, pfu, pfd, int(reps), finished, side, set_no, set_frames,
           None if pd.isna(start) else pd.Timestamp(start).to_pydatetime())
    times = pdf["ts"].to_numpy()[np.array(places, dtype="int64")]
    began = np.full(len(rows), np.datetime64("NaT") if pd.isna(start) else np.datetime64(start), dtype="datetime64[ns]")
    return frame_of(rows, OUTPUT_SCHEMA, ts=times, session_start=began), new


def _fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState, tags: dict[str, str]) -> Iterator[pd.DataFrame]:
    st = state.get if state.exists else INITIAL
    pdf = until_unknown(ordered(gathered(pdfs)), st[2], tuple(tags))
    if not len(pdf):
        return
    out, new = advance_pose_session(pdf, st, tags)
    state.update(new)
    if len(out):
        yield out


def pose_session_stream(messages: DataFrame, idle: float | None = None) -> DataFrame:
    """Streaming pose sessions from ``session_id, seq, type, value, landmarks`` messages, with ``ts`` where they have one;
    ``idle``: see ``with_state``."""
    ts = (F.col("ts") if "ts" in messages.columns else F.lit(None)).cast("timestamp_ntz").alias("ts")
    tags = dict(X.TAGS)  # as registered where the query is made, also for the workers
    feats = packed_rules(feature_columns(messages.select("session_id", "seq", ts, "type", "value", "landmarks")))

    def fn(key, pdfs, state):
        return _fn(key, pdfs, state, tags)

    processed = with_state(feats.groupBy("session_id"), fn, OUTPUT_SCHEMA, STATE_SCHEMA, idle)
    bits, down = F.col("bits"), F.col("down")
    return processed.withColumns(
        {
            "frame": F.when(F.col("has_pose"), F.col("frame")),
            "form_ok": F.when(F.col("has_pose"), F.col("form_ok")),
            "form_issues": F.when(F.col("has_pose"), X.message(F.col("exercise"), bits, down, F.col("aux"))),
        }
    )
