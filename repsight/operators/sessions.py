"""Sessions: control messages and frames in one ordered stream -> sets.

Input: one row per message of a session, ordered by ``seq``:
``session_id, seq, chunk, type, value`` and, for ``type = 'frame'``, the
frame's signal (``angle`` plus form flags, or features from poses).
Control types: ``workout``, ``reps``, ``strictness``, ``start``.

All steps are chunked prefix scans (``operators.scan``), keyed by
``(session)``, ``(session, attempt)``, ``(session, attempt, epoch)`` or
``(session, set_no)``; chunks keep each window task bounded.

    attempt  = running count of ``start``            epoch = running count of ``workout``
    exercise, goal, strictness = value of the last message of that type (as of)
    rule strictness = strictness as of the last ``workout`` message
    active   = frame with attempt > 0
    latch    over pose frames of (session, attempt, epoch)
    reps     = running sum of repetitions in (session, attempt)
    done     = goal > 0 and reps >= goal   (tested on every active frame)
    keep     = no ``done`` earlier in (session, attempt)
    set_no   = count of ``done`` among earlier kept rows of the session
    frame    = running count of kept pose frames in (session, set_no) - 1
    stored   = sets that contain a ``done`` row

A ``start`` also restarts the latch (the client always follows it with a
``workout`` message); with that convention the result equals the sequential
session loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .exercises import REGISTRY
from .scan import Scan, hysteresis_latch, number_frames, prefix_scan

ORDER = ["seq"]


def control_value(type_: str, default: str | None) -> Column:
    """Value of a control message of ``type_`` (missing value -> default), else null."""
    v = F.col("value")
    if default is not None:
        v = F.coalesce(v, F.lit(default))
    return F.when(F.col("type") == type_, v)


def settings_asof(
    messages: DataFrame, chunk: str = "chunk", forms: tuple[str, str] | None = None, has_pose: Column | None = None
) -> DataFrame:
    """As-of settings for every message row.

    ``forms`` (form if up, form if down): also ``lag_fu`` and ``lag_fd``, those of the last
    frame with a pose since the latch was last set up (by ``start`` or ``workout``), false before any.
    """
    is_type = lambda t: (F.col("type") == t).cast("bigint")
    goal_val = F.trim(control_value("reps", K.CONTROL_DEFAULTS["reps"])).try_cast("int")
    no_form = F.struct(F.lit(False).alias("up"), F.lit(False).alias("down"))
    lag = [] if forms is None else [
        # rows without a chunk have no place in the order and belong to no set
        Scan("lag", F.when(F.col("type").isin("start", "workout") | F.col(chunk).isNull(), no_form).when(
            (F.col("type") == "frame") & (has_pose if has_pose is not None else F.lit(True)),
            F.struct(*[F.coalesce(F.col(f), F.lit(False)).alias(n) for f, n in zip(forms, ("up", "down"), strict=True)]),
        ), "last", inclusive=False)
    ]
    out = prefix_scan(
        messages,
        ["session_id"],
        ORDER,
        chunk,
        [
            *lag,
            Scan("attempt", is_type("start"), "sum"),
            Scan("epoch", is_type("workout"), "sum"),
            Scan("exercise", control_value("workout", K.CONTROL_DEFAULTS["workout"]), "last",
                 default=K.INITIAL_EXERCISE),
            Scan("goal", goal_val, "last", default=K.INITIAL_GOAL),
            Scan("strictness", F.lower(control_value("strictness", K.CONTROL_DEFAULTS["strictness"])), "last",
                 default=K.INITIAL_STRICTNESS),
            # time of the session's first message (the session object's creation)
            *([Scan("session_start", F.col("ts"), "first")] if "ts" in messages.columns else []),
            # an unknown exercise ends the session (its later messages are not processed)
            Scan("terminated", F.when(
                (F.col("type") == "workout")
                & ~control_value("workout", K.CONTROL_DEFAULTS["workout"]).isin(*REGISTRY), 1
            ).otherwise(0).cast("bigint"), "sum"),
            # rules keep the strictness that was current when the exercise object was made
            Scan("rule_strictness", F.col("type") == "workout", "held", default=K.INITIAL_STRICTNESS, of="strictness"),
        ],
        keep_partitioning=True,
    )
    if forms is None:
        return out
    return out.withColumns(
        {f"lag_f{n[0]}": F.coalesce(F.col("lag")[n], F.lit(False)) for n in ("up", "down")}
    ).drop("lag")


def segment(
    messages: DataFrame,
    chunk: str = "chunk",
    angle: str = "angle",
    form_up: str = "form",
    form_down: str | None = None,
    has_pose: Column | None = None,
) -> DataFrame:
    """Frame rows of all sets of all sessions, with their set number.

    ``form_up``/``form_down``: the frame's form if the latch is up/down after
    it (equal when the form does not depend on the latch).  ``has_pose``
    marks frames with a pose (default: all frames); frames without a pose are
    active (they can complete a set) but are neither numbered nor latched.
    Returns frames with attempt > 0 that precede or are the completion of
    their attempt: ``session_id, seq, attempt, epoch, exercise, goal,
    strictness, rule_strictness, has_pose, down, rep_inc, reps, done, set_no,
    series_number, frame, form_ok``.
    """
    settings = settings_asof(messages, chunk, (form_up, form_down or form_up), has_pose)
    return segment_settings(settings, chunk, angle, form_up, form_down, has_pose)


def segment_settings(
    settings: DataFrame,
    chunk: str = "chunk",
    angle: str = "angle",
    form_up: str = "form",
    form_down: str | None = None,
    has_pose: Column | None = None,
) -> DataFrame:
    """``segment`` on messages that already carry their settings and earlier forms (``settings_asof`` with ``forms``)."""
    form_down = form_down or form_up
    frames = active_frames(settings, has_pose).drop("type", "value", "terminated")

    # attempts and epochs follow each other in a session: all scans stay on (session, chunk)
    posed = hysteresis_latch(
        frames.where("has_pose"), ["session_id"], ORDER, chunk, angle, "lag_fu", "lag_fd", K.DOWN_THRESHOLD, K.UP_THRESHOLD,
        within=["attempt", "epoch"],
    ).drop("lag_fu", "lag_fd", "event", "rep_count")
    unposed = frames.drop("lag_fu", "lag_fd").where(~F.col("has_pose")).withColumns(
        {"down": F.lit(None).cast("boolean"), "rep_inc": F.lit(False)}
    )
    kept = close_sets(posed.unionByName(unposed), chunk, ["session_id"], ["attempt"])
    form_ok = F.when(F.col("down"), F.col(form_down)).otherwise(F.col(form_up))
    return kept.withColumn("form_ok", F.when(F.col("has_pose"), form_ok))


def active_frames(settings: DataFrame, has_pose: Column | None = None) -> DataFrame:
    """Frames after a ``start`` of a live session, with a pose flag."""
    pose_flag = has_pose if has_pose is not None else F.lit(True)
    return settings.where(
        (F.col("type") == "frame") & (F.col("attempt") > 0) & (F.col("terminated") == 0)
    ).withColumn("has_pose", pose_flag)


def close_sets(
    frames: DataFrame, chunk: str = "chunk", keys: Sequence[str] = ("session_id", "attempt"), within: Sequence[str] = ()
) -> DataFrame:
    """From active frames with ``rep_inc`` to kept frames with set numbers.

    One frame-level scan per (session, attempt) gives the running repetitions
    and pose-frame count; everything else works on the small per-attempt
    table:

    * an attempt keeps its rows up to its first ``done`` row (its completion);
    * a completion precedes every later attempt, so a row's ``set_no`` is the
      number of completed earlier attempts of the session;
    * a set spans the attempts since the previous completion, so a frame's
      number is the kept pose frames of earlier attempts of its set plus its
      running count in the attempt.

    A frame without a pose leaves the latch as it is: its ``down`` is that of
    the last pose frame since the latch was last set up (same attempt and
    epoch), false before any (P10).  ``keys`` and ``within`` (as in ``prefix_scan``)
    are (session, attempt) together; they say how the frames lie.

    The per-attempt prefix sums are chunked scans over attempts.
    """
    att = ["session_id", "attempt"]
    f = prefix_scan(
        frames, keys, ORDER, chunk,
        [
            Scan("reps", F.col("rep_inc").cast("bigint"), "sum"),
            Scan("pose_count", F.col("has_pose").cast("bigint"), "sum"),
            Scan("held", F.when(F.col("has_pose"), F.struct("epoch", "down")), "last"),
        ],
        keep_partitioning=True,
        within=within,
    )
    held = F.coalesce((F.col("held")["epoch"] == F.col("epoch")) & F.col("held")["down"], F.lit(False))
    f = f.withColumn("down", F.when(F.col("has_pose"), F.col("down")).otherwise(held)).drop("held")
    f = f.withColumn("done", (F.col("goal") > 0) & (F.col("reps") >= F.col("goal")))
    done_seq = F.when(F.col("done"), F.col("seq"))
    per_attempt = f.groupBy(*att).agg(
        F.min(done_seq).alias("done_seq"),
        F.min_by("pose_count", done_seq).alias("pc_done"),
        F.max("pose_count").alias("pc_all"),
    )
    completed = F.col("done_seq").isNotNull()
    per_attempt = per_attempt.select(
        *att, "done_seq", completed.cast("bigint").alias("completed"),
        F.when(completed, F.col("pc_done")).otherwise(F.col("pc_all")).alias("kept_pc"),
        F.shiftright(F.col("attempt"), 16).alias("achunk"),
    )
    per_attempt = prefix_scan(
        per_attempt, ["session_id"], ["attempt"], "achunk",
        [Scan("set_no", F.col("completed"), "sum", inclusive=False)],
    )
    per_attempt = prefix_scan(
        per_attempt, ["session_id", "set_no"], ["attempt"], "achunk",
        [Scan("frame_offset", F.col("kept_pc"), "sum", inclusive=False)],
    ).select(*att, "done_seq", "set_no", "frame_offset")
    kept = f.join(per_attempt, att, "inner").where(
        F.col("done_seq").isNull() | (F.col("seq") <= F.col("done_seq"))
    )
    return kept.withColumns(
        {
            "series_number": (F.col("set_no") + 1).cast("bigint"),
            "frame": F.when(F.col("has_pose"), F.col("frame_offset") + F.col("pose_count") - 1),
        }
    ).drop("done_seq", "frame_offset", "pose_count")


def completed_sets(segments: DataFrame) -> DataFrame:
    """One row per stored set: settings at its first pose frame, reps and frames.

    Only sets containing a ``done`` row are stored (T3).  Partial aggregates
    (``min_by``/``max``/``count``) keyed by (session, set), no window.
    """
    first = F.min_by(
        F.struct("exercise", "goal", "strictness"), F.when(F.col("has_pose"), F.col("seq"))
    )
    g = segments.groupBy("session_id", "set_no").agg(
        F.max(F.col("done").cast("int")).alias("stored"),
        first.alias("s"),
        F.max_by("reps", "seq").alias("reps"),
        F.max_by("exercise", "seq").alias("exercise_at_end"),
        F.count(F.when(F.col("has_pose"), 1)).alias("frames"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )
    return g.where(F.col("stored") == 1).select(
        "session_id",
        (F.col("set_no") + 1).cast("bigint").alias("series_number"),
        F.col("s")["exercise"].alias("workout_name"),
        F.col("s")["goal"].cast("bigint").alias("rep_goal"),
        F.col("s")["strictness"].alias("strictness_crit"),
        F.col("reps").cast("bigint").alias("reps"),
        F.col("exercise_at_end"),
        F.col("frames").cast("bigint").alias("frames"),
        "first_seq",
        "last_seq",
    )


def status_messages(settings: DataFrame, segments: DataFrame) -> DataFrame:
    """Typed text messages a session emits (X6): ready, target, progress, complete.

    ``reps`` messages whose value is not an integer produce no message (the
    reference skips them); missing values default to 1.
    """
    ctl = settings.where(F.col("type").isin("workout", "reps") & (F.col("terminated") == 0))
    rv = F.trim(F.coalesce(F.col("value"), F.lit(K.CONTROL_DEFAULTS["reps"]))).try_cast("int")
    sel_tpl = K.STATUS_SELECTED.split("{}")
    tgt_tpl = K.STATUS_TARGET.split("{}")
    ctl_msg = F.when(
        F.col("type") == "workout",
        F.concat(F.lit(sel_tpl[0]), F.coalesce(F.col("value"), F.lit(K.CONTROL_DEFAULTS["workout"])), F.lit(sel_tpl[1])),
    ).when(rv.isNotNull(), F.concat(F.lit(tgt_tpl[0]), rv.cast("string"), F.lit(tgt_tpl[1])))
    ctl = ctl.select("session_id", "seq", F.lit("ready").alias("status"), ctl_msg.alias("message")).where(
        F.col("message").isNotNull()
    )
    prog = K.STATUS_PROGRESS.split("{}")
    done_tpl = K.STATUS_COMPLETE.split("{}")
    frm = segments.select(
        "session_id",
        "seq",
        F.when(F.col("done"), F.lit("completed")).otherwise(F.lit("In Progress")).alias("status"),
        F.when(
            F.col("done"),
            F.concat(F.lit(done_tpl[0]), F.col("reps").cast("string"), F.lit(done_tpl[1]), F.col("exercise"),
                     F.lit(done_tpl[2])),
        ).otherwise(F.concat(F.lit(prog[0]), F.col("reps").cast("string"), F.lit(prog[1]))).alias("message"),
    )
    return ctl.unionByName(frm)


def history_text(sets: DataFrame) -> DataFrame:
    """Per session: one line ``name: n reps`` per completed set, in set order.

    The list per session holds one short line per completed set.
    """
    line = F.concat(F.col("exercise_at_end"), F.lit(": "), F.col("reps").cast("string"), F.lit(" reps"))
    agg = sets.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct("series_number", line.alias("line")))).alias("lines")
    )
    text = F.concat(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n"))
    return agg.select("session_id", text.alias("history"), F.regexp_replace(text, "\n", "<br>").alias("history_html"))


def history_changes(sets: DataFrame) -> DataFrame:
    """The history as a log of changes (W8): each completed set adds one line.

    A version of the history holds from the message that completes its last
    set (``valid_from``) until the next set of the session is completed
    (``valid_to``, null for the last one); its text is the lines up to
    ``series_number``.  So the log is as long as the sets, where the text sent
    anew at each change grows with their square.  Sets of a session are
    numbered without gaps, so the next one is found by an equi-join.
    """
    line = F.concat(F.col("exercise_at_end"), F.lit(": "), F.col("reps").cast("string"), F.lit(" reps"))
    here = sets.select("session_id", "series_number", line.alias("line"), F.col("last_seq").cast("bigint").alias("valid_from"))
    following = sets.select(
        "session_id", (F.col("series_number") - 1).alias("series_number"), F.col("last_seq").cast("bigint").alias("valid_to")
    )
    return here.join(following, ["session_id", "series_number"], "left")


def rep_events(segments: DataFrame, chunk: str = "chunk") -> DataFrame:
    """Client-side repetition event (W7): the count rose, is not the goal, goal > 0.

    Every active frame reports the count; the previous count is the last
    reported one of the session (0 before the first).  Counts restart at 0 with
    each ``start``, which equals the client's resets.
    """
    prev = prefix_scan(
        segments, ["session_id"], ORDER, chunk,
        [Scan("prev_reps", F.col("reps"), "last", inclusive=False, default=0)],
    )
    return prev.withColumn(
        "rep_event",
        (F.col("reps") > F.col("prev_reps")) & (F.col("reps") != F.col("goal")) & (F.col("goal") > 0),
    )


def emit_changes(df: DataFrame, keys: list[str], order: list[str], chunk: str, value: str) -> DataFrame:
    """Rows whose ``value`` differs from the previous row's of the same key.

    The previous value comes from a chunked scan (no whole-key window); the
    first row of a key is always emitted.
    """
    prev = number_frames(
        df.withColumn("__val", F.coalesce(F.col(value), F.lit(""))),
        keys, order, chunk, frame_col="__pos", lags={"__prev": ("__val", None)}, materialize=True,
    )
    return prev.where(F.col("__prev").isNull() | (F.col("__val") != F.col("__prev"))).drop("__pos", "__val", "__prev")
