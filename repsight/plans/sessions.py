"""Registered queries: sessions, sets, status and history (adapter E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round6
from ..operators import sessions as S
from ..sources import adapters as A
from .registry import query


def session_segments(spark: SparkSession, base: str) -> DataFrame:
    """Kept frames of adapter E's sessions; no query over them asks for times, so none cross the scans."""
    return S.segment(A.session_messages(spark, base).drop("ts"))


@query("settings_asof")
def settings_asof(spark: SparkSession, base: str) -> DataFrame:
    s = S.settings_asof(A.session_messages(spark, base))
    return s.select(
        "session_id", "seq", "type", F.col("attempt").cast("bigint").alias("attempt"),
        F.col("epoch").cast("bigint").alias("epoch"), "exercise", F.col("goal").cast("bigint").alias("goal"),
        "strictness", "rule_strictness",
    )


@query("set_segments")
def set_segments(spark: SparkSession, base: str) -> DataFrame:
    g = session_segments(spark, base)
    return g.select(
        "session_id", "seq", F.col("attempt").cast("bigint").alias("attempt"),
        F.col("epoch").cast("bigint").alias("epoch"), "series_number", F.col("frame").cast("bigint").alias("frame"),
        "down", F.col("reps").cast("bigint").alias("reps"), "done", "form_ok", "exercise",
        F.col("goal").cast("bigint").alias("goal"),
    )


@query("completed_sets")
def completed_sets(spark: SparkSession, base: str) -> DataFrame:
    return S.completed_sets(session_segments(spark, base))


@query("status_messages")
def status_messages(spark: SparkSession, base: str) -> DataFrame:
    msgs = A.session_messages(spark, base)
    settings = S.settings_asof(msgs, forms=("form", "form"))
    return S.status_messages(settings, S.segment_settings(settings))


@query("history_text")
def history_text(spark: SparkSession, base: str) -> DataFrame:
    return S.history_text(S.completed_sets(session_segments(spark, base)))


@query("history_changes")
def history_changes(spark: SparkSession, base: str) -> DataFrame:
    """One row per change of a session's history, with the messages it holds between."""
    from ..operators.scan import checkpoint

    return S.history_changes(checkpoint(S.completed_sets(session_segments(spark, base))))


@query("rep_events")
def rep_events(spark: SparkSession, base: str) -> DataFrame:
    e = S.rep_events(session_segments(spark, base))
    return e.select("session_id", "seq", F.col("reps").cast("bigint").alias("reps"),
                    F.col("prev_reps").cast("bigint").alias("prev_reps"), "rep_event")


@query("session_frame_angles")
def session_frame_angles(spark: SparkSession, base: str) -> DataFrame:
    """Angle and latch state of the kept frames per set (frame numbers restart per set)."""
    g = session_segments(spark, base)
    return g.where("has_pose").select(
        "session_id", "series_number", F.col("frame").cast("bigint").alias("frame"), round6("angle").alias("angle"),
        "down",
    )


@query("model_clock")
def model_clock(spark: SparkSession, base: str) -> DataFrame:
    """Model timestamp of each processed frame: 33 ms per processed frame of the session."""
    from .. import constants as K
    from ..operators.scan import Scan, prefix_scan

    g = session_segments(spark, base)
    c = prefix_scan(g, ["session_id"], ["seq"], "chunk", [Scan("processed", None, "count")])
    return c.select("session_id", "seq", (F.col("processed") * K.FRAME_STEP_MS).cast("bigint").alias("model_clock_ms"))


@query("status_changes")
def status_changes(spark: SparkSession, base: str) -> DataFrame:
    """Frame status messages of each session, emitted only when they change."""
    st = status_messages(spark, base).withColumn("chunk", F.shiftright(F.col("seq"), 16))
    ch = S.emit_changes(st, ["session_id"], ["seq"], "chunk", "message")
    return ch.select("session_id", "seq", "status", "message")


def control_text(spark: SparkSession, base: str) -> DataFrame:
    """Control messages of adapter E as JSON text; those with seq % 7 = 3 are truncated."""
    msgs = A.session_messages(spark, base).where(F.col("type") != "frame")
    body = F.when(
        F.col("type") == "reps", F.concat(F.lit('{"type":"reps","value":'), F.col("value"), F.lit("}"))
    ).otherwise(F.to_json(F.struct("type", "value")))
    text = F.when((F.col("seq") % 7) == 3, F.expr("substring(body, 1, length(body) - 2)")).otherwise(F.col("body"))
    return msgs.withColumn("body", body).select("session_id", "seq", text.alias("message"))


@query("control_parse")
def control_parse(spark: SparkSession, base: str) -> DataFrame:
    """Parsed control messages and rejects (S2): one row per input message."""
    from ..sources.controls import parse_controls

    ok, rej = parse_controls(control_text(spark, base))
    return ok.select("session_id", "seq", "type", "value", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        rej.select("session_id", "seq", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("value"),
                   "reject_reason")
    )
