"""Registered queries: typed messages, rejected rows, damaged files, orphans of streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..operators import messages as M
from ..operators import sessions as S
from ..operators import text as TX
from ..operators import validation as V
from ..operators.scan import checkpoint
from ..session import ensure_checkpoint_dir
from ..sources import adapters as A
from ..sources.landmarks import landmark_dimension, read_damaged_landmark_csv
from ..sources.tables import read_table
from ..streaming.frames import run_to_table
from ..streaming.orphans import orphan_stream
from .registry import query
from .sets import micros
from .text import GENERATED_AT, responses


@query("typed_controls")
def typed_controls(spark: SparkSession, base: str) -> DataFrame:
    """Control messages with values of every JSON type (S2): a goal comes as 2, 2.7, "2", "2.7" or true in turn."""
    msgs = A.session_messages(spark, base).where("type != 'frame'")
    form = F.floor(F.col("seq") / 10) % 5
    v = F.col("value")
    goal = (
        F.when(form == 0, v).when(form == 1, F.concat(v, F.lit(".7"))).when(form == 2, F.concat(F.lit('"'), v, F.lit('"')))
        .when(form == 3, F.concat(F.lit('"'), v, F.lit('.7"'))).otherwise(F.lit("true"))
    )
    text = F.when(F.col("type") == "reps", F.concat(F.lit('{"type":"reps","value":'), goal, F.lit("}")))
    raw = msgs.select("session_id", "seq", text.otherwise(F.to_json(F.struct("type", "value"))).alias("message"))
    return M.typed_controls(raw).withColumn("goal", F.col("goal").cast("bigint"))


@query("typed_messages")
def typed_messages(spark: SparkSession, base: str) -> DataFrame:
    """All outgoing messages of the sessions as JSON envelopes, read back by type (S10): data, feedback, error, history."""
    settings = S.settings_asof(A.session_messages(spark, base), forms=("form", "form"))
    segments = S.segment_settings(settings)
    sets = checkpoint(S.completed_sets(segments))
    at = sets.select("session_id", "series_number", F.col("last_seq").cast("bigint").alias("seq"))
    data = S.status_messages(settings, segments).select(
        "session_id", "seq", M.envelope("data", F.col("message"), F.col("status")).alias("envelope")
    )
    parsed = TX.parse_responses(responses(spark, base)).join(at, ["session_id", "series_number"])
    feedback = TX.feedback_block(parsed, F.lit(GENERATED_AT)).select(
        "session_id", "seq", M.envelope("feedback", F.col("feedback_html")).alias("envelope")
    )
    error = parsed.where("status = 'rejected'").select(
        "session_id", "seq", M.envelope("error", F.lit(K.FEEDBACK_ERROR)).alias("envelope")
    )
    history = S.history_changes(sets).select(
        "session_id", F.col("valid_from").alias("seq"), M.envelope("history", F.concat("line", F.lit("<br>"))).alias("envelope")
    )
    return M.read_envelopes(data.unionByName(feedback).unionByName(error).unionByName(history))


@query("rejected_rows")
def rejected_rows(spark: SparkSession, base: str) -> DataFrame:
    """Rows rejected by one validation step (F15, P15): unknown exercise, unknown strictness, broken coordinates.

    Settings and a coordinate of every event: the exercise and the strictness by
    k, the coordinate missing for errors and no number for purchases.
    """
    k = A.event_k()
    pick = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))
    x = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_type") == "purchase", F.lit("NaN").cast("double"))
    rows = read_table(spark, base, "events", ["event_id", "user_id", "event_type", "value", "props"]).select(
        F.col("user_id").alias("session_id"), "event_id", pick(["push-ups", "squats", "abs"], k).alias("exercise"),
        pick(["Strict", "moderate", "loose", "harsh", None], k).alias("strictness"), x.otherwise(F.col("value")).alias("x"),
    )
    _, rejects = V.split(rows, V.setting_rules() | V.coordinate_rule("x"))
    return rejects.select("session_id", "event_id", "reject_reason")


@query("landmark_csv")
def landmark_csv(spark: SparkSession, base: str) -> DataFrame:
    """Landmark lines with damaged ones among them, written as CSV and read back (S3): how often each was read.

    One line per vector: that of landmark vec_id % 33; it lacks its name where
    vec_id % 7 = 3, has a value too many where it is 4, and no index where it is 5.
    """
    v = F.col("vec_id")
    dim = F.broadcast(landmark_dimension(spark))  # 33 rows
    rows = read_table(spark, base, "embeddings", ["vec_id"]).withColumn("index", (v % 33).cast("int")).join(dim, "index")
    head = F.concat(F.col("index").cast("string"), F.lit(" , "), F.coalesce("side", F.lit("")))
    line = (
        F.when(v % 7 == 3, head).when(v % 7 == 4, F.concat(head, F.lit(", "), "name", F.lit(",x")))
        .when(v % 7 == 5, F.concat(F.lit("no , "), F.coalesce("side", F.lit("")), F.lit(","), "name"))
        .otherwise(F.concat(head, F.lit(", "), "name", F.lit(" ")))
    )
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/landmarks-{uuid.uuid4().hex}"
    rows.select(line.alias("line")).write.text(path)
    read = read_damaged_landmark_csv(spark, path, header=False)
    good = F.col("damaged_line").isNull()
    return read.groupBy(
        F.when(good, F.col("index").cast("bigint")).alias("index"), F.when(good, F.col("side")).alias("side"),
        F.when(good, F.col("name")).alias("name"), "damaged_line",
    ).agg(F.count(F.lit(1)).alias("lines"))


@query("stream_orphans")
def stream_orphans(spark: SparkSession, base: str) -> DataFrame:
    """Events whose user has no parent row, found while both stream in.

    Parents are the users' first events, but those of users with user_id % 5 = 0
    are missing.
    """
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/orphans-{uuid.uuid4().hex}"
    ev = read_table(spark, base, "events", ["event_id", "ts", "user_id"]).select(
        F.col("user_id").alias("workout_id"), "event_id", F.timestamp_micros(micros("ts")).alias("ts")
    )
    parents = ev.groupBy("workout_id").agg(F.min("ts").alias("ts")).where("workout_id % 5 != 0")
    end = ev.agg((F.max("ts") + F.expr("INTERVAL 200 DAYS")).alias("ts")).where("ts is not null")  # moves the watermark past all
    clock = end.select(F.lit(0).cast("bigint").alias("workout_id"), F.lit(None).cast("bigint").alias("event_id"), "ts")
    ev.unionByName(clock).write.parquet(f"{root}/events")
    parents.unionByName(clock.drop("event_id")).write.parquet(f"{root}/parents")
    stream = lambda name: spark.readStream.schema(spark.read.parquet(f"{root}/{name}").schema).parquet(f"{root}/{name}")
    found = orphan_stream(stream("events"), stream("parents"), "workout_id", "ts", "1 hour", "60 DAYS")
    return run_to_table(spark, found, "orphans").where("event_id is not null").select("workout_id", "event_id")
