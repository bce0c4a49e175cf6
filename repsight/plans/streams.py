"""Registered queries run as Structured Streaming jobs (``availableNow``)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round6
from ..session import ensure_checkpoint_dir
from ..sources import adapters as A
from ..streaming.frames import frame_state_stream, run_to_folder, run_to_table
from ..streaming.sessions import session_stream
from .registry import query


def event_stream(spark: SparkSession, base: str, max_files: int = 1) -> DataFrame:
    """The events table, a file or a folder of files, as a file stream (one file per trigger)."""
    path = f"{base.rstrip('/')}/events.parquet"
    table = spark.read.parquet(path)
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files)
    if all(f.endswith("/events.parquet") for f in table.inputFiles()):
        # one file: the file source reads folders only, so it gets the folder and the file's name
        return source.option("pathGlobFilter", "events.parquet").parquet(base)
    return source.parquet(path)


@query("stream_frame_state")
def stream_frame_state(spark: SparkSession, base: str) -> DataFrame:
    """Per-frame state computed incrementally, one row for every event.

    Equals the batch ``frame_state`` where each file follows the one before in
    time.  A late row (at or before its key's last one) comes without frame,
    down and rep_count, which no other row lacks.
    """
    ev = event_stream(spark, base)
    signal = ev.select(
        F.col("user_id").alias("workout_id"), "ts", "event_id",
        A.event_theta().alias("angle"), (F.col("event_type") != "error").alias("form"),
    )
    out = run_to_table(spark, frame_state_stream(signal), "frame_state")
    return out.select(
        "workout_id", "frame", round6("angle").alias("angle"), "down", "rep_count", "form_ok"
    )


def _slices(lo, hi, parts: int):
    """``parts`` consecutive time slices covering every row (first and last open-ended)."""
    ts = F.col("ts")
    edges = [F.lit(lo + (hi - lo) * i / parts).cast("timestamp_ntz") for i in range(1, parts)]
    out = []
    for i in range(parts):
        cond = F.lit(True)
        if i > 0:
            cond = cond & (ts >= edges[i - 1])
        if i < parts - 1:
            cond = cond & (ts < edges[i])
        out.append(cond)
    return out


def slice_files(spark: SparkSession) -> int:
    """Files of a time slice, read in one trigger: as many as tasks can write and read them at once."""
    return max(4, spark.sparkContext.defaultParallelism)


def stage_messages(spark: SparkSession, base: str, parts: int = 3, files: int = 4) -> str:
    """Write the session messages (derived from events by Spark) in ``parts``
    time slices into a fresh folder of the shared checkpoint area.

    Each slice is written in parallel as ``files`` files hashed by session, so
    all rows of a session in a slice share one file, and slices are written
    one after another (later modification times).  Reading ``files`` files per
    trigger therefore never hands a session's later rows to an earlier batch.
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/staged/messages-{uuid.uuid4().hex}"
    msgs = A.session_messages(spark, base).select("session_id", "seq", "ts", "type", "value", "angle", "form").checkpoint()
    bounds = msgs.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()[0]
    lo, hi = bounds["lo"], bounds["hi"]
    for cond in _slices(lo, hi, parts):
        msgs.where(cond).repartition(files, "session_id").write.mode("append").parquet(path)
        time.sleep(1.1)  # distinct modification times keep the file order
    return path


@query("stream_sets")
def stream_sets(spark: SparkSession, base: str) -> DataFrame:
    """Set segmentation computed incrementally over three micro-batches; equals ``set_segments``."""
    files = slice_files(spark)
    path = stage_messages(spark, base, files=files)
    schema = spark.read.parquet(path).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    out = run_to_table(spark, session_stream(src), "sets")
    return out


@query("stream_stored_sets")
def stream_stored_sets(spark: SparkSession, base: str) -> DataFrame:
    """Completed sets stored by a streaming job through ``foreachBatch``."""
    from ..streaming.sink import new_store, store_sets, stored_table

    files = slice_files(spark)
    path = stage_messages(spark, base, files=files)
    schema = spark.read.parquet(path).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    store = new_store(spark, "sets")
    store_sets(spark, session_stream(src), store)
    return stored_table(spark, store, "sets").select(
        "session_id", "series_number", F.col("reps").cast("bigint").alias("reps"), "exercise_at_end",
        F.col("frames").cast("bigint").alias("frames"), F.col("last_seq").cast("bigint").alias("last_seq"),
    )


def stage_native(spark: SparkSession, base: str, parts: int = 3, files: int = 4) -> str:
    """Native pose-session messages (frames with landmarks + controls, derived
    from events) written in time slices, as ``stage_messages`` does."""
    from ..operators.pose_sessions import native_messages

    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/staged/native-{uuid.uuid4().hex}"
    frames, controls = A.native_sessions(spark, base, held=True)
    msgs = native_messages(frames, controls).select("session_id", "seq", "ts", "type", "value", "landmarks")
    bounds = msgs.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()[0]
    lo, hi = bounds["lo"], bounds["hi"]
    for cond in _slices(lo, hi, parts):
        msgs.where(cond).repartition(files, "session_id").write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


@query("stream_pose_sessions")
def stream_pose_sessions(spark: SparkSession, base: str) -> DataFrame:
    """Pose sessions computed incrementally; equals the batch ``pose_session_frames``."""
    from ..streaming.pose_sessions import pose_session_stream

    files = slice_files(spark)
    path = stage_native(spark, base, files=files)
    schema = spark.read.parquet(path).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    out = run_to_table(spark, pose_session_stream(src), "pose_sessions")
    return out.select(
        "session_id", "seq", "series_number", F.col("frame").cast("bigint").alias("frame"), "left_side", "down",
        "reps", "done", "form_ok", "form_issues", "exercise",
        round6("rep").alias("rep_angle"), round6("aux").alias("aux_angle"),
    )


@query("stream_saved_sets")
def stream_saved_sets(spark: SparkSession, base: str) -> DataFrame:
    """Sets of a pose-session stream saved into all three tables at once and read back (S8, T3): each set's metadata
    with its rows in the other two tables."""
    from ..operators.tables import read_sets
    from ..streaming.pose_sessions import pose_session_stream
    from ..streaming.sink import new_store, save_sets_stream
    from .sets import micros

    files = slice_files(spark)
    path = stage_native(spark, base, files=files)
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    store = new_store(spark, "pose-sets")
    save_sets_stream(spark, pose_session_stream(source), path, store)
    workout, analysis, raw = read_sets(spark, f"{store}/sets")
    keys = analysis.groupBy(F.col("workout_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_frames"), F.max("rep_count").cast("bigint").alias("reps")
    )
    shown = raw.groupBy(F.col("workout_id").alias("id")).agg(F.count(F.lit(1)).alias("n_landmarks"))
    return workout.join(keys, "id").join(shown, "id").select(
        F.col("series_number").cast("bigint").alias("series_number"), "workout_name", "strictness_crit", "left_side",
        F.col("rep_goal").cast("bigint").alias("rep_goal"), micros("timestamp_start").alias("timestamp_start_us"),
        "n_frames", "n_landmarks", "reps",
    )


DISORDER_STEPS = 4
IDLE_SECONDS = 86_400
SLOT_SECONDS = 7 * 86_400  # sessions of the events table have a message every few hours
BUCKET_SESSIONS = 256  # sessions whose state is read and written together


def stage_disordered(spark: SparkSession, base: str, steps: int = DISORDER_STEPS) -> tuple[str, int]:
    """The session messages in files that interleave sessions out of order; (folder, delay in seconds that covers it).

    Each message belongs to a time slice; where (session_id + seq / 10) % 5 = 0
    it comes with the next slice's files, and where (session_id + seq) % 7 = 0
    it comes a second time, with the next slice's.  The last file holds a clock
    message, which moves the watermark past all others.

    Every step has the same number of files, so that a trigger of as many reads
    one step: the delay covers messages a step late, and a trigger over parts of
    two steps would move the watermark past the rest of the second.
    """
    from .sets import micros

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/disordered-{uuid.uuid4().hex}"
    msgs = A.session_messages(spark, base).select(
        "session_id", "seq", micros("ts").alias("ts_us"), "type", "value", "angle", "form"
    ).checkpoint()
    lo, hi = msgs.agg(F.min("ts_us"), F.max("ts_us")).first()
    if lo is None:
        lo = hi = 0
    width = (hi - lo) // steps + 1
    step = F.floor((F.col("ts_us") - lo) / width)
    given = step + ((F.col("session_id") + F.floor(F.col("seq") / 10)) % 5 == 0).cast("int")
    again = F.when((F.col("session_id") + F.col("seq")) % 7 == 0, F.array(given, step + 1)).otherwise(F.array(given))
    dealt = msgs.withColumn("step", F.explode(again))
    files = max(1, min(slice_files(spark), msgs.rdd.getNumPartitions()))
    empty = msgs.limit(0).coalesce(1)
    for i in range(steps + 1):
        dealt.where(F.col("step") == i).drop("step").coalesce(files).write.mode("append").parquet(path)
        # a part without rows writes no file
        for _ in range(len(spark.read.schema(msgs.schema).parquet(path).inputFiles()), (i + 1) * files):
            empty.write.mode("append").parquet(path)
        time.sleep(1.1)  # distinct modification times keep the file order
    delay = width // 1_000_000 + 3600
    clock = hi + (delay + 2 * IDLE_SECONDS) * 1_000_000
    end = empty.unionByName(
        spark.sql(f"SELECT 0L AS session_id, 0L AS seq, {clock}L AS ts_us, 'clock' AS type, CAST(NULL AS STRING) AS value, "
                  "CAST(NULL AS DOUBLE) AS angle, CAST(NULL AS BOOLEAN) AS form")
    )
    end.coalesce(1).write.mode("append").parquet(path)
    return path, delay


def run_ordered(spark: SparkSession, base: str, expire: int | None = None) -> DataFrame:
    """All results of the ordered session stream over the disordered messages."""
    from ..streaming.ordered import ordered_sessions, state_session

    path, delay = stage_disordered(spark, base)
    own = state_session(spark)
    table = own.read.parquet(path)
    files = (len(table.inputFiles()) - 1) // (DISORDER_STEPS + 1)  # of a step; the clock's is the last
    sessions = table.agg(F.approx_count_distinct("session_id")).first()[0]
    buckets = max(int(own.conf.get("spark.sql.shuffle.partitions")), sessions // BUCKET_SESSIONS)
    source = own.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)
    stream = ordered_sessions(source, f"{delay} seconds", IDLE_SECONDS, expire, SLOT_SECONDS, buckets)
    return spark.read.schema(stream.schema).parquet(run_to_folder(own, stream, "ordered"))


@query("stream_ordered_sets")
def stream_ordered_sets(spark: SparkSession, base: str) -> DataFrame:
    """Set segmentation from messages out of order (J7, T2): the reorder buffer makes it equal ``set_segments``."""
    return run_ordered(spark, base).where("kind = 'frame'").select(
        "session_id", "seq", "attempt", "epoch", "series_number", "frame", "down", "reps", "done", "form_ok", "exercise", "goal"
    )


@query("stream_message_ledger")
def stream_message_ledger(spark: SparkSession, base: str) -> DataFrame:
    """What became of every message that arrived (T6): applied, or the reason why not."""
    rows = run_ordered(spark, base).where("kind in ('message', 'reject')")
    return rows.select("session_id", "seq", F.when(F.col("kind") == "message", "applied").otherwise(F.col("note")).alias("outcome"))


@query("stream_idle_history")
def stream_idle_history(spark: SparkSession, base: str) -> DataFrame:
    """The history line of every completed set and the idle moment at which it is sent (T5)."""
    return run_ordered(spark, base).where("kind = 'history'").select(
        "session_id", "series_number", F.col("note").alias("line"), F.col("ts_us").alias("sent_at_us")
    )
