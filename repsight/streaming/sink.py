"""Storing sets from a stream (S8, T3) with ``foreachBatch``.

``store_sets`` writes two tables.  Per micro-batch, the processed frames are appended to ``frames`` and every
completion adds one row to ``sets``.  Each batch writes into its own
``epoch=<id>`` folder with overwrite, so a batch re-run after a failure
replaces its own output (idempotent, exactly-once with the checkpoint).
Readers take the frames of stored sets with a semi-join on ``sets``.
``save_sets_stream`` saves the three tables of the sets as one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pose_sessions import set_tables
from ..operators.tables import set_store


def _writer(base_path: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base_path}/frames/epoch={epoch_id}")
        done = batch.where(F.col("done")).select(
            "session_id", "series_number",
            F.col("reps").alias("reps"),
            F.col("exercise").alias("exercise_at_end"),
            (F.col("frame") + 1).alias("frames"),
            F.col("seq").alias("last_seq"),
        )
        done.write.mode("overwrite").parquet(f"{base_path}/sets/epoch={epoch_id}")

    return write


def store_sets(spark: SparkSession, segments: DataFrame, base_path: str) -> None:
    """Run the segment stream to completion (``availableNow``) into ``base_path``."""
    q = (
        segments.writeStream.foreachBatch(_writer(base_path))
        .option("checkpointLocation", f"{base_path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def _set_writer(base_path: str, messages_path: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{base_path}/_frames/epoch={epoch_id}")
        store = set_store(spark, f"{base_path}/sets")
        if store.committed(str(epoch_id)):
            return
        key = ["session_id", "series_number"]
        frames = spark.read.schema(batch.schema).parquet(f"{base_path}/_frames")
        done = frames.where(F.col("done") & (F.col("epoch") == epoch_id)).select(*key).distinct()
        kept = frames.where(F.col("epoch") <= epoch_id).join(done, key, "left_semi").drop("epoch")
        native = spark.read.parquet(messages_path).where("type = 'frame'").select("session_id", "seq", "landmarks")
        after = store.last_id()
        workout, analysis, raw = set_tables(kept, native, after)
        workout = workout.checkpoint()
        last = workout.agg(F.max("id")).first()[0]
        store.save(str(epoch_id), {"workout": workout, "workout_analysis": analysis, "raw_landmarks": raw}, last or after)

    return write


def save_sets_stream(spark: SparkSession, frames: DataFrame, messages_path: str, base_path: str) -> None:
    """Save the completed sets of a pose-session stream (``pose_session_stream``) into all three tables at once.

    Each micro-batch keeps its frames under its number, and saves the sets
    completed in it with all of their frames so far as one batch of the set
    store, numbered on from the greatest stored number.  A micro-batch that is
    run again replaces its frames and finds its save committed, or saves it: each
    set is in every table once.  ``messages_path`` holds the native messages, for
    the landmarks.
    """
    q = (
        frames.writeStream.foreachBatch(_set_writer(base_path, messages_path))
        .option("checkpointLocation", f"{base_path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def stored_table(spark: SparkSession, base_path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base_path}/{name}").drop("epoch")


def new_store(spark: SparkSession, label: str) -> str:
    from ..session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stores/{label}-{uuid.uuid4().hex}"
