"""Incremental per-frame state with Structured Streaming.

``applyInPandasWithState`` keyed by workout: each call receives the rows of
one key in one micro-batch (bounded by the trigger's file/byte limits), sorts
them, and advances the latch with vectorised numpy using the same algebra as
the batch scan (events, forward fill, running sum).  The state per key is
constant size: frame count, previous form, latch position, repetitions and
the last processed position.

Rows older than the key's last processed position arrive too late to be
applied in order; they are emitted with ``late = true`` and do not change the
state (the stated lateness bound is: per key, a micro-batch only holds rows
after the previous one).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K

STATE_SCHEMA = T.StructType(
    [
        T.StructField("frames", T.LongType()),
        T.StructField("prev_form", T.BooleanType()),
        T.StructField("down", T.BooleanType()),
        T.StructField("rep_count", T.LongType()),
        T.StructField("last_ts", T.TimestampNTZType()),
        T.StructField("last_id", T.LongType()),
    ]
)

OUTPUT_SCHEMA = T.StructType(
    [
        T.StructField("workout_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("frame", T.LongType()),
        T.StructField("angle", T.DoubleType()),
        T.StructField("down", T.BooleanType()),
        T.StructField("rep_count", T.LongType()),
        T.StructField("form_ok", T.BooleanType()),
        T.StructField("late", T.BooleanType()),
    ]
)


def as_bool(s: pd.Series) -> np.ndarray:
    """Nullable boolean column -> numpy bool (null -> False)."""
    return s.astype("boolean").fillna(False).to_numpy(dtype=bool)


def _lagged(x: np.ndarray, first: bool) -> np.ndarray:
    out = np.empty(len(x), dtype=bool)
    if len(x):
        out[0] = first
        out[1:] = x[:-1]
    return out


def advance_latch(angle: np.ndarray, form: np.ndarray, prev_form0: bool, down0: bool, reps0: int,
                  form_down: np.ndarray | None = None, prev_form_down0: bool | None = None):
    """Vectorised latch over one ordered batch, continuing from the carried state.

    ``form``/``form_down``: the frame's form if the latch is up/down after it
    (equal unless given).  Returns (down, rep_count) arrays.
    """
    if form_down is None:
        form_down, prev_form_down0 = form, prev_form0
    prev_fu = _lagged(form, prev_form0)
    prev_fd = _lagged(form_down, prev_form_down0)
    valid = ~np.isnan(angle)
    ev = np.full(len(angle), np.nan)
    set_ = valid & (angle <= K.DOWN_THRESHOLD) & prev_fu
    reset = valid & (angle >= K.UP_THRESHOLD) & prev_fd & ~set_
    ev[set_] = 1.0
    ev[reset] = 0.0
    filled = pd.Series(ev).ffill().to_numpy()
    filled = np.where(np.isnan(filled), 1.0 if down0 else 0.0, filled)
    prev_down = np.empty(len(filled), dtype=bool)
    prev_down[0] = down0
    prev_down[1:] = filled[:-1] == 1.0
    rep = (ev == 0.0) & prev_down
    return filled == 1.0, reps0 + np.cumsum(rep)


def _frame_state_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    pdf = pd.concat(list(pdfs), ignore_index=True)
    if state.exists:
        frames, prev_form, down, reps, last_ts, last_id = state.get
    else:
        frames, prev_form, down, reps, last_ts, last_id = 0, False, False, 0, None, None
    pdf = pdf.sort_values(["ts", "event_id"], kind="mergesort").reset_index(drop=True)
    if last_ts is not None:
        lt = pd.Timestamp(last_ts)
        late = ((pdf["ts"] < lt) | ((pdf["ts"] == lt) & (pdf["event_id"] <= last_id))).to_numpy(dtype=bool)
    else:
        late = np.zeros(len(pdf), dtype=bool)
    late |= pdf.duplicated(["ts", "event_id"]).to_numpy(dtype=bool)
    out_late = pdf[late]
    cur = pdf[~late].reset_index(drop=True)
    parts = []
    if len(cur):
        angle = cur["angle"].to_numpy(dtype=float)
        form = as_bool(cur["form"])
        d, rc = advance_latch(angle, form, bool(prev_form), bool(down), int(reps))
        parts.append(
            pd.DataFrame(
                {
                    "workout_id": cur["workout_id"].astype("int64"),
                    "ts": cur["ts"],
                    "event_id": cur["event_id"].astype("int64"),
                    "frame": np.arange(frames, frames + len(cur), dtype="int64"),
                    "angle": angle,
                    "down": d,
                    "rep_count": rc.astype("int64"),
                    "form_ok": form,
                    "late": False,
                }
            )
        )
        state.update(
            (
                int(frames + len(cur)),
                bool(form[-1]),
                bool(d[-1]),
                int(rc[-1]),
                cur["ts"].iloc[-1].to_pydatetime(),
                int(cur["event_id"].iloc[-1]),
            )
        )
    if len(out_late):
        parts.append(
            pd.DataFrame(
                {
                    "workout_id": out_late["workout_id"].astype("int64"),
                    "ts": out_late["ts"],
                    "event_id": out_late["event_id"].astype("int64"),
                    "frame": pd.array([None] * len(out_late), dtype="Int64"),
                    "angle": out_late["angle"].astype(float),
                    "down": pd.array([None] * len(out_late), dtype="boolean"),
                    "rep_count": pd.array([None] * len(out_late), dtype="Int64"),
                    "form_ok": out_late["form"],
                    "late": True,
                }
            )
        )
    for p in parts:
        yield p


def with_state(grouped: GroupedData, fn: Callable, output: T.StructType, state: T.StructType, idle: float | None) -> DataFrame:
    """``fn`` over each key's rows and state; a key without rows for ``idle`` seconds is forgotten (never, if None).

    Idle time is processing time, counted from the key's last micro-batch, so
    no watermark is needed and no row is dropped: a key that comes back after
    it starts anew, as one never seen.  Spark then runs batches without rows
    as time goes by; a run that is to end with its input (``availableNow``)
    needs ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    if idle is None:
        return grouped.applyInPandasWithState(fn, output, state, "append", GroupStateTimeout.NoTimeout)

    def forgetting(key, pdfs: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        yield from fn(key, pdfs, held)
        if held.exists:
            held.setTimeoutDuration(int(idle * 1000))

    return grouped.applyInPandasWithState(forgetting, output, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def frame_state_stream(signal: DataFrame, idle: float | None = None) -> DataFrame:
    """Streaming per-frame state of an angle signal (``workout_id, ts, event_id, angle, form``).

    Every input row comes out once: in order with its state, or with ``late``
    set.  Late are rows at or before the key's last processed (ts, event_id),
    which covers a repeated row (T6) however late it comes, and repeats within
    a micro-batch; they leave the state as it is.  Nothing is dropped, so no
    watermark is needed.  ``idle``: see ``with_state``.
    """
    cols = signal.select("workout_id", "ts", "event_id", "angle", "form")
    return with_state(cols.groupBy("workout_id"), _frame_state_fn, OUTPUT_SCHEMA, STATE_SCHEMA, idle)


def run_to_folder(spark: SparkSession, stream: DataFrame, name: str) -> str:
    """Run ``stream`` to completion (``availableNow``) into parquet files in the shared checkpoint folder.

    The file sink with its checkpoint gives exactly-once output if an executor
    or the driver is lost and the query restarted.  Returns the files' folder.
    """
    from ..session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{root}/streams/{name}-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{run}/data")
        .option("checkpointLocation", f"{run}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return f"{run}/data"


def run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """``run_to_folder``, read back as a batch DataFrame."""
    return spark.read.schema(stream.schema).parquet(run_to_folder(spark, stream, name))
