"""Streams equal their batch counterparts."""

from pyspark.sql import functions as F

from repsight.plans import QUERIES

BASE = "/root/testdata/sf0.001"


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_stream_frame_state_equals_batch(spark):
    assert _rows(QUERIES["stream_frame_state"](spark, BASE)) == _rows(QUERIES["frame_state"](spark, BASE))


def test_stream_sets_equals_batch(spark):
    assert _rows(QUERIES["stream_sets"](spark, BASE)) == _rows(QUERIES["set_segments"](spark, BASE))


def test_stream_stored_sets_equal_batch(spark):
    from pyspark.sql import functions as F

    batch = QUERIES["completed_sets"](spark, BASE).select(
        "session_id", "series_number", "reps", "exercise_at_end", "frames", F.col("last_seq").cast("bigint")
    )
    assert _rows(QUERIES["stream_stored_sets"](spark, BASE)) == _rows(batch)


def test_frame_stream_reads_a_folder_in_any_order_and_loses_nothing(spark, tmp_path):
    """Three files, in order and not: every input row comes out, in order or marked late."""
    import time

    from repsight.plans.streams import event_stream
    from repsight.sources import adapters as A
    from repsight.streaming.frames import frame_state_stream, run_to_table
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{BASE}/events.parquet")
    edges = events.approxQuantile("event_id", [0.33, 0.67], 0.0)
    parts = [
        events.where(F.col("event_id") < edges[0]),
        events.where((F.col("event_id") >= edges[0]) & (F.col("event_id") < edges[1])),
        events.where(F.col("event_id") >= edges[1]),
    ]
    for order, name in ((parts, "ordered"), (parts[::-1], "reversed")):
        for part in order:
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name / "events.parquet"))
            time.sleep(1.1)
        ev = event_stream(spark, str(tmp_path / name))
        signal = ev.select(
            F.col("user_id").alias("workout_id"), "ts", "event_id",
            A.event_theta().alias("angle"), (F.col("event_type") != "error").alias("form"),
        )
        out = run_to_table(spark, frame_state_stream(signal), name)
        assert sorted(r.event_id for r in out.select("event_id").collect()) == sorted(
            r.event_id for r in events.select("event_id").collect()
        )
    assert out.where("late").count() > 0


def test_registered_frame_stream_gives_every_row_of_unordered_files(spark, tmp_path):
    import time
    from collections import Counter

    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{BASE}/events.parquet")
    middle = events.approxQuantile("event_id", [0.5], 0.0)[0]
    for part in (events.where(F.col("event_id") >= middle), events.where(F.col("event_id") < middle)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        time.sleep(1.1)
    got = QUERIES["stream_frame_state"](spark, str(tmp_path)).collect()
    want = QUERIES["frame_state"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) == events.count()
    for columns in (["workout_id"], ["workout_id", "angle"]):
        assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(tuple(r[c] for c in columns) for r in want)
    late = [r for r in got if r.frame is None]
    assert late and all(r.down is None and r.rep_count is None for r in late)
    frames = Counter((r.workout_id, r.frame) for r in got if r.frame is not None)
    assert max(frames.values()) == 1 and sum(frames.values()) + len(late) == len(want)


def test_unknown_exercise_and_texts_that_are_no_goals_mean_the_same_in_batch_and_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from repsight.operators.sessions import settings_asof
    from repsight.streaming.frames import run_to_table
    from repsight.streaming.sessions import session_stream

    control = lambda s, q, t, v: (s, q, t, v, None, None)
    rows = [control(1, 0, "start", None), control(1, 1, "workout", "abs"), control(1, 2, "reps", "1")]
    rows += [(1, 3 + i, "frame", None, a, True) for i, a in enumerate([170.0, 60.0, 170.0, 60.0])]
    rows += [control(1, 8, "workout", "squats"), (1, 9, "frame", None, 170.0, True)]  # too late: the session has ended
    for s, goal in ((2, "1.0"), (3, "1e2"), (4, " 2 "), (5, "99999999999"), (6, "+1")):
        rows += [control(s, 0, "start", None), control(s, 1, "workout", "push-ups"), control(s, 2, "reps", goal)]
        rows += [(s, 3 + i, "frame", None, a, True) for i, a in enumerate([170.0, 60.0, 170.0, 60.0, 170.0])]
    schema = "session_id long, seq long, type string, value string, angle double, form boolean"
    msgs = spark.createDataFrame(rows, schema).withColumn("chunk", F.lit(0))
    batch = {
        (r.session_id, r.seq, r.exercise, r.goal)
        for r in settings_asof(msgs).where("type = 'frame' and attempt > 0 and terminated = 0").collect()
    }
    for cut in (100, 5):  # one micro-batch, and a cut through the sessions
        path = str(tmp_path / f"cut{cut}")
        for part in (msgs.where(F.col("seq") < cut), msgs.where(F.col("seq") >= cut)):
            part.drop("chunk").coalesce(1).write.mode("append").parquet(path)
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1 if cut == 100 else 9).parquet(path)
        out = {(r.session_id, r.seq, r.exercise, r.goal) for r in run_to_table(spark, session_stream(src), "unknown").collect()}
        assert {r for r in out if r[0] == 1} == set()
        done = {s for s, _, _, g in out if g in (1, 2)}
        assert done == {4, 6} and {(s, g) for s, _, _, g in out} == {(s, g) for s, _, _, g in batch}


def test_idle_keys_are_forgotten(spark, tmp_path):
    """Ten batches of new workouts: the state holds those of the last ones, and one that comes back starts anew."""
    import time

    from repsight.streaming.frames import frame_state_stream

    schema = "workout_id long, ts timestamp_ntz, event_id long, angle double, form boolean"
    rows, path = [], str(tmp_path / "in")
    spark.createDataFrame([], schema).write.parquet(path)
    held = []
    own = spark.newSession()  # a run that ends with its input gives no batches without rows, which idle time would ask for for ever
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", "2")
    source = own.readStream.schema(schema).parquet(path)
    for i in range(10):
        for w in (range(10 * i, 10 * i + 5) if i < 9 else [0]):
            rows += [(w, 1000 * i + n) for n in range(3)]
        batch = spark.createDataFrame(rows[-15 if i < 9 else -3:], "workout_id long, event_id long").selectExpr(
            "workout_id", "timestamp_seconds(event_id)::timestamp_ntz AS ts", "event_id", "90.0D AS angle", "true AS form"
        )
        batch.coalesce(1).write.mode("append").parquet(path)
        q = (
            frame_state_stream(source, idle=0.1).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
        held.append(q.recentProgress[-1].stateOperators[0].numRowsTotal)
        time.sleep(0.2)
    assert max(held) <= 5 and held[-1] == 1
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == len(rows) and not out.where("late").count()
    assert [r.frame for r in out.where("workout_id = 0").orderBy("event_id").collect()] == [0, 1, 2, 0, 1, 2]


def test_state_functions_get_few_columns_and_cost_little(spark):
    """Each column and each vectorised call costs time for every session of a micro-batch."""
    import time

    import numpy as np
    import pandas as pd

    from repsight.operators import exercises as X
    from repsight.schemas import POSE
    from repsight.streaming import pose_sessions as P
    from repsight.streaming import sessions as S

    given = spark.createDataFrame([], "session_id long, seq long, ts timestamp_ntz, type string, value string").withColumn(
        "landmarks", F.lit(None).cast(POSE)
    )
    tags = dict(X.TAGS)
    assert len(P.packed_rules(P.feature_columns(given)).columns) <= 9

    n = 24
    kinds = ["start", "workout", *["frame"] * 10] * 2
    msgs = pd.DataFrame({"session_id": 1, "seq": np.arange(n), "type": kinds, "value": None, "angle": 80.0, "form": True})
    poses = msgs.assign(ts=pd.Timestamp("2024-01-01"), has_pose=True, left_first=True,
                        angles=[np.full(6, 80.0)] * n, rules=[np.full(12, 3)] * n)
    odd = poses.assign(session_id=np.nan, left_first=None, ts=pd.NaT)
    assert len(P.advance_pose_session(odd, P.INITIAL, tags)[0]) == 20
    for run in (lambda: S.advance_session(msgs, S.INITIAL_STATE), lambda: P.advance_pose_session(poses, P.INITIAL, tags)):
        out, _ = run()
        assert len(out) == 20
        begin = time.process_time()
        for _ in range(100):
            run()
        assert time.process_time() - begin < 0.8
