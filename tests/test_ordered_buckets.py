"""The ordered stream's state by buckets of sessions, and the replay's batches on many files."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from repsight.plans import streams
from repsight.plans.sessions import set_segments
from repsight.streaming.ordered import ordered_sessions, state_session

SCHEMA = "session_id long, seq long, ts_us long, type string, value string, angle double, form boolean"
SEC = 1_000_000


def session(sid, at, reps):
    """A set of ``reps`` repetitions from second ``at`` on, a message a second."""
    rows = [("start", None, None), ("workout", "push-ups", None), ("reps", str(reps), None), ("frame", None, 170.0)]
    rows += [("frame", None, a) for _ in range(reps) for a in (60.0, 170.0)]
    return [(sid, i, (at + i) * SEC, t, v, a, True if t == "frame" else None) for i, (t, v, a) in enumerate(rows)]


def run(spark, path, files, expire=None, **more):
    """(rows, entries in state after each batch); one file a batch."""
    own = state_session(spark)
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stream = ordered_sessions(source, "20 seconds", 30, expire, 10, **more)
    q = (
        stream.writeStream.format("parquet").option("path", f"{path}/out").trigger(availableNow=True)
        .option("checkpointLocation", f"{path}/state").outputMode("append").start()
    )
    q.awaitTermination()
    rows = spark.read.schema(stream.schema).parquet(f"{path}/out").collect()
    return rows, [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]


def disordered(sessions):
    """Files of the sessions' messages: some a step late, some twice, in any order; then the clock."""
    rng = random.Random(7)
    rows = [r for s in sessions for r in s]
    files = [[] for _ in range(6)]
    for r in rows:
        step = r[2] // SEC // 20
        files[step + (rng.random() < 0.2)].append(r)
        if rng.random() < 0.1:
            files[step + 1].append(r)
    for f in files:
        rng.shuffle(f)
    return [f for f in files if f] + [[(0, 0, 10_000 * SEC, "clock", None, None, None)]]


def test_state_and_calls_are_by_bucket(spark, tmp_path):
    """300 sessions in eight buckets: a position, slots, lines and a timer each; by session they were over 900 entries."""
    rows, held = run(spark, tmp_path, disordered([session(s, s % 40, 1 + s % 3) for s in range(300)]), buckets=8)
    assert max(held) <= 8 * (1 + 9 + 2 + 2)
    by = Counter(r.kind for r in rows)
    assert by["history"] == 300 and by["message"] == sum(4 + 2 * (1 + s % 3) for s in range(300))
    assert {(r.session_id, r.note) for r in rows if r.kind == "history"} == {
        (s, f"push-ups: {1 + s % 3} reps") for s in range(300)
    }


def test_results_do_not_depend_on_the_buckets(spark, tmp_path):
    sessions = [session(s, s % 40, 1 + s % 3) for s in range(30)]
    sessions[3][4] = (3, 4, sessions[3][4][2], "workout", "rowing", None, None)  # ends the session
    sessions[5] += [r[:1] + (r[1] + 100, r[2] + 50 * SEC) + r[3:] for r in session(5, 0, 2)]
    files = disordered(sessions)
    got = [Counter(run(spark, tmp_path / str(n), files, expire=40, buckets=n)[0]) for n in (1, 1000)]
    assert got[0] == got[1]
    assert {r.session_id for r in got[0] if r.kind == "frame" and r.seq > 4} == set(range(30)) - {3}


def test_missing_keys_are_kept_apart(spark, tmp_path):
    """A missing session is one of its own, a message without time is late."""
    rows = session(None, 0, 1) + session(1, 0, 1) + [(1, 90, None, "frame", None, 60.0, True)]
    got, _ = run(spark, tmp_path, [rows, [(0, 0, 10_000 * SEC, "clock", None, None, None)]], buckets=1)
    assert Counter(r.session_id for r in got if r.kind == "message") == {None: 6, 1: 6}
    assert [(r.session_id, r.seq, r.ts_us, r.note) for r in got if r.kind == "reject"] == [(1, 90, None, "late")]
    assert sorted(str(r.session_id) for r in got if r.kind == "history") == ["1", "None"]


@pytest.fixture
def many_files(spark, tmp_path):
    """Events of 40 users over 20 days, and messages in eight partitions."""
    rng = random.Random(3)
    kinds = ["view", "click", "error", "signup", "purchase"]
    start = dt.datetime(2024, 1, 1)
    rows = [
        (i, start + dt.timedelta(minutes=rng.randrange(20 * 24 * 60)), rng.randrange(40), rng.choice(kinds), 1.0,
         f'{{"k": {rng.randrange(100)}}}')
        for i in range(3000)
    ]
    spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield str(tmp_path)
    spark.conf.set(name, before)


def test_a_trigger_reads_one_step_of_the_replay(spark, many_files):
    """Messages a step late were behind the watermark where a trigger read parts of two steps."""
    got = Counter(r.outcome for r in streams.stream_message_ledger(spark, many_files).collect())
    messages = streams.A.session_messages(spark, many_files)
    twice = messages.where((F.col("session_id") + F.col("seq")) % 7 == 0).count()
    assert got == {"applied": messages.count(), "duplicate": twice}


def test_ordered_sets_of_many_files_are_the_batch_sets(spark, many_files):
    names = ["session_id", "seq", "attempt", "epoch", "series_number", "frame", "down", "reps", "done", "form_ok", "exercise", "goal"]
    got, want = (Counter(q(spark, many_files).select(names).collect()) for q in (streams.stream_ordered_sets, set_segments))
    assert got == want and len(got) > 100


def test_a_part_without_rows_keeps_the_steps_apart(spark, tmp_path):
    """All messages of a step in one partition: the step still has as many files as the others."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), i // 50, "view", 1.0, '{"k": 1}') for i in range(400)]
    spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ).write.parquet(f"{tmp_path}/events.parquet")
    name = "spark.sql.adaptive.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        path, _ = streams.stage_disordered(spark, str(tmp_path))
    finally:
        spark.conf.set(name, before)
    files = spark.read.parquet(path).inputFiles()
    assert (len(files) - 1) % (streams.DISORDER_STEPS + 1) == 0
    writes = Counter(f.rsplit("/", 1)[1].split("-", 2)[2] for f in files)  # a write's files share its id
    assert len(writes) > streams.DISORDER_STEPS + 2  # some parts were empty
