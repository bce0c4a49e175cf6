"""The session stream on event time: order, rejects, idle history and bounded state."""

import random
from collections import Counter

from pyspark.sql import functions as F

from repsight.plans import streams
from repsight.sources.adapters import session_messages
from repsight.streaming.ordered import ordered_sessions, state_session

BASE = "/root/testdata/sf0.001"
SCHEMA = "session_id long, seq long, ts_us long, type string, value string, angle double, form boolean"
SEC, DAY = 1_000_000, 86_400_000_000


def session(sid, at, goal="1", reps=1, step=SEC):
    """A set of ``reps`` repetitions with the given goal from time ``at`` on."""
    rows = [("start", None, None), ("workout", "push-ups", None), ("reps", goal, None), ("frame", None, 170.0)]
    rows += [("frame", None, a) for _ in range(reps) for a in (60.0, 170.0)]
    return [
        (sid, 10 * i + at // SEC, at + i * step, t, v, a, True if t == "frame" else None) for i, (t, v, a) in enumerate(rows)
    ]


def run(spark, tmp_path, files, delay, idle, expire=None, slot=3600):
    """(rows by kind, rows in state after each batch); one file a batch."""
    own, path = state_session(spark), str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    source = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    stream = ordered_sessions(source, delay, idle, expire, slot)
    q = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    )
    q.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
    by = {k: [r for r in out if r.kind == k] for k in ("message", "frame", "reject", "history")}
    return by, [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]


def clock(at):
    return [(0, 0, at, "clock", None, None, None)]


def test_controls_that_arrive_late_govern_the_frames_they_precede(spark, tmp_path):
    rows = session(1, 0, goal="2", reps=3) + session(2, 5 * SEC, goal="0", reps=3)
    rng = random.Random(4)
    rng.shuffle(rows)
    files = [rows[:8], rows[8:9], rows[9:], clock(DAY)]
    by, _ = run(spark, tmp_path, files, "60 seconds", 30, slot=4)
    assert Counter((r.session_id, r.seq) for r in by["message"]) == Counter((r[0], r[1]) for r in rows)
    assert not by["reject"]
    got = {(r.session_id, r.seq): (r.reps, r.done, r.goal) for r in by["frame"]}
    assert [got[1, s] for s in (30, 40, 50, 60, 70)] == [(0, False, 2), (0, False, 2), (1, False, 2), (1, False, 2), (2, True, 2)]
    assert (1, 80) not in got  # the attempt is over
    assert max(v[0] for (s, _), v in got.items() if s == 2) == 3 and not any(v[1] for (s, _), v in got.items() if s == 2)
    assert [(r.session_id, r.series_number, r.note, r.ts_us) for r in by["history"]] == [
        (1, 1, "push-ups: 2 reps", (9 * SEC) + 30 * SEC)
    ]


def test_every_message_is_applied_or_rejected_with_a_reason(spark, tmp_path):
    first, later = session(1, 0), session(1, 1000 * SEC)
    files = [first[:4], first[2:], later, first[3:5] + later[:2], clock(5000 * SEC)]
    by, _ = run(spark, tmp_path, files, "100 seconds", 50)
    given = Counter((r[0], r[1]) for rows in files[:-1] for r in rows)
    assert Counter((r.session_id, r.seq) for r in by["message"] + by["reject"]) == given
    assert max(Counter((r.session_id, r.seq) for r in by["message"]).values()) == 1
    reasons = Counter((r.seq, r.note) for r in by["reject"])
    # repeats of waiting messages, and what came behind the watermark of the third file
    assert reasons == Counter(
        [(r[1], "duplicate") for r in first[2:4]] + [(r[1], "late") for r in first[3:5]] + [(r[1], "duplicate") for r in later[:2]]
    )
    # idle after the first set, seen from the next message, and after the second, seen by the timer alone
    assert [(r.series_number, r.ts_us) for r in sorted(by["history"], key=lambda r: r.ts_us)] == [
        (1, first[-1][2] + 50 * SEC), (2, later[-1][2] + 50 * SEC)
    ]


def test_state_of_ended_sessions_is_dropped(spark, tmp_path):
    files = [[r for s in range(3) for r in session(10 * i + s, i * 10 * DAY)] for i in range(1, 11)]
    by, held = run(spark, tmp_path, files + [clock(200 * DAY)], "3600 seconds", 600, expire=86_400)
    assert len(by["history"]) == 30 and Counter(r.session_id for r in by["message"]) == {10 * i + s: 6 for i in range(1, 11) for s in range(3)}
    assert max(held[5:-1]) <= max(held[:5])  # as many rows after ten batches of new sessions as after five
    assert held[-1] <= held[0]
    # a session that comes back after its end starts anew
    by, _ = run(spark, tmp_path / "again", [session(1, DAY), session(1, 9 * DAY), clock(20 * DAY)], "60 seconds", 600, expire=86_400)
    assert [r.series_number for r in by["history"]] == [1, 1]


def test_every_event_gives_a_message(spark):
    events = spark.read.parquet(f"{BASE}/events.parquet")
    messages = session_messages(spark, BASE).withColumn("n", F.floor(F.col("seq") / 10))
    assert messages.select("session_id", "n").distinct().count() == events.count()
    levels = {r[0] for r in messages.where("type = 'strictness'").select("value").distinct().collect()}
    assert levels == {"strict", "moderate"}


def test_disordered_files_are_out_of_order(spark):
    path, _ = streams.stage_disordered(spark, BASE)
    rows = spark.read.parquet(path).where("type != 'clock'").withColumn("file", F.input_file_name())
    spans = rows.groupBy("session_id", "file").agg(F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"))
    other = spans.toDF("session_id", "file2", "lo2", "hi2")
    assert spans.join(other, "session_id").where("file < file2 and lo < hi2 and lo2 < hi").count() > 0
