"""Session segmentation against a sequential model of the session loop."""

import random

import pytest
from pyspark.sql import functions as F

from models import session_loop
from repsight.operators import sessions as S

SCHEMA = "session_id long, seq long, type string, value string, angle double, form boolean"


def _random_session(rnd: random.Random):
    msgs = []
    seq = 0
    for _ in range(rnd.randint(5, 120)):
        seq += rnd.randint(1, 3)
        r = rnd.random()
        if r < 0.06:
            msgs.append((seq, "start", None, None, None))
            seq += 1
            msgs.append((seq, "workout", rnd.choice(["push-ups", "squats"]), None, None))
        elif r < 0.09:
            msgs.append((seq, "workout", rnd.choice(["push-ups", "squats", None]), None, None))
        elif r < 0.14:
            msgs.append((seq, "reps", rnd.choice(["0", "1", "2", "3", " 2 ", "x", None]), None, None))
        elif r < 0.16:
            msgs.append((seq, "strictness", rnd.choice(["Strict", "loose", None]), None, None))
        else:
            a = rnd.choice([rnd.uniform(0, 180), 90.0, 150.0, float("nan")])
            msgs.append((seq, "frame", None, a, rnd.random() < 0.75))
    return msgs


def _run(spark, sessions, shift=2):
    rows = [(sid, *m) for sid, msgs in sessions.items() for m in msgs]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("chunk", F.shiftright("seq", shift))
    seg = S.segment(df)
    got = seg.select("session_id", "seq", "series_number", "frame", "reps", "down", "done", "exercise", "goal")
    return {(r["session_id"], r["seq"]): r.asDict() for r in got.collect()}


def _compare(got, sessions):
    n = 0
    for sid, msgs in sessions.items():
        for row in session_loop(msgs):
            g = got.pop((sid, row["seq"]))
            for k in ("series_number", "frame", "reps", "down", "done", "exercise", "goal"):
                assert g[k] == row[k], (sid, row["seq"], k, g[k], row[k])
            n += 1
    assert not got, f"extra rows {list(got)[:5]}"
    return n


@pytest.mark.parametrize("seed", [1, 2])
def test_random_sessions(spark, seed):
    rnd = random.Random(seed)
    sessions = {sid: _random_session(rnd) for sid in range(25)}
    assert _compare(_run(spark, sessions), sessions) > 0


def test_edge_sessions(spark):
    up, dn = 170.0, 60.0
    sessions = {
        # goal 0: never completes, all active frames kept
        1: [(1, "start", None, None, None), (2, "workout", "push-ups", None, None)]
        + [(10 + i, "frame", None, a, True) for i, a in enumerate([up, dn, up, dn, up])],
        # two sets in one session
        2: [(1, "reps", "1", None, None), (2, "start", None, None, None), (3, "workout", "squats", None, None)]
        + [(10 + i, "frame", None, a, True) for i, a in enumerate([up, dn, up, up])]
        + [(20, "start", None, None, None), (21, "workout", "squats", None, None)]
        + [(30 + i, "frame", None, a, True) for i, a in enumerate([up, dn, up])],
        # start in mid-set: count restarts, frame numbering continues
        3: [(1, "reps", "2", None, None), (2, "start", None, None, None), (3, "workout", "push-ups", None, None)]
        + [(10 + i, "frame", None, a, True) for i, a in enumerate([up, dn, up])]
        + [(20, "start", None, None, None), (21, "workout", "push-ups", None, None)]
        + [(30 + i, "frame", None, a, True) for i, a in enumerate([up, dn, up, dn, up, up])],
        # exercise change mid-set resets the latch, not the count; bad reps value ignored
        4: [(1, "reps", "2", None, None), (2, "start", None, None, None), (3, "workout", "push-ups", None, None)]
        + [(10, "frame", None, up, True), (11, "frame", None, dn, True), (12, "workout", "squats", None, None),
           (13, "frame", None, up, True), (14, "reps", "abc", None, None), (15, "frame", None, dn, True),
           (16, "frame", None, up, True), (17, "frame", None, dn, True), (18, "frame", None, up, True)],
        # frames before any start are inactive; form lost right before the turn
        5: [(1, "frame", None, dn, True), (2, "reps", "1", None, None), (3, "start", None, None, None),
            (4, "workout", "push-ups", None, None), (5, "frame", None, up, True), (6, "frame", None, dn, True),
            (7, "frame", None, dn, False), (8, "frame", None, up, True), (9, "frame", None, dn, True),
            (10, "frame", None, up, True)],
    }
    got = _run(spark, sessions, shift=1)
    assert _compare(got, sessions) > 0


def test_completed_sets_and_history(spark):
    up, dn = 170.0, 60.0
    msgs = [(1, "reps", "1", None, None), (2, "start", None, None, None), (3, "workout", "squats", None, None)] + [
        (10 + i, "frame", None, a, True) for i, a in enumerate([up, dn, up])
    ] + [(20, "start", None, None, None), (21, "workout", "push-ups", None, None)] + [
        (30 + i, "frame", None, a, True) for i, a in enumerate([up, dn, up])
    ]
    df = spark.createDataFrame([(7, *m) for m in msgs], SCHEMA).withColumn("chunk", F.lit(0).cast("bigint"))
    sets = S.completed_sets(S.segment(df))
    assert sets.count() == 2
    h = S.history_text(sets).first()
    assert h["history"] == "squats: 1 reps\npush-ups: 1 reps\n"
    assert h["history_html"] == "squats: 1 reps<br>push-ups: 1 reps<br>"


def test_emit_changes(spark):
    rows = [(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a"), (2, 1, "b"), (2, 9, "b")]
    df = spark.createDataFrame(rows, "session_id long, seq long, message string").withColumn(
        "chunk", F.shiftright("seq", 1))
    got = sorted((r["session_id"], r["seq"]) for r in S.emit_changes(df, ["session_id"], ["seq"], "chunk", "message").collect())
    assert got == [(1, 1), (1, 3), (1, 5), (2, 1)]


def _write_events(path, rows):
    import datetime as dt
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    at = dt.datetime(2024, 1, 1)
    os.makedirs(path)
    names = ("event_id", "ts", "user_id", "event_type", "props")
    cols = list(zip(*((i, None if m is None else at + dt.timedelta(minutes=m), u, t, f'{{"k":{k}}}') for i, m, u, t, k in rows), strict=True))
    types = (pa.int64(), pa.timestamp("us"), pa.int64(), pa.string(), pa.string())
    table = pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})
    pq.write_table(table, f"{path}/events.parquet")
    return str(path)


def _session_rows(rnd, users, n):
    """Events over 20 days; ids do not follow time (they jump by more than 2^20)."""
    rows = []
    for u in users:
        for m in sorted(rnd.sample(range(20 * 24 * 60), n)):
            t = rnd.choices(["signup", "purchase", "view", "click", "error"], [8, 5, 40, 40, 7])[0]
            rows.append((rnd.randrange(1 << 24), m, u, t, rnd.choice([0, 4, 1, 2, 3, 80, 90, 97]) if t in ("signup", "purchase")
                         else rnd.choice([5, 20, 85, 95])))
    return rows


def test_a_session_is_one_chunk_unless_it_is_hot(spark, tmp_path):
    """chunks are a session's events, not the few of a (session, day); a hot session is split by hours."""
    from repsight.sources import adapters as A

    base = _write_events(tmp_path / "d", [*_session_rows(random.Random(5), [1, 2, 3, None], 60), (1, None, 1, "view", 5)])
    assert A.session_messages(spark, base).where("session_id is not null and chunk is not null").select(
        "session_id", "chunk").distinct().count() == 3
    ev = A.read_table(spark, base, "events").withColumnRenamed("user_id", "session_id")
    got = A.session_chunk(ev.where("session_id in (1, 2) or session_id is null").union(ev.where("session_id = 2")), max_rows=100)
    chunks = {r["session_id"]: (r["n"], r["e"]) for r in got.groupBy("session_id").agg(
        F.countDistinct("chunk").alias("n"), F.sum(F.col("chunk").isNull().cast("int")).alias("e")).collect()}
    assert chunks[1] == (1, 1) and chunks[2][0] > 20 and chunks[None][0] > 20
    hot = got.where("session_id = 2").orderBy("ts", "event_id").select("chunk").collect()
    assert [r[0] for r in hot] == sorted(r[0] for r in hot)


def test_rolling_summary_of_sessions_in_many_chunks(spark, tmp_path, monkeypatch):
    """hot and plain sessions give the sequential model's sets, in few passes over the frames."""
    from repsight import constants as K
    from repsight.operators import scan
    from repsight.plans import text
    from repsight.sources import adapters as A

    base = _write_events(tmp_path / "d", _session_rows(random.Random(8), range(12), 150))
    plain = sorted(map(tuple, text.rolling_summary(spark, base).collect()))
    passes, one = [], scan.checkpoint
    monkeypatch.setattr(scan, "checkpoint", lambda df, keep_partitioning=False: passes.append(keep_partitioning) or one(df, keep_partitioning))
    whole = A.session_chunk
    monkeypatch.setattr(A, "session_chunk", lambda ev: whole(ev, max_rows=10))
    assert sorted(map(tuple, text.rolling_summary(spark, base).collect())) == plain
    assert sum(passes) == 3  # settings, latch, sets: each holds the rows once

    msgs = {}
    for r in A.session_messages(spark, base).orderBy("session_id", "seq").collect():
        msgs.setdefault(r["session_id"], []).append((r["seq"], r["type"], r["value"], r["angle"], r["form"]))
    want = []
    for sid, m in msgs.items():
        done, previous = [r for r in session_loop(m) if r["done"]], K.FIRST_ROLLING_SUMMARY
        for r in done:
            want.append((sid, r["series_number"], previous))
            if r["reps"] % 4 != 3:
                previous = f"After set {r['series_number']}: {r['reps']} {r['exercise']}."
    assert len(want) > 12 and plain == sorted(want)
