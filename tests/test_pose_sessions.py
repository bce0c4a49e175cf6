"""Native pose sessions: the facing side is fixed by each set's first pose frame.

Left and right arms carry different elbow angles, and visibility flips
between frames, so wrong side resolution changes counts and set boundaries.
Each test runs with a pose in every frame, and with a third of them missing.
"""

import math
import random

import pytest
from pyspark.sql import functions as F

from repsight.operators import pose_sessions as PS
from repsight.schemas import POSE


def _pose(theta_l, theta_r, vis13, vis14):
    pts = [(0.5, 0.5, 0.0) for _ in range(33)]
    phi = 0.0025
    for (el, wr, sh, hp, kn, an, to), th in (((13, 15, 11, 23, 25, 27, 31), theta_l), ((14, 16, 12, 24, 26, 28, 32), theta_r)):
        ex, ey = 0.5, 0.55
        sx, sy = ex + 0.2 * math.sin(math.radians(th)), ey + 0.2 * math.cos(math.radians(th))
        hx, hy = sx + 0.3, sy
        kx, ky = hx + 0.2 * math.cos(math.radians(phi)), hy + 0.2 * math.sin(math.radians(phi))
        for idx, (x, y) in ((el, (ex, ey)), (wr, (0.5, 0.75)), (sh, (sx, sy)), (hp, (hx, hy)), (kn, (kx, ky)),
                            (an, (kx + 0.1, ky)), (to, (0.95, 0.8))):
            pts[idx] = (x, y, 0.0)
    pts[13] = (pts[13][0], pts[13][1], vis13)
    pts[14] = (pts[14][0], pts[14][1], vis14)
    return [dict(x=x, y=y, visibility=v) for x, y, v in pts]


def _model(msgs):
    """Sequential loop; frames carry (theta_l, theta_r, left_visible)."""
    goal, active, reps = 0, False, 0
    down, form = False, False
    frame_count, set_no, left = 0, 0, False
    out = []
    for seq, typ, value, payload in sorted(msgs, key=lambda m: m[0]):
        if typ == "workout":
            down, form = False, False
        elif typ == "reps":
            goal = int(value)
        elif typ == "start":
            active, reps = True, 0
        elif typ == "frame" and active:
            if payload is None:  # no pose: the latch, the count and the frame number stay
                out.append(dict(seq=seq, series_number=set_no + 1, frame=None, reps=reps, down=down, form_issues=None))
            else:
                th_l, th_r, left_vis = payload
                if frame_count == 0:
                    left = left_vis
                a = th_l if left else th_r
                if form:
                    if a <= 90:
                        down = True
                    elif a >= 150 and down:
                        down, reps = False, reps + 1
                form = True  # poses are built with good push-up form
                out.append(dict(seq=seq, series_number=set_no + 1, frame=frame_count, reps=reps, down=down, left_side=left))
                frame_count += 1
            if goal > 0 and reps >= goal:
                out[-1]["done"] = True
                active, frame_count, set_no = False, 0, set_no + 1
            else:
                out[-1]["done"] = False
    return out


def _fixture(gaps, seed=5):
    rnd, lost = random.Random(seed), random.Random(seed)
    frames, controls, sessions = [], [], {}
    for sid in range(12):
        msgs = []
        seq = 0
        for _ in range(rnd.randint(20, 90)):
            seq += 2
            r = rnd.random()
            if r < 0.08:
                msgs.append((seq, "start", None, None))
                msgs.append((seq + 1, "workout", "push-ups", None))
            elif r < 0.12:
                msgs.append((seq, "reps", str(rnd.randint(1, 3)), None))
            else:
                payload = (rnd.choice([60.0, 170.0]), rnd.choice([60.0, 170.0]), rnd.random() < 0.5)
                msgs.append((seq, "frame", None, None if gaps and lost.random() < 0.33 else payload))
        sessions[sid] = msgs
        for seq, typ, value, payload in msgs:
            if typ == "frame":
                if payload is None:
                    frames.append((sid, seq, None if seq % 4 else []))
                    continue
                th_l, th_r, lv = payload
                frames.append((sid, seq, _pose(th_l, th_r, 0.9 if lv else 0.1, 0.5)))
            else:
                controls.append((sid, seq, typ, value))
    return frames, controls, sessions


def _compare(got, sessions):
    n = 0
    for sid, msgs in sessions.items():
        for row in _model(msgs):
            g = got.pop((sid, row["seq"]))
            for k in row:
                assert g[k] == row[k], (sid, row["seq"], k, g[k], row[k])
            n += 1
    assert not got and n > 100


@pytest.mark.parametrize("gaps", [False, True])
def test_side_resolution_matches_model(spark, gaps):
    frames, controls, sessions = _fixture(gaps)
    fdf = spark.createDataFrame(frames, f"session_id long, seq long, landmarks {POSE.simpleString()}").withColumn(
        "ts", F.lit(None).cast("timestamp_ntz"))
    cdf = spark.createDataFrame(controls, "session_id long, seq long, type string, value string")
    seg = PS.pose_segments(PS.native_messages(fdf, cdf, chunk_shift=3))
    got = {(r["session_id"], r["seq"]): r.asDict() for r in seg.select(
        "session_id", "seq", "series_number", "frame", "reps", "down", "done", "left_side", "form_issues").collect()}
    _compare(got, sessions)


@pytest.mark.parametrize("gaps", [False, True])
def test_streaming_side_resolution_matches_model(spark, tmp_path, gaps):
    """The same fixture through the streaming processor in two micro-batches."""
    import time

    from repsight.streaming.frames import run_to_table
    from repsight.streaming.pose_sessions import pose_session_stream

    frames, controls, sessions = _fixture(gaps)
    rows = [(sid, seq, "frame", None, lm) for sid, seq, lm in frames] + [
        (sid, seq, typ, value, None) for sid, seq, typ, value in controls]
    df = spark.createDataFrame(rows, f"session_id long, seq long, type string, value string, landmarks {POSE.simpleString()}")
    path = str(tmp_path / "msgs")
    for cond in ("seq < 90", "seq >= 90"):
        df.where(cond).repartition(2, "session_id").write.mode("append").parquet(path)
        time.sleep(1.1)
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)
    out = run_to_table(spark, pose_session_stream(src), f"test-pose-{gaps}")
    got = {(r["session_id"], r["seq"]): r.asDict() for r in out.select(
        "session_id", "seq", "series_number", "frame", "reps", "down", "done", "left_side", "form_issues").collect()}
    _compare(got, sessions)


def test_settings_scan_carries_packed_variants(spark, monkeypatch):
    """The rule variants cross the settings' exchanges and checkpoints as two arrays, not as 50 columns and more."""
    from repsight.operators import pose_sessions as PS
    from repsight.plans.native import native_segments

    seen = []
    scan = PS.settings_asof
    monkeypatch.setattr(PS, "settings_asof", lambda df, chunk: seen.append(df.columns) or scan(df, chunk))
    assert native_segments(spark, "/root/testdata/sf0.001")[0].columns
    assert {"angles", "rules"} < set(seen[0]) and len(seen[0]) <= 12


def test_raw_table_numbers_frames_before_poses(spark, monkeypatch):
    from repsight.plans import sets

    seen, number = [], sets.number_frames
    monkeypatch.setattr(sets, "number_frames", lambda df, *more: seen.append(df.columns) or number(df, *more))
    assert "landmark_0_x" in sets.raw_table(spark, "/root/testdata/sf0.001").columns
    assert "landmarks" not in seen[0]
