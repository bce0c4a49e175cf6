"""Pose states: several strictness levels in one pass, features computed once."""

import random

import pytest
from pyspark.sql import functions as F

from repsight import constants as K
from repsight.operators import reps
from repsight.schemas import POSE

SMALL = "/root/testdata/sf0.001"
LEVELS = list(K.STRICTNESS_DEGREES)


def _poses(spark):
    rnd = random.Random(5)
    rows = []
    for key in [*range(6), None]:
        for seq in range(40):
            pose = [(rnd.choice([0.1, 0.45, 0.5, 0.52, 0.9]), rnd.random(), rnd.random()) for _ in range(33)]
            if rnd.random() < 0.1:
                pose = [(None, 0.5, None)] * 33
            rows.append((key, seq, seq >> 3, pose))
    return spark.createDataFrame(rows, f"workout_id long, seq long, chunk long, landmarks {POSE.simpleString()}")


@pytest.mark.parametrize("exercise", ["push-ups", "squats"])
def test_levels_equal_single_states(spark, exercise):
    poses = _poses(spark)
    both = reps.pose_level_states(poses, ["workout_id"], ["seq"], exercise, LEVELS)
    for level in LEVELS:
        names = ["down", "rep_count", "form_ok", "form_issues"]
        one = reps.pose_frame_state(poses, ["workout_id"], ["seq"], exercise, level)
        want = one.select("workout_id", "seq", "frame", "left_side", *names)
        got = both.select("workout_id", "seq", "frame", "left_side", *[F.col(f"{n}_{level}").alias(n) for n in names])
        assert got.count() == 280 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_sweep_reads_poses_of_an_exercise_once(spark, monkeypatch):
    from repsight.plans import poses

    calls = []
    for name in ("pushup_poses", "squat_poses"):
        of = getattr(poses.A, name)
        monkeypatch.setattr(poses.A, name, lambda s, b, name=name, of=of: calls.append(name) or of(s, b))
    assert poses.strictness_sweep(spark, SMALL).count() == 6
    assert calls == ["pushup_poses", "squat_poses"]


def test_features_are_held_before_they_are_read_twice(spark, monkeypatch):
    seen, number = [], reps.number_frames
    monkeypatch.setattr(reps, "number_frames", lambda *a, **k: seen.append(k.get("materialize")) or number(*a, **k))
    reps.pose_frame_state(_poses(spark), ["workout_id"], ["seq"], "squats", "loose")
    assert seen == [True]


def test_set_pose_is_one_array(spark):
    """Both exercises' poses share one array, so its projection stays short enough for the JVM to compile."""
    from repsight.sources import adapters as A

    plan = A.set_poses(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AS landmarks") == 1 and plan.count("SIN(RADIANS(theta") <= 2
