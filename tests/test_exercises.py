import math
import random

import pytest
from pyspark.sql import functions as F

from models import angle_deg
from repsight import constants as K
from repsight.operators import exercises as X
from repsight.schemas import POSE


def _pose(vis13=0.0, vis14=0.0, n=33, points=None):
    pts = [(0.5, 0.5, 0.0) for _ in range(n)]
    if n > 14:
        pts[13] = (0.5, 0.5, vis13)
        pts[14] = (0.5, 0.5, vis14)
    for i, (x, y) in (points or {}).items():
        pts[i] = (x, y, pts[i][2])
    return [dict(x=x, y=y, visibility=v) for x, y, v in pts]


@pytest.mark.parametrize("v13,v14,left", [(0.75, 0.23, True), (0.25, 0.63, False), (0.5, 0.5, False)])
def test_side_detection_golden(spark, v13, v14, left):
    df = spark.createDataFrame([(_pose(v13, v14),)], f"landmarks {POSE.simpleString()}")
    assert df.select(X.side_flag(F.col("landmarks")).alias("l")).first()["l"] is left


def test_side_detection_short_pose_is_null(spark):
    df = spark.createDataFrame([(_pose(n=12),), ([],)], f"landmarks {POSE.simpleString()}")
    got = [r["l"] for r in df.select(X.side_flag(F.col("landmarks")).alias("l")).collect()]
    assert got == [None, None]


def _ref_pushup(p, side, dev):
    ix = {k: (v[0] if side == "L" else v[1]) for k, v in K.BODY_PART_INDEX.items()}
    g = lambda k: p[ix[k]]
    elbow = angle_deg(g("wrist"), g("elbow"), g("shoulder"))
    body = angle_deg(g("shoulder"), g("hip"), g("knee"))
    import numpy as np

    body_ok = body > 180 - (dev + 5) and body < 180 + dev + 5
    sh_ok = np.round(g("wrist")[0], 1) == np.round(g("shoulder")[0], 1) or elbow <= 165
    kn_ok = np.round(g("knee")[1], 2) < min(np.round(g("wrist")[1], 2), np.round(g("toes")[1], 2))
    issues = []
    if not sh_ok:
        issues.append(K.PUSHUP_MSG_SHOULDERS)
    if not kn_ok:
        issues.append(K.PUSHUP_MSG_KNEES)
    if not body_ok:
        issues.append(K.PUSHUP_MSG_BODY)
    return elbow, body, (", ".join(issues) if issues else K.PUSHUP_GOOD)


def test_pushup_rules_random_poses(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(200):
        pts = {j: (rnd.uniform(0, 1), rnd.uniform(0, 1)) for j in range(33)}
        rows.append((i, _pose(points=pts), rnd.choice(list(K.STRICTNESS_DEGREES))))
    df = spark.createDataFrame(rows, f"id long, landmarks {POSE.simpleString()}, strictness string")
    f = X.with_features(df, F.lit("push-ups"), X.deviation_of(F.col("strictness")))
    got = f.select(
        "id", "landmarks", "strictness", "rep_R", "aux_R", "iu_R",
        X.pushup_message(F.col("iu_R")).alias("msg"),
    ).collect()
    for r in got:
        pts = [(lm["x"], lm["y"]) for lm in r["landmarks"]]
        elbow, body, msg = _ref_pushup(pts, "R", K.STRICTNESS_DEGREES[r["strictness"]])
        assert r["rep_R"] == pytest.approx(elbow, abs=1e-9) or (math.isnan(elbow) and math.isnan(r["rep_R"]))
        assert r["aux_R"] == pytest.approx(body, abs=1e-9) or (math.isnan(body) and math.isnan(r["aux_R"]))
        assert r["msg"] == msg


def test_unknown_strictness_is_null(spark):
    df = spark.createDataFrame([("LOOSE",), ("extreme",)], "s string")
    got = [r["d"] for r in df.select(X.deviation_of(F.col("s")).alias("d")).collect()]
    assert got == [15.0, None]


def test_registry_views_are_consistent():
    assert set(X.REGISTRY) == set(K.EXERCISES)
    for name, spec in X.REGISTRY.items():
        assert X.COMPUTE_TRIPLES[name] == {"rep": spec.rep, "aux": spec.aux}
        assert [d[0] for d in X.DISPLAY_ANGLES[name]] == [d[0] for d in spec.display]
        assert all(p in K.BODY_PART_INDEX for p in spec.interest)
