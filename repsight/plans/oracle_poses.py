"""DuckDB oracle for the pose queries (adapters B and D)."""

from __future__ import annotations

from .. import constants as K
from ..operators.exercises import part_index
from .oracle import (
    EVENT_BASE,
    PUSHUP_MESSAGE,
    SQUAT_MESSAGE,
    angle,
    pose_state_ctes,
    pushup_features_sql,
    pushup_state_sql,
    r6,
    sql,
    squat_features_sql,
)


def ex(i: int) -> str:
    return f"(0.5 + CAST(embedding[{(2 * i) % 64 + 1}] AS DOUBLE))"


def ey(i: int) -> str:
    return f"(0.5 + CAST(embedding[{(2 * i + 1) % 64 + 1}] AS DOUBLE))"


EMB = """
WITH emb AS (
  SELECT CAST(label AS BIGINT) AS workout_id, vec_id, embedding,
         CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS frame
  FROM embeddings)
"""


def ang(i1: int, i2: int, i3: int) -> str:
    return angle(ex(i1), ey(i1), ex(i2), ey(i2), ex(i3), ey(i3))


_specs = [("elbow", ("wrist", "elbow", "shoulder")), ("knee", ("ankle", "knee", "hip")), ("hip", ("shoulder", "hip", "knee"))]
_cols = []
for side, label in (("L", "left"), ("R", "right")):
    for name, joints in _specs:
        ix = [part_index(p, side) for p in joints]
        _cols.append(f"{r6(ang(*ix))} AS {label}_{name}")
sql("joint_angles", EMB + f"SELECT workout_id, frame, {', '.join(_cols)} FROM emb")

sql("side_detection", """
SELECT user_id AS workout_id,
       arg_min(CASE WHEN user_id % 2 = 0 THEN 0.9 ELSE 0.2 END > 0.5, ts) AS left_side
FROM events GROUP BY user_id
""")

_parts = []
_ctes = []
for exn, feats, msg in (("push-ups", pushup_features_sql, PUSHUP_MESSAGE), ("squats", squat_features_sql, SQUAT_MESSAGE)):
    for level, dev in K.STRICTNESS_DEGREES.items():
        p = f"{'p' if exn == 'push-ups' else 's'}{level[0]}_"
        _ctes.append(pose_state_ctes(feats(EVENT_BASE, p, str(dev)), msg, p))
        _parts.append(
            f"SELECT '{exn}' AS exercise, '{level}' AS strictness, CAST(sum(frames) AS BIGINT) AS frames, "
            f"CAST(sum(good) AS BIGINT) AS good_frames, CAST(sum(reps) AS BIGINT) AS reps FROM ("
            f"SELECT workout_id, count(*) AS frames, count(*) FILTER (WHERE form_ok) AS good, max(rep_count) AS reps "
            f"FROM {p}st GROUP BY workout_id)"
        )
sql("strictness_sweep", "WITH " + ",\n".join(_ctes) + "\n" + "\nUNION ALL ".join(_parts))

_wide = []
for i in range(K.N_LANDMARKS):
    _wide.append(f"{ex(i)} AS landmark_{i}_x, {ey(i)} AS landmark_{i}_y")
sql("landmarks_wide", EMB + f"SELECT workout_id, frame, {', '.join(_wide)} FROM emb")


def _idx_text(parts: tuple[str, ...]) -> str:
    left = ",".join(str(part_index(p, "L")) for p in parts)
    right = ",".join(str(part_index(p, "R")) for p in parts)
    return f"CASE WHEN left_side THEN '{left}' ELSE '{right}' END"


sql("angles_json_roundtrip", pushup_state_sql("loose") + f"""
SELECT workout_id, frame, 'elbow' AS name, {r6('rep')} AS value, {_idx_text(("wrist", "elbow", "shoulder"))} AS joint_indices FROM st
UNION ALL
SELECT workout_id, frame, 'body', {r6('aux')}, {_idx_text(("shoulder", "hip", "ankle"))} FROM st
""")

_dim = ", ".join(
    f"({i}, {'NULL' if s is None else repr(s)}, {n!r})" for i, s, n in K.LANDMARK_DIMENSION
)
_unnest = "\nUNION ALL ".join(f"SELECT {i} AS idx, {ex(i)} AS x, {ey(i)} AS y FROM embeddings" for i in range(K.N_LANDMARKS))
sql("landmark_dimension", f"""
WITH dim(idx, side, name) AS (VALUES {_dim}),
lm AS ({_unnest})
SELECT CAST(lm.idx AS BIGINT) AS "index", dim.side, dim.name, count(*) AS frames,
       {r6('avg(x)')} AS mean_x, {r6('avg(y)')} AS mean_y
FROM lm JOIN dim ON dim.idx = lm.idx GROUP BY lm.idx, dim.side, dim.name
""")

W, H = 640.0, 480.0
_segs = "\nUNION ALL ".join(
    f"SELECT workout_id, frame, CAST({a} AS BIGINT) AS src, CAST({b} AS BIGINT) AS dst, "
    f"{r6(f'{ex(a)} * {W}')} AS x1, {r6(f'{ey(a)} * {H}')} AS y1, {r6(f'{ex(b)} * {W}')} AS x2, {r6(f'{ey(b)} * {H}')} AS y2 FROM emb"
    for a, b in K.SKELETON_EDGES
)
sql("skeleton_segments", EMB + _segs)

# Embedding poses carry visibility 0 everywhere: equal visibilities -> right side.
_R = {p: part_index(p, "R") for p in K.BODY_PART_INDEX}


def _overlay(name: str, value: str, j: tuple[int, int, int]) -> str:
    a, b, c = j
    cx, cy = f"({ex(b)} * {W})", f"({ey(b)} * {H})"
    start = f"atan2({ey(a)} * {H} - {cy}, {ex(a)} * {W} - {cx})"
    end = f"atan2({ey(c)} * {H} - {cy}, {ex(c)} * {W} - {cx})"
    return (f"SELECT workout_id, frame, '{name}' AS name, {r6(cx)} AS cx, {r6(cy)} AS cy, {r6(start)} AS start_rad, "
            f"{r6(end)} AS end_rad, '{name}: ' || CAST(CAST(floor({value} + 0.5) AS BIGINT) AS VARCHAR) || '°' AS label FROM emb")


sql("overlay_angles", EMB + _overlay("elbow", ang(_R["wrist"], _R["elbow"], _R["shoulder"]),
                                     (_R["wrist"], _R["elbow"], _R["shoulder"]))
    + "\nUNION ALL " + _overlay("body", ang(_R["shoulder"], _R["hip"], _R["knee"]), (_R["shoulder"], _R["hip"], _R["ankle"])))

T = K.LETTERBOX_TARGET
sql("letterbox", f"""
SELECT vec_id, CAST(width AS BIGINT) AS width, CAST(height AS BIGINT) AS height,
       CAST(CASE WHEN height > width THEN floor(width * ({T} / height)) ELSE {T} END AS BIGINT) AS new_w,
       CAST(CASE WHEN height > width THEN {T} ELSE floor(height * ({T} / width)) END AS BIGINT) AS new_h,
       CAST(CASE WHEN height > width THEN floor(({T} - floor(width * ({T} / height))) / 2) ELSE 0 END AS BIGINT) AS x_off,
       CAST(CASE WHEN height > width THEN 0 ELSE floor(({T} - floor(height * ({T} / width))) / 2) END AS BIGINT) AS y_off
FROM (SELECT vec_id, 320 + (vec_id % 7) * 160 AS width, 240 + (label % 5) * 120 AS height FROM embeddings)
""")
