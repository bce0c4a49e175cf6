"""DuckDB oracle for the set tables and the analytics pack."""

from __future__ import annotations

from .. import constants as K
from ..operators.exercises import DISPLAY_ANGLES, INTEREST_PARTS, part_index
from .oracle import (
    K_EXPR,
    PUSHUP_MESSAGE,
    SQUAT_MESSAGE,
    pose_state_ctes,
    pushup_features_sql,
    r6,
    sql,
    squat_features_sql,
)

DEV_CASE = ("CAST(CASE strictness " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.STRICTNESS_DEGREES.items())
            + " END AS DOUBLE)")

SETS_BASE = f"""
SELECT *, {DEV_CASE} AS dev FROM (
  SELECT user_id AS workout_id, ts, event_id,
         {K_EXPR} * 180 / 99 AS theta,
         CAST(round(value * 100) AS BIGINT) AS vi,
         user_id % 2 = 0 AS is_left,
         CASE WHEN (user_id // 2) % 2 = 0 THEN 'push-ups' ELSE 'squats' END AS exercise,
         ['loose', 'moderate', 'strict'][user_id % 3 + 1] AS strictness,
         CAST(3 + user_id % 5 AS INTEGER) AS rep_goal
  FROM events)
"""

STATE_COLS = ("workout_id, ts, event_id, exercise, strictness, dev, rep_goal, is_left, left_side, frame, "
              "rep, aux, down, rep_count, form_ok, form_issues")


def _interest_text_case() -> str:
    parts = []
    for ex, names in INTEREST_PARTS.items():
        for left in (True, False):
            side = "L" if left else "R"
            pairs = sorted((part_index(n, side), n) for n in names)
            txt = ",".join(f"{i}:{n}" for i, n in pairs)
            parts.append(f"WHEN exercise = '{ex}' AND left_side = {str(left).lower()} THEN '{txt}'")
    return "CASE " + " ".join(parts) + " END"


def _index_names_case(name: str) -> str:
    """Text of the body-part names of angle ``name``'s joints for each exercise/side."""
    parts = []
    for ex, specs in DISPLAY_ANGLES.items():
        for n, _feat, joints in specs:
            if n != name:
                continue
            for left in (True, False):
                txt = ",".join(joints)
                parts.append(f"WHEN exercise = '{ex}' AND left_side = {str(left).lower()} THEN '{txt}'")
    return "CASE " + " ".join(parts) + " END" if parts else "NULL"


def _angle_value_case(name: str) -> str:
    parts = []
    for ex, specs in DISPLAY_ANGLES.items():
        for n, feat, _joints in specs:
            if n == name:
                parts.append(f"WHEN exercise = '{ex}' THEN {feat}")
    return "CASE " + " ".join(parts) + " END"


ANGLE_NAMES = []
for _specs in DISPLAY_ANGLES.values():
    for _n, _f, _j in _specs:
        if _n not in ANGLE_NAMES:
            ANGLE_NAMES.append(_n)

TRIMMED = f"""sf AS (
  SELECT workout_id, CAST(min(frame) - {K.SETUP_BACKTRACK_FRAMES} AS BIGINT) AS frame_start
  FROM wa WHERE substring(form_issues, 1, 4) = '{K.GOOD_PREFIX}' GROUP BY workout_id),
tr AS (
  SELECT wa.*, sf.frame_start, wk.rep_goal
  FROM wa JOIN sf USING (workout_id) JOIN wk ON wk.id = wa.workout_id
  WHERE wa.frame >= sf.frame_start)
"""

SET_CTES = f"""
WITH sb AS ({SETS_BASE}),
{pose_state_ctes(pushup_features_sql("SELECT * FROM sb WHERE exercise = 'push-ups'", "p_", "dev"), PUSHUP_MESSAGE, "p_")},
{pose_state_ctes(squat_features_sql("SELECT * FROM sb WHERE exercise = 'squats'", "s_", "dev"), SQUAT_MESSAGE, "s_")},
st AS (SELECT {STATE_COLS} FROM p_st UNION ALL SELECT {STATE_COLS} FROM s_st),
wk AS (
  SELECT workout_id AS id, any_value(exercise) AS workout_name, min(ts) AS timestamp_start,
         any_value(rep_goal) AS rep_goal, 1 AS series_number, any_value(strictness) AS strictness_crit,
         any_value(dev) AS strictness_definition, any_value(left_side) AS left_side,
         any_value({_interest_text_case()}) AS ldmrks_of_interest
  FROM st GROUP BY workout_id),
wa AS (
  SELECT workout_id, frame, ts AS timestamp, rep_count, down, form_issues, exercise, left_side,
         {", ".join(f"{_angle_value_case(n)} AS {n}_value" for n in ANGLE_NAMES)}
  FROM st),
{TRIMMED}"""

ISSUE = f"NOT (form_issues LIKE '{K.GOOD_LABEL_EXACT}')"

sql("start_frame", SET_CTES + "SELECT workout_id, frame_start FROM sf")

sql("set_metadata", SET_CTES + f"""
SELECT wk.id, workout_name, epoch_us(timestamp_start) AS timestamp_start_us,
       CAST(rep_goal AS BIGINT) AS rep_goal, CAST(series_number AS BIGINT) AS series_number,
       strictness_crit, strictness_definition, left_side, ldmrks_of_interest,
       epoch_us(e.end_time) AS end_time_us,
       {r6("CAST(printf('%.2f', datediff('microsecond', timestamp_start, e.end_time) / 1e6) AS DOUBLE)")} AS duration
FROM wk LEFT JOIN (SELECT workout_id, max(timestamp) AS end_time FROM wa GROUP BY workout_id) e
  ON e.workout_id = wk.id
""")

sql("landmark_index_by_part", SET_CTES + """
SELECT id, split_part(entry, ':', 2) AS body_part, CAST(split_part(entry, ':', 1) AS BIGINT) AS landmark
FROM (SELECT id, unnest(string_split(ldmrks_of_interest, ',')) AS entry FROM wk)
""")

sql("total_reps", SET_CTES + """
SELECT workout_id, CAST(max(rep_count) AS BIGINT) AS total_repetitions FROM tr GROUP BY workout_id
""")

REP_SPANS = """
SELECT workout_id, CAST(min(frame) AS BIGINT) AS start_frame, CAST(max(frame) AS BIGINT) AS end_frame,
       CAST(rep_count + 1 AS BIGINT) AS repetitions,
       round(datediff('microsecond', min(timestamp), max(timestamp)) / 1e6, 1) AS duration
FROM tr WHERE rep_count + 1 <= rep_goal GROUP BY workout_id, rep_count
"""

sql("rep_spans", SET_CTES + f"""
SELECT workout_id, start_frame, end_frame, repetitions, {r6("duration")} AS duration FROM ({REP_SPANS})
""")

sql("avg_rep_time", SET_CTES + f"""
SELECT workout_id,
       {r6("round_even(CAST(sum(CAST(round(duration * 10) AS BIGINT)) AS DOUBLE) / (CAST(count(duration) AS DOUBLE) * 10.0) * 100, 0) / 100")}
         AS average_time_repetitions
FROM ({REP_SPANS}) GROUP BY workout_id
""")

sql("issue_histogram", SET_CTES + """
SELECT workout_id, form_issues, count(*) AS count FROM tr GROUP BY workout_id, form_issues
""")

sql("issue_frames", SET_CTES + f"""
SELECT workout_id, form_issues, CAST(min(frame) AS BIGINT) AS first_frame, CAST(max(frame) AS BIGINT) AS last_frame,
       count(*) AS frames
FROM (SELECT *, frame - row_number() OVER (PARTITION BY workout_id, form_issues ORDER BY frame) AS run
      FROM tr WHERE {ISSUE})
GROUP BY workout_id, form_issues, run
""")

WORST = f"""
SELECT workout_id, repetitions, count,
       row_number() OVER (PARTITION BY workout_id ORDER BY count DESC, repetitions ASC) AS rank
FROM (SELECT workout_id, CAST(rep_count + 1 AS BIGINT) AS repetitions, count(form_issues) AS count
      FROM tr WHERE {ISSUE} GROUP BY workout_id, rep_count)
QUALIFY rank <= 3
"""
sql("worst_reps", SET_CTES + WORST)

sql("angle_names", SET_CTES + f"""
SELECT array_to_string(list_sort(list(DISTINCT name)), ',') AS angle_names
FROM (SELECT unnest([{", ".join(f"CASE WHEN {n}_value IS NOT NULL THEN '{n}' END" for n in ANGLE_NAMES)}]) AS name FROM wa)
WHERE name IS NOT NULL
""")


def _pivot(where: str) -> str:
    cols = []
    for n in ANGLE_NAMES:
        cols.append(f"{r6(f'CASE WHEN {n}_value IS NOT NULL THEN sign({n}_value) * floor(abs({n}_value) * 100 + 0.5) / 100 END')} AS {n}_angle")
        cols.append(f"CASE WHEN {n}_value IS NOT NULL THEN {_index_names_case(n)} END AS {n}_indices")
    return f"SELECT workout_id, CAST(frame AS BIGINT) AS frame, {', '.join(cols)} FROM tr WHERE {where}"


sql("angle_pivot_issues", SET_CTES + _pivot(ISSUE))
sql("angle_pivot_all", SET_CTES + _pivot("true"))


def _stats(long_src: str, scale: str = "100") -> str:
    vi = f"CAST(round(value * ({scale})) AS BIGINT)"
    n = f"count({vi})"
    mean = f"CAST(sum({vi}) AS DOUBLE) / (CAST({n} AS DOUBLE) * max({scale}))"
    var = (f"CAST({n} * sum(CAST({vi} AS HUGEINT) * CAST({vi} AS HUGEINT)) - sum(CAST({vi} AS HUGEINT)) * sum(CAST({vi} AS HUGEINT)) AS DOUBLE)"
           f" / CAST({n} * ({n} - 1) AS DOUBLE)")
    std = f"CASE WHEN {n} > 1 THEN sqrt({var}) / max({scale}) END"
    return f"""
SELECT workout_id, "column", {n} AS count,
       {r6(mean)} AS mean, {r6(std)} AS std, {r6("min(value)")} AS min,
       {r6("quantile_cont(value, 0.25)")} AS p25, {r6("quantile_cont(value, 0.5)")} AS p50,
       {r6("quantile_cont(value, 0.75)")} AS p75, {r6("max(value)")} AS max
FROM ({long_src}) GROUP BY workout_id, "column"
"""


_PIV_ALL = _pivot("true")
_ANGLE_LONG = f"""
SELECT workout_id, 'frame' AS "column", CAST(frame AS DOUBLE) AS value, 1 AS scale FROM ({_PIV_ALL})
""" + "".join(
    f"""UNION ALL SELECT workout_id, '{n}_angle', {n}_angle_raw, 100 FROM (
  SELECT workout_id, CASE WHEN {n}_value IS NOT NULL THEN sign({n}_value) * floor(abs({n}_value) * 100 + 0.5) / 100 END AS {n}_angle_raw
  FROM tr)
"""
    for n in ANGLE_NAMES
)
sql("angle_stats", SET_CTES + _stats(_ANGLE_LONG, "scale"))


def _interest_long() -> str:
    """Rounded coordinates of the landmarks of interest, from the set poses."""
    rows = []
    for ex, names in INTEREST_PARTS.items():
        for left in (True, False):
            side = "L" if left else "R"
            for n in names:
                idx = part_index(n, side)
                for axis in ("x", "y"):
                    rows.append(
                        f"SELECT workout_id, frame, '{n}_{axis}' AS \"column\", "
                        f"sign(landmark_{idx}_{axis}) * floor(abs(landmark_{idx}_{axis}) * 100 + 0.5) / 100 AS value "
                        f"FROM rl WHERE exercise = '{ex}' AND left_side = {str(left).lower()}"
                    )
    return "\nUNION ALL ".join(rows)


def _raw_landmarks_cte() -> str:
    """Wide landmark rows of the set poses (same geometry as the pose CTEs)."""
    pts = {
        "push-ups": {"elbow": ("ex", "ey"), "wrist": ("wx", "wy"), "shoulder": ("sx", "sy"), "hip": ("hx", "hy"),
                     "knee": ("kx", "ky"), "ankle": ("kx + 0.1", "ky"), "toes": ("tx", "ty")},
        "squats": {"ankle": ("ax", "ay"), "knee": ("kx", "ky"), "hip": ("hx", "hy"), "shoulder": ("sx", "sy"),
                   "toes": ("tx", "ty")},
    }
    selects = []
    for ex, pre in (("push-ups", "p_"), ("squats", "s_")):
        cols = []
        for i in range(K.N_LANDMARKS):
            xs, ys = [], []
            for part, (lx, ly) in pts[ex].items():
                li, ri = K.BODY_PART_INDEX[part]
                if i == li:
                    xs.append(f"WHEN is_left THEN {lx}")
                    ys.append(f"WHEN is_left THEN {ly}")
                if i == ri:
                    xs.append(f"WHEN NOT is_left THEN {lx}")
                    ys.append(f"WHEN NOT is_left THEN {ly}")
            cx = f"CASE {' '.join(xs)} ELSE 0.5 END" if xs else "0.5"
            cy = f"CASE {' '.join(ys)} ELSE 0.5 END" if ys else "0.5"
            cols.append(f"{cx} AS landmark_{i}_x, {cy} AS landmark_{i}_y")
        selects.append(
            f"SELECT workout_id, exercise, left_side, frame, {', '.join(cols)} FROM {pre}st"
        )
    return " UNION ALL ".join(selects)


_LM_LONG = f"""
WITH rl AS ({_raw_landmarks_cte()})
SELECT l.* FROM ({_interest_long()}) l JOIN sf USING (workout_id) WHERE l.frame >= sf.frame_start
"""
# the interest rows need the CTEs of SET_CTES; inline them as a sub-select
sql("landmark_stats", SET_CTES + ", rl AS (" + _raw_landmarks_cte() + ")" + _stats(
    f"SELECT l.* FROM ({_interest_long()}) l JOIN sf USING (workout_id) WHERE l.frame >= sf.frame_start"))
sql("landmarks_of_interest", SET_CTES + ", rl AS (" + _raw_landmarks_cte() + ")" + f"""
SELECT l.workout_id, CAST(l.frame AS BIGINT) AS frame, l."column", {r6("l.value")} AS value
FROM ({_interest_long()}) l JOIN sf USING (workout_id) WHERE l.frame >= sf.frame_start
""")
