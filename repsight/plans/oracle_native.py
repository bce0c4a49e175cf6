"""DuckDB oracle for native pose sessions (adapter F).

In this adapter a session's facing side is constant (user parity), so the
side of every set is that side; the Spark plan resolves it generally.
"""

from __future__ import annotations

from .. import constants as K
from ..operators.exercises import INTEREST_PARTS, part_index
from .oracle import K_EXPR, ORACLE, PUSHUP_MESSAGE, SQUAT_MESSAGE, angle, latch_ctes, np_round, r6, sql

W_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
W_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
DEV_CASE = "CASE rule_strictness " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.STRICTNESS_DEGREES.items()) + " END"

def native_ctes(has_pose: str) -> str:
    """CTEs up to ``seg``, every kept frame; ``has_pose`` tells which events' frames have a pose."""
    return f"""
WITH ev AS (
  SELECT user_id AS session_id, ts, event_type, {K_EXPR} AS k, {K_EXPR} * 180 / 99 AS theta,
         CAST(round(value * 100) AS BIGINT) AS vi, user_id % 2 = 0 AS is_left,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events),
msgs AS (
  SELECT session_id, ts, n * 10 AS seq, 'start' AS type, CAST(NULL AS VARCHAR) AS value,
         NULL::DOUBLE AS theta, NULL::BIGINT AS vi, NULL::BOOLEAN AS is_left, NULL::BOOLEAN AS has_pose
  FROM ev WHERE event_type = 'signup' AND k % 4 = 0
  UNION ALL SELECT session_id, ts, n * 10 + 1, 'workout', 'push-ups', NULL, NULL, NULL, NULL FROM ev WHERE event_type = 'signup' AND k % 4 = 0
  UNION ALL SELECT session_id, ts, n * 10, 'workout', 'squats', NULL, NULL, NULL, NULL FROM ev WHERE event_type = 'signup' AND k % 4 = 1
  UNION ALL SELECT session_id, ts, n * 10, 'strictness', 'strict', NULL, NULL, NULL, NULL FROM ev WHERE event_type = 'signup' AND k % 4 = 2
  UNION ALL SELECT session_id, ts, n * 10, 'strictness', 'moderate', NULL, NULL, NULL, NULL FROM ev WHERE event_type = 'signup' AND k % 4 = 3
  UNION ALL SELECT session_id, ts, n * 10, 'reps', CAST(k % 3 AS VARCHAR), NULL, NULL, NULL, NULL FROM ev WHERE event_type = 'purchase'
  UNION ALL SELECT session_id, ts, n * 10, 'frame', NULL, theta, vi, is_left, {has_pose} FROM ev WHERE event_type IN ('view', 'click', 'error')),
s1 AS (
  SELECT *,
    CAST(sum(CAST(type = 'start' AS INTEGER)) OVER w AS BIGINT) AS attempt,
    CAST(sum(CAST(type = 'workout' AS INTEGER)) OVER w AS BIGINT) AS epoch,
    coalesce(last_value(CASE WHEN type = 'workout' THEN value END IGNORE NULLS) OVER w, 'push-ups') AS exercise,
    coalesce(last_value(CASE WHEN type = 'reps' THEN TRY_CAST(value AS INTEGER) END IGNORE NULLS) OVER w, 0) AS goal,
    coalesce(last_value(CASE WHEN type = 'strictness' THEN lower(value) END IGNORE NULLS) OVER w, 'loose') AS strictness
  FROM msgs WINDOW w AS (PARTITION BY session_id ORDER BY seq {W_RUN})),
s2 AS (
  SELECT *, coalesce(last_value(CASE WHEN type = 'workout' THEN strictness END IGNORE NULLS)
            OVER (PARTITION BY session_id ORDER BY seq {W_RUN}), 'loose') AS rule_strictness
  FROM s1),
pts AS (
  SELECT *, kx + 0.1 AS ax, ky AS ay FROM (
  SELECT *, hx + 0.2 * cos(radians(phi)) AS kx, hy + 0.2 * sin(radians(phi)) AS ky FROM (
  SELECT *, sx + 0.3 AS hx, sy AS hy FROM (
    SELECT *, 0.5 AS ex, 0.55 AS ey, 0.5 AS wx, 0.75 AS wy,
           0.5 + 0.2 * sin(radians(theta)) AS sx, 0.55 + 0.2 * cos(radians(theta)) AS sy,
           (vi % 4000) / 100 + 0.0025 AS phi, 0.95 AS tx, 0.8 AS ty, {DEV_CASE} AS dev
    FROM s2 WHERE type = 'frame' AND attempt > 0)))),
ang AS (
  SELECT *, CASE WHEN exercise = 'push-ups' THEN {angle('wx', 'wy', 'ex', 'ey', 'sx', 'sy')}
                 ELSE {angle('ax', 'ay', 'kx', 'ky', 'hx', 'hy')} END AS rep,
            {angle('sx', 'sy', 'hx', 'hy', 'kx', 'ky')} AS aux
  FROM pts),
ft AS (
  SELECT *,
    NOT ({np_round('wx', 1)} = {np_round('sx', 1)} OR (NOT isnan(rep) AND rep <= {K.ELBOW_THRESHOLD})) AS pb0,
    NOT ({np_round('ky', 2)} < least({np_round('wy', 2)}, {np_round('ty', 2)})) AS pb1,
    NOT (NOT isnan(aux) AND aux > 180 - (dev + 5) AND aux < 180 + (dev + 5)) AS pb2,
    NOT ({np_round('sx', 1)} - {np_round('ax', 1)} < 5) AS shb,
    NOT ({np_round('kx', 1)} - {np_round('ax', 1)} < 5) AS su0,
    NOT (CASE WHEN NOT isnan(rep) AND rep > 150 THEN NOT isnan(aux) AND (180 - aux) < dev ELSE true END) AS su1,
    NOT ({np_round('kx', 1)} - {np_round('tx', 1)} < 5) AS sd0,
    NOT (CASE WHEN NOT isnan(rep) AND rep < 150 AND rep > 90 THEN true
              ELSE NOT isnan(aux) AND 45 - dev < aux AND aux < 90 + dev END) AS sd1
  FROM ang),
ft2 AS (
  SELECT *,
    CASE WHEN exercise = 'push-ups' THEN pb0 ELSE su0 END AS ub0,
    CASE WHEN exercise = 'push-ups' THEN pb1 ELSE su1 END AS ub1,
    CASE WHEN exercise = 'push-ups' THEN pb2 ELSE shb END AS ub2,
    CASE WHEN exercise = 'push-ups' THEN pb0 ELSE sd0 END AS db0,
    CASE WHEN exercise = 'push-ups' THEN pb1 ELSE sd1 END AS db1,
    CASE WHEN exercise = 'push-ups' THEN pb2 ELSE shb END AS db2
  FROM ft),
ft3 AS (SELECT *, NOT (ub0 OR ub1 OR ub2) AS fu, NOT (db0 OR db1 OR db2) AS fd FROM ft2),
fr AS (
  SELECT *, coalesce(lag(fu) OVER w, false) AS pfu, coalesce(lag(fd) OVER w, false) AS pfd
  FROM ft3 WHERE has_pose WINDOW w AS (PARTITION BY session_id, attempt, epoch ORDER BY seq)),
{latch_ctes("fr", "seq", "rep", "pfu", "pfd", "session_id, attempt, epoch", "")},
al AS (SELECT * FROM lt UNION ALL BY NAME SELECT *, false AS rep_inc FROM ft3 WHERE NOT has_pose),
rp AS (
  SELECT * REPLACE (coalesce(last_value(down IGNORE NULLS) OVER (PARTITION BY session_id, attempt, epoch ORDER BY seq {W_RUN}),
                             false) AS down),
         CAST(sum(CAST(rep_inc AS INTEGER)) OVER (PARTITION BY session_id, attempt ORDER BY seq {W_RUN}) AS BIGINT) AS reps
  FROM al),
dn AS (SELECT *, goal > 0 AND reps >= goal AS done FROM rp),
kb AS (
  SELECT *, coalesce(sum(CAST(done AS INTEGER)) OVER (PARTITION BY session_id, attempt ORDER BY seq {W_BEFORE}), 0) AS done_before
  FROM dn),
sn AS (
  SELECT *, CAST(coalesce(sum(CAST(done AS INTEGER)) OVER (PARTITION BY session_id ORDER BY seq {W_BEFORE}), 0) AS BIGINT) AS set_no
  FROM kb WHERE done_before = 0),
seg0 AS (
  SELECT *, set_no + 1 AS series_number,
         CAST(sum(CAST(has_pose AS INTEGER)) OVER (PARTITION BY session_id, set_no ORDER BY seq {W_RUN}) - 1 AS BIGINT) AS frame,
         CASE WHEN down THEN fd ELSE fu END AS form_ok,
         CASE WHEN down THEN db0 ELSE ub0 END AS b0,
         CASE WHEN down THEN db1 ELSE ub1 END AS b1,
         CASE WHEN down THEN db2 ELSE ub2 END AS b2,
         is_left AS left_side
  FROM sn),
seg AS (
  SELECT *, CASE WHEN exercise = 'push-ups' THEN {PUSHUP_MESSAGE} ELSE {SQUAT_MESSAGE} END AS form_issues FROM seg0)
"""


NATIVE = native_ctes("true")
GAPS = native_ctes("event_type <> 'error'")

sql("pose_session_frames", NATIVE + f"""
SELECT session_id, seq, series_number, frame, left_side, down, reps, done, form_ok, form_issues, exercise,
       {r6('rep')} AS rep_angle, {r6('aux')} AS aux_angle
FROM seg
""")


def _interest_text() -> str:
    parts = []
    for ex, names in INTEREST_PARTS.items():
        for left in (True, False):
            side = "L" if left else "R"
            pairs = sorted((part_index(n, side), n) for n in names)
            txt = ",".join(f"{i}:{n}" for i, n in pairs)
            parts.append(f"WHEN s.exercise = '{ex}' AND s.left_side = {str(left).lower()} THEN '{txt}'")
    return "CASE " + " ".join(parts) + " END"


SETS = f"""
, done_sets AS (
  SELECT session_id, series_number, CAST(row_number() OVER (ORDER BY session_id, series_number) AS BIGINT) AS set_id
  FROM seg GROUP BY session_id, series_number HAVING bool_or(done)),
first_rows AS (
  SELECT s.*, d.set_id FROM seg s JOIN done_sets d USING (session_id, series_number)
  QUALIFY row_number() OVER (PARTITION BY s.session_id, s.series_number ORDER BY s.seq) = 1),
starts AS (SELECT session_id, min(ts) AS timestamp_start FROM msgs GROUP BY session_id)
"""

sql("pose_session_sets", NATIVE + SETS + f"""
SELECT s.set_id AS id, s.exercise AS workout_name,
       epoch_us(st.timestamp_start) AS timestamp_start_us, CAST(s.goal AS BIGINT) AS rep_goal,
       CAST(s.series_number AS BIGINT) AS series_number, s.strictness AS strictness_crit,
       CAST(CASE s.strictness {" ".join(f"WHEN '{k}' THEN {v}" for k, v in K.STRICTNESS_DEGREES.items())} END AS DOUBLE)
         AS strictness_definition,
       s.left_side, {_interest_text()} AS ldmrks_of_interest
FROM first_rows s JOIN starts st USING (session_id)
""")

sql("pose_session_summary", NATIVE + SETS + f"""
, wa AS (
  SELECT d.set_id AS workout_id, s.frame, s.ts AS timestamp,
         s.reps AS rep_count, s.form_issues, s.goal
  FROM seg s JOIN done_sets d USING (session_id, series_number)),
wk AS (
  SELECT s.set_id AS id, s.goal AS rep_goal, st.timestamp_start
  FROM first_rows s JOIN starts st USING (session_id)),
sf AS (
  SELECT workout_id, CAST(min(frame) - {K.SETUP_BACKTRACK_FRAMES} AS BIGINT) AS frame_start
  FROM wa WHERE substring(form_issues, 1, 4) = '{K.GOOD_PREFIX}' GROUP BY workout_id),
tr AS (
  SELECT wa.*, sf.frame_start, wk.rep_goal AS goal_set FROM wa JOIN sf USING (workout_id) JOIN wk ON wk.id = wa.workout_id
  WHERE wa.frame >= sf.frame_start),
spans AS (
  SELECT workout_id, round(datediff('microsecond', min(timestamp), max(timestamp)) / 1e6, 1) AS duration
  FROM tr WHERE rep_count + 1 <= goal_set GROUP BY workout_id, rep_count)
SELECT sf.workout_id, sf.frame_start,
       {r6("CAST(printf('%.2f', datediff('microsecond', wk.timestamp_start, e.end_time) / 1e6) AS DOUBLE)")} AS duration,
       t.total_repetitions,
       {r6("round_even(CAST(a.s AS DOUBLE) / (CAST(a.n AS DOUBLE) * 10.0) * 100, 0) / 100")} AS average_time_repetitions
FROM sf JOIN wk ON wk.id = sf.workout_id
LEFT JOIN (SELECT workout_id, max(timestamp) AS end_time FROM wa GROUP BY workout_id) e ON e.workout_id = sf.workout_id
LEFT JOIN (SELECT workout_id, CAST(max(rep_count) AS BIGINT) AS total_repetitions FROM tr GROUP BY workout_id) t
  ON t.workout_id = sf.workout_id
LEFT JOIN (SELECT workout_id, sum(CAST(round(duration * 10) AS BIGINT)) AS s, count(duration) AS n FROM spans GROUP BY workout_id) a
  ON a.workout_id = sf.workout_id
""")


def _rnd(x: str, n: int) -> str:
    s = 10 ** n
    return f"(sign({x}) * floor(abs({x}) * {s} + 0.5) / {s})"


def _coordinates() -> list[tuple[str, str]]:
    """(x, y) of the 33 landmarks."""
    pts = {"elbow": ("ex", "ey"), "wrist": ("wx", "wy"), "shoulder": ("sx", "sy"), "hip": ("hx", "hy"),
           "knee": ("kx", "ky"), "ankle": ("ax", "ay"), "toes": ("tx", "ty")}
    items = []
    for i in range(K.N_LANDMARKS):
        xs, ys = [], []
        for part, (lx, ly) in pts.items():
            li, ri = K.BODY_PART_INDEX[part]
            if i == li:
                xs.append(f"WHEN is_left THEN {lx}")
                ys.append(f"WHEN is_left THEN {ly}")
            if i == ri:
                xs.append(f"WHEN NOT is_left THEN {lx}")
                ys.append(f"WHEN NOT is_left THEN {ly}")
        cx = f"CASE {' '.join(xs)} ELSE 0.5 END" if xs else "0.5"
        cy = f"CASE {' '.join(ys)} ELSE 0.5 END" if ys else "0.5"
        items.append((cx, cy))
    return items


def _landmark_list() -> str:
    return "[" + ", ".join(f"struct_pack(x := {_rnd(x, 4)}, y := {_rnd(y, 4)})" for x, y in _coordinates()) + "]"


def _idx(parts) -> str:
    left = ", ".join(str(part_index(p, "L")) for p in parts)
    right = ", ".join(str(part_index(p, "R")) for p in parts)
    return f"CASE WHEN left_side THEN [{left}] ELSE [{right}] END"


_DISPLAY = f"""CASE WHEN exercise = 'push-ups' THEN [
    struct_pack(name := 'elbow', value := {_rnd('rep', 2)}, joint_indices := {_idx(("wrist", "elbow", "shoulder"))}),
    struct_pack(name := 'body', value := {_rnd('aux', 2)}, joint_indices := {_idx(("shoulder", "hip", "ankle"))})]
  ELSE [
    struct_pack(name := 'knee', value := {_rnd('rep', 2)}, joint_indices := {_idx(("ankle", "knee", "hip"))}),
    struct_pack(name := 'hip', value := {_rnd('aux', 2)}, joint_indices := {_idx(("shoulder", "hip", "knee"))})] END"""

sql("frame_messages", NATIVE + f"""
SELECT session_id, seq, CAST(to_json(struct_pack(
    landmarks := {_landmark_list()},
    rep_count := reps,
    form_ok := form_ok,
    form_message := form_issues,
    display_angles := {_DISPLAY},
    is_down_phase := coalesce(down, false))) AS VARCHAR) AS message
FROM seg
""")

_SUM_X, _SUM_Y = (r6(f"CASE WHEN has_pose THEN list_sum([{', '.join(c)}]) ELSE 0.0 END") for c in zip(*_coordinates()))

sql("frame_responses", GAPS + f"""
SELECT session_id, seq, series_number, done, reps AS rep_count, NOT has_pose OR form_ok AS form_ok,
       CASE WHEN has_pose THEN form_issues ELSE 'Initializing...' END AS form_message, down AS is_down_phase,
       CASE WHEN has_pose THEN {K.N_LANDMARKS} ELSE 0 END::BIGINT AS n_landmarks, {_SUM_X} AS sum_x, {_SUM_Y} AS sum_y,
       CASE WHEN NOT has_pose THEN '' WHEN exercise = 'push-ups' THEN 'elbow,body' ELSE 'knee,hip' END AS angle_names
FROM seg
""")

sql("stream_pose_sessions", ORACLE["pose_session_frames"])


sql("set_ids", NATIVE + SETS + "SELECT session_id, series_number, set_id AS id FROM done_sets")

sql("stream_saved_sets", NATIVE + SETS + f"""
SELECT series_number, workout_name, strictness_crit, left_side, rep_goal, timestamp_start_us, n_frames,
       n_frames AS n_landmarks, reps
FROM (
  SELECT session_id, series_number, first(exercise ORDER BY seq) AS workout_name, first(strictness ORDER BY seq) AS strictness_crit,
         first(left_side ORDER BY seq) AS left_side, CAST(first(goal ORDER BY seq) AS BIGINT) AS rep_goal,
         count(*) AS n_frames, CAST(max(reps) AS BIGINT) AS reps
  FROM seg JOIN done_sets USING (session_id, series_number) GROUP BY session_id, series_number)
JOIN (SELECT session_id, epoch_us(timestamp_start) AS timestamp_start_us FROM starts) USING (session_id)
""")
