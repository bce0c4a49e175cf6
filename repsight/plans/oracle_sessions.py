"""DuckDB oracle for the session queries (adapter E)."""

from __future__ import annotations

from .. import constants as K
from .oracle import K_EXPR, latch_ctes, r6, sql

MESSAGES = f"""
ev AS (
  SELECT user_id AS session_id, event_type, {K_EXPR} AS k, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events),
msgs AS (
  SELECT session_id, n * 10 AS seq, 'start' AS type, CAST(NULL AS VARCHAR) AS value,
         CAST(NULL AS DOUBLE) AS angle, CAST(NULL AS BOOLEAN) AS form, ts
  FROM ev WHERE event_type = 'signup' AND k % 4 = 0
  UNION ALL SELECT session_id, n * 10 + 1, 'workout', 'push-ups', NULL, NULL, ts FROM ev
    WHERE event_type = 'signup' AND k % 4 = 0
  UNION ALL SELECT session_id, n * 10, 'workout', 'squats', NULL, NULL, ts FROM ev
    WHERE event_type = 'signup' AND k % 4 = 1
  UNION ALL SELECT session_id, n * 10, 'strictness', CASE WHEN k % 4 = 2 THEN 'strict' ELSE 'moderate' END, NULL, NULL, ts FROM ev
    WHERE event_type = 'signup' AND (k IS NULL OR k % 4 > 1)
  UNION ALL SELECT session_id, n * 10, 'reps', CAST(k % 3 AS VARCHAR), NULL, NULL, ts FROM ev
    WHERE event_type = 'purchase'
  UNION ALL SELECT session_id, n * 10, 'frame', NULL, k * 180 / 99, event_type <> 'error', ts FROM ev
    WHERE event_type IN ('view', 'click', 'error'))
"""

W_RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
W_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

SETTINGS = f"""
s1 AS (
  SELECT *,
    CAST(sum(CAST(type = 'start' AS INTEGER)) OVER w AS BIGINT) AS attempt,
    CAST(sum(CAST(type = 'workout' AS INTEGER)) OVER w AS BIGINT) AS epoch,
    coalesce(last_value(CASE WHEN type = 'workout' THEN coalesce(value, '{K.CONTROL_DEFAULTS["workout"]}') END
             IGNORE NULLS) OVER w, '{K.INITIAL_EXERCISE}') AS exercise,
    coalesce(last_value(CASE WHEN type = 'reps' THEN TRY_CAST(trim(coalesce(value, '{K.CONTROL_DEFAULTS["reps"]}')) AS INTEGER) END
             IGNORE NULLS) OVER w, {K.INITIAL_GOAL}) AS goal,
    coalesce(last_value(CASE WHEN type = 'strictness' THEN lower(coalesce(value, '{K.CONTROL_DEFAULTS["strictness"]}')) END
             IGNORE NULLS) OVER w, '{K.INITIAL_STRICTNESS}') AS strictness
  FROM msgs WINDOW w AS (PARTITION BY session_id ORDER BY seq {W_RUN})),
s2 AS (
  SELECT *, coalesce(last_value(CASE WHEN type = 'workout' THEN strictness END IGNORE NULLS)
            OVER (PARTITION BY session_id ORDER BY seq {W_RUN}), '{K.INITIAL_STRICTNESS}') AS rule_strictness
  FROM s1)
"""

SEGMENTS = f"""
fr AS (
  SELECT *, coalesce(lag(form) OVER (PARTITION BY session_id, attempt, epoch ORDER BY seq), false) AS pf
  FROM s2 WHERE type = 'frame' AND attempt > 0),
{latch_ctes("fr", "seq", "angle", "pf", "pf", "session_id, attempt, epoch", "")},
rp AS (
  SELECT *, CAST(sum(CAST(rep_inc AS INTEGER)) OVER (PARTITION BY session_id, attempt ORDER BY seq {W_RUN}) AS BIGINT) AS reps
  FROM lt),
dn AS (SELECT *, goal > 0 AND reps >= goal AS done FROM rp),
kb AS (
  SELECT *, coalesce(sum(CAST(done AS INTEGER)) OVER (PARTITION BY session_id, attempt ORDER BY seq {W_BEFORE}), 0) AS done_before
  FROM dn),
sn AS (
  SELECT *, CAST(coalesce(sum(CAST(done AS INTEGER)) OVER (PARTITION BY session_id ORDER BY seq {W_BEFORE}), 0) AS BIGINT) AS set_no
  FROM kb WHERE done_before = 0),
seg AS (
  SELECT *, set_no + 1 AS series_number,
         CAST(row_number() OVER (PARTITION BY session_id, set_no ORDER BY seq) - 1 AS BIGINT) AS frame,
         form AS form_ok
  FROM sn)
"""

BASE = "WITH " + MESSAGES + "," + SETTINGS
SEG = BASE + "," + SEGMENTS

sql("settings_asof", BASE + """
SELECT session_id, seq, type, attempt, epoch, exercise, CAST(goal AS BIGINT) AS goal, strictness, rule_strictness FROM s2
""")

ORACLE_SET_SEGMENTS = SEG + """
SELECT session_id, seq, attempt, epoch, series_number, frame, down, reps, done, form_ok, exercise,
       CAST(goal AS BIGINT) AS goal
FROM seg
"""
sql("set_segments", ORACLE_SET_SEGMENTS)

COMPLETED = """
SELECT session_id, set_no + 1 AS series_number,
       arg_min(exercise, seq) AS workout_name, CAST(arg_min(goal, seq) AS BIGINT) AS rep_goal,
       arg_min(strictness, seq) AS strictness_crit, CAST(arg_max(reps, seq) AS BIGINT) AS reps,
       arg_max(exercise, seq) AS exercise_at_end, count(*) AS frames, min(seq) AS first_seq, max(seq) AS last_seq
FROM seg GROUP BY session_id, set_no HAVING bool_or(done)
"""
sql("completed_sets", SEG + COMPLETED)

STATUS = f"""
SELECT session_id, seq, 'ready' AS status, msg AS message FROM (
  SELECT session_id, seq,
         CASE WHEN type = 'workout' THEN 'Selected ' || coalesce(value, 'push-ups') || '. Ready to start!'
              WHEN TRY_CAST(trim(coalesce(value, '1')) AS INTEGER) IS NOT NULL
              THEN 'Set target: ' || CAST(TRY_CAST(trim(coalesce(value, '1')) AS INTEGER) AS VARCHAR) || ' reps. Ready to start!'
         END AS msg
  FROM s2 WHERE type IN ('workout', 'reps')) WHERE msg IS NOT NULL
UNION ALL
SELECT session_id, seq,
       CASE WHEN done THEN 'completed' ELSE 'In Progress' END,
       CASE WHEN done THEN 'Workout complete! You did ' || CAST(reps AS VARCHAR) || ' ' || exercise || '!'
            ELSE 'Current rep count: ' || CAST(reps AS VARCHAR) END
FROM seg
"""
sql("status_messages", SEG + STATUS)
sql("status_changes", SEG + f"""
SELECT session_id, seq, status, message FROM (
  SELECT *, lag(message) OVER (PARTITION BY session_id ORDER BY seq) AS prev FROM ({STATUS}))
WHERE prev IS NULL OR message <> prev
""")

sql("history_text", SEG + f"""
SELECT session_id, h AS history, replace(h, chr(10), '<br>') AS history_html FROM (
  SELECT session_id, string_agg(exercise_at_end || ': ' || CAST(reps AS VARCHAR) || ' reps', chr(10) ORDER BY series_number) || chr(10) AS h
  FROM ({COMPLETED}) GROUP BY session_id)
""")

sql("rep_events", SEG + """
SELECT session_id, seq, reps, prev_reps, reps > prev_reps AND reps <> goal AND goal > 0 AS rep_event FROM (
  SELECT *, CAST(coalesce(lag(reps) OVER (PARTITION BY session_id ORDER BY seq), 0) AS BIGINT) AS prev_reps FROM seg)
""")

sql("session_frame_angles", SEG + f"""
SELECT session_id, series_number, frame, {r6("angle")} AS angle, down FROM seg
""")

sql("stream_sets", ORACLE_SET_SEGMENTS)

sql("model_clock", SEG + f"""
SELECT session_id, seq, CAST({K.FRAME_STEP_MS} * row_number() OVER (PARTITION BY session_id ORDER BY seq) AS BIGINT) AS model_clock_ms
FROM seg
""")

sql("stream_stored_sets", SEG + f"""
SELECT session_id, series_number, reps, exercise_at_end, frames, last_seq FROM ({COMPLETED})
""")

sql("control_parse", "WITH " + MESSAGES + """
SELECT session_id, seq,
       CASE WHEN seq % 7 = 3 THEN NULL ELSE type END AS type,
       CASE WHEN seq % 7 = 3 THEN NULL ELSE value END AS value,
       CASE WHEN seq % 7 = 3 THEN 'malformed JSON' END AS reject_reason
FROM msgs WHERE type <> 'frame'
""")


sql("stream_ordered_sets", ORACLE_SET_SEGMENTS)

sql("stream_message_ledger", "WITH " + MESSAGES + """
SELECT session_id, seq, 'applied' AS outcome FROM msgs
UNION ALL SELECT session_id, seq, 'duplicate' FROM msgs WHERE (session_id + seq) % 7 = 0
""")

IDLE_US = 86_400_000_000
sql("stream_idle_history", SEG + f"""
, idle AS (
  SELECT session_id, seq, CASE WHEN coalesce(epoch_us(lead(ts) OVER w) - epoch_us(ts) > {IDLE_US}, true)
                               THEN epoch_us(ts) + {IDLE_US} END AS moment
  FROM msgs WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
sent AS (
  SELECT session_id, seq, min(moment) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sent_at_us
  FROM idle)
SELECT c.session_id, series_number, exercise_at_end || ': ' || CAST(reps AS VARCHAR) || ' reps' AS line, sent_at_us
FROM ({COMPLETED}) c JOIN sent ON sent.session_id = c.session_id AND sent.seq = c.last_seq
""")

sql("history_changes", SEG + f"""
SELECT session_id, series_number, exercise_at_end || ': ' || CAST(reps AS VARCHAR) || ' reps' AS line,
       CAST(last_seq AS BIGINT) AS valid_from,
       CAST(lead(last_seq) OVER (PARTITION BY session_id ORDER BY series_number) AS BIGINT) AS valid_to
FROM ({COMPLETED})
""")
