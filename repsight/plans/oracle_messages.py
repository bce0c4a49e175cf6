"""DuckDB oracle for typed messages, rejected rows, damaged files and orphans."""

from __future__ import annotations

from .. import constants as K
from .oracle import K_EXPR, sql
from .oracle_sessions import COMPLETED, MESSAGES, SEG, STATUS
from .oracle_text import FEEDBACK_HTML, RESP

sql("typed_controls", "WITH " + MESSAGES + """
, f AS (SELECT *, (seq // 10) % 5 AS shape FROM msgs WHERE type <> 'frame')
SELECT session_id, seq, type,
       CASE WHEN type <> 'reps' THEN value WHEN shape IN (0, 2) THEN value WHEN shape IN (1, 3) THEN value || '.7' ELSE 'true' END AS value,
       CAST(CASE WHEN type <> 'reps' OR shape = 3 THEN NULL WHEN shape = 4 THEN 1 ELSE CAST(value AS INTEGER) END AS BIGINT) AS goal,
       CASE WHEN type = 'reps' AND shape = 3 THEN 'no whole number' END AS reject_reason
FROM f
""")

_ENVELOPE = "CAST(to_json(struct_pack(type := '{}', message := {})) AS VARCHAR) AS envelope, '{}' AS type, {} AS message, CAST(NULL AS VARCHAR) AS status"


def _plain(kind: str, message: str) -> str:
    return _ENVELOPE.format(kind, message, kind, message)


sql("typed_messages", SEG + RESP + f"""
SELECT session_id, seq, CAST(to_json(struct_pack(type := 'data', message := message, status := status)) AS VARCHAR) AS envelope,
       'data' AS type, message, status FROM ({STATUS})
UNION ALL
SELECT session_id, seq, {_plain('feedback', 'h')} FROM (
  SELECT session_id, cs.last_seq AS seq, {FEEDBACK_HTML} AS h FROM pp JOIN cs USING (session_id, series_number) WHERE status = 'parsed')
UNION ALL
SELECT session_id, cs.last_seq, {_plain('error', f"'{K.FEEDBACK_ERROR}'")} FROM pp JOIN cs USING (session_id, series_number)
WHERE status = 'rejected'
UNION ALL
SELECT session_id, seq, {_plain('history', 'h')} FROM (
  SELECT session_id, last_seq AS seq, exercise_at_end || ': ' || CAST(reps AS VARCHAR) || ' reps<br>' AS h FROM ({COMPLETED}))
""")

sql("rejected_rows", f"""
SELECT user_id AS session_id, event_id, CASE
    WHEN k % 3 = 2 THEN 'unknown exercise' WHEN k % 5 > 2 THEN 'unknown strictness' ELSE 'broken coordinates' END AS reject_reason
FROM (SELECT *, {K_EXPR} AS k FROM events)
WHERE k % 3 = 2 OR k % 5 > 2 OR event_type IN ('error', 'purchase')
""")

_dim = ", ".join(f"({i}, {f"'{side}'" if side else 'NULL'}, '{name}')" for i, side, name in K.LANDMARK_DIMENSION)
sql("landmark_csv", f"""
WITH dim(idx, side, name) AS (VALUES {_dim}),
lines AS (
  SELECT vec_id % 7 AS d, idx, side, name, CAST(idx AS VARCHAR) || ' , ' || coalesce(side, '') AS head
  FROM embeddings JOIN dim ON idx = vec_id % 33),
read AS (
  SELECT CASE d WHEN 3 THEN head WHEN 4 THEN head || ', ' || name || ',x'
                WHEN 5 THEN 'no , ' || coalesce(side, '') || ',' || name END AS damaged_line,
         idx, side, name, d BETWEEN 3 AND 5 AS bad
  FROM lines)
SELECT CAST(CASE WHEN NOT bad THEN idx END AS BIGINT) AS "index", CASE WHEN NOT bad THEN side END AS side,
       CASE WHEN NOT bad THEN name END AS name, damaged_line, count(*) AS lines
FROM read GROUP BY ALL
""")

sql("stream_orphans", "SELECT user_id AS workout_id, event_id FROM events WHERE user_id % 5 = 0")
