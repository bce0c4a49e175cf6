"""DuckDB oracle for summaries, prompt rows, responses and quality checks."""

from __future__ import annotations

from .. import constants as K
from ..operators.text import FORMAT_INSTRUCTIONS, PROMPT_SYSTEM, PROMPT_USER
from .oracle import ORACLE, r6, sql
from .oracle_native import NATIVE, SETS
from .oracle_sessions import COMPLETED, SEG
from .oracle_sets import ANGLE_NAMES, DEV_CASE, ISSUE, REP_SPANS, SET_CTES, TRIMMED, _ANGLE_LONG, _angle_value_case, _stats

ISSUE_TXT = f"""
SELECT workout_id, string_agg(form_issues || ' (' || CAST(count AS VARCHAR) || ' times)', ', '
                              ORDER BY count DESC, form_issues) AS issue_summary
FROM (SELECT workout_id, form_issues, count(*) AS count FROM tr GROUP BY workout_id, form_issues)
WHERE form_issues <> '{K.GOOD_LABEL_EXACT}'
GROUP BY workout_id
"""

WORST_TXT = f"""
SELECT workout_id, string_agg('Rep ' || CAST(repetitions AS VARCHAR) || ' (' || CAST(count AS VARCHAR) || ' issues)', ', '
                              ORDER BY rank) AS worst_reps_summary
FROM (
  SELECT workout_id, repetitions, count,
         row_number() OVER (PARTITION BY workout_id ORDER BY count DESC, repetitions ASC) AS rank
  FROM (SELECT workout_id, CAST(rep_count + 1 AS BIGINT) AS repetitions, count(form_issues) AS count
        FROM tr WHERE {ISSUE} GROUP BY workout_id, rep_count)
  QUALIFY rank <= 3)
GROUP BY workout_id
"""

sql("issue_summary_text", SET_CTES + ISSUE_TXT)
sql("worst_rep_text", SET_CTES + WORST_TXT)

SUMMARY = f"""
SELECT sf.workout_id, wk.workout_name, CAST(wk.series_number AS BIGINT) AS series_number,
       CAST(wk.rep_goal AS BIGINT) AS rep_goal, wk.strictness_crit, wk.strictness_definition, sf.frame_start,
       CAST(printf('%.2f', datediff('microsecond', wk.timestamp_start, e.end_time) / 1e6) AS DOUBLE) AS duration,
       tr_tot.total_repetitions,
       round_even(CAST(av.s AS DOUBLE) / (CAST(av.n AS DOUBLE) * 10.0) * 100, 0) / 100 AS average_time_repetitions,
       coalesce(it.issue_summary, '') AS issue_summary, coalesce(wt.worst_reps_summary, '') AS worst_reps_summary
FROM sf JOIN wk ON wk.id = sf.workout_id
LEFT JOIN (SELECT workout_id, max(timestamp) AS end_time FROM wa GROUP BY workout_id) e ON e.workout_id = sf.workout_id
LEFT JOIN (SELECT workout_id, CAST(max(rep_count) AS BIGINT) AS total_repetitions FROM tr GROUP BY workout_id) tr_tot
  ON tr_tot.workout_id = sf.workout_id
LEFT JOIN (SELECT workout_id, sum(CAST(round(duration * 10) AS BIGINT)) AS s, count(duration) AS n
           FROM ({REP_SPANS}) GROUP BY workout_id) av ON av.workout_id = sf.workout_id
LEFT JOIN ({ISSUE_TXT}) it ON it.workout_id = sf.workout_id
LEFT JOIN ({WORST_TXT}) wt ON wt.workout_id = sf.workout_id
"""

sql("set_summary", SET_CTES + f"""
SELECT workout_id, workout_name, series_number, rep_goal, strictness_crit, frame_start, {r6('duration')} AS duration,
       total_repetitions, {r6('average_time_repetitions')} AS average_time_repetitions, issue_summary, worst_reps_summary
FROM ({SUMMARY})
""")


def _f2(x: str) -> str:
    return f"coalesce(printf('%.2f', {x}), 'NaN')"


STATS_TXT = f"""
SELECT workout_id, string_agg(line, chr(10) ORDER BY "column") AS angle_stats_text FROM (
  SELECT workout_id, "column",
         "column" || ': count=' || CAST(count AS VARCHAR) || ' mean=' || {_f2('mean')} || ' std=' || {_f2('std')}
         || ' min=' || {_f2('min')} || ' 25%=' || {_f2('p25')} || ' 50%=' || {_f2('p50')} || ' 75%=' || {_f2('p75')}
         || ' max=' || {_f2('max')} AS line
  FROM ({_stats(_ANGLE_LONG, "scale")}))
GROUP BY workout_id
"""


def _fill(template: str, values: dict[str, str]) -> str:
    parts = []
    rest = template
    while "{" in rest:
        pre, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts.append("'" + pre.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
        parts.append(values[name])
    parts.append("'" + rest.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(parts)


_vals = {
    "rep_goal": "coalesce(CAST(rep_goal AS VARCHAR), 'N/A')",
    "workout_name": "coalesce(workout_name, 'N/A')",
    "series_number": "coalesce(CAST(series_number AS VARCHAR), 'N/A')",
    "strictness_crit": "coalesce(strictness_crit, 'N/A')",
    "strictness_definition": "coalesce(printf('%.1f', strictness_definition), 'N/A')",
    "rolling_summary": f"'{K.FIRST_ROLLING_SUMMARY}'",
    "format_instructions": "'" + FORMAT_INSTRUCTIONS.replace("'", "''") + "'",
    "total_repetitions": "coalesce(CAST(total_repetitions AS VARCHAR), '0')",
    "duration": "coalesce(printf('%.2f', duration), '0')",
    "average_time_repetitions": "coalesce(printf('%.2f', average_time_repetitions), '0')",
    "form_issues": "coalesce(issue_summary, '')",
    "worst_reps": "coalesce(worst_reps_summary, '')",
    "angle_stats": "coalesce(angle_stats_text, '')",
}

sql("prompt_rows", SET_CTES + f"""
SELECT s.workout_id, {_fill(PROMPT_SYSTEM, _vals)} AS system_prompt, {_fill(PROMPT_USER, _vals)} AS user_prompt
FROM ({SUMMARY}) s LEFT JOIN ({STATS_TXT}) st ON st.workout_id = s.workout_id
""")

RESP_CTES = f"""
pr AS (
  SELECT session_id, series_number,
         CASE WHEN reps % 4 = 3 THEN 'rejected' ELSE 'parsed' END AS status,
         'Well done on set ' || CAST(series_number AS VARCHAR) || '!' AS encouragement,
         'You completed ' || CAST(reps AS VARCHAR) || ' ' || exercise_at_end || '.' AS positive_point,
         'Keep a steady form over all ' || CAST(frames AS VARCHAR) || ' frames.' AS main_feedback,
         'The goal was ' || CAST(rep_goal AS VARCHAR) || ' reps.' AS secondary_feedback,
         'Set ' || CAST(series_number AS VARCHAR) || ' of ' || workout_name || ' done.' AS summary,
         'After set ' || CAST(series_number AS VARCHAR) || ': ' || CAST(reps AS VARCHAR) || ' ' || exercise_at_end || '.' AS Rolling_Summary
  FROM cs),
pp AS (
  SELECT session_id, series_number, status,
         {", ".join(f"CASE WHEN status = 'parsed' THEN {f} END AS {f}" for f in K.RESPONSE_FIELDS)}
  FROM pr)
"""

RESP = f", cs AS ({COMPLETED}), {RESP_CTES}"

sql("parsed_responses", SEG + RESP + "SELECT * FROM pp")

ROLLING = f"""
SELECT session_id, series_number,
       coalesce(last_value(Rolling_Summary IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY series_number
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '{K.FIRST_ROLLING_SUMMARY}') AS previous_rolling_summary
FROM pp
"""
sql("rolling_summary", SEG + RESP + ROLLING)

_rolled = {**_vals, "rolling_summary": "previous_rolling_summary"}
sql("session_prompts", NATIVE + SETS + f"""
, own AS (SELECT * FROM seg JOIN done_sets USING (session_id, series_number)),
wk AS (
  SELECT s.set_id AS id, s.exercise AS workout_name, st.timestamp_start, s.goal AS rep_goal, s.series_number,
         s.strictness AS strictness_crit, s.dev_set AS strictness_definition
  FROM (SELECT *, {DEV_CASE} AS dev_set FROM first_rows) s JOIN starts st USING (session_id)),
wa AS (
  SELECT set_id AS workout_id, frame, ts AS timestamp, reps AS rep_count, form_issues, exercise, left_side,
         {", ".join(f"{_angle_value_case(n)} AS {n}_value" for n in ANGLE_NAMES)}
  FROM own),
{TRIMMED},
cs AS (
  SELECT session_id, series_number, arg_max(reps, seq) AS reps, arg_max(exercise, seq) AS exercise_at_end,
         count(*) AS frames, arg_min(goal, seq) AS rep_goal, arg_min(exercise, seq) AS workout_name
  FROM own GROUP BY session_id, series_number),
{RESP_CTES}
SELECT s.workout_id, {_fill(PROMPT_SYSTEM, _rolled)} AS system_prompt, {_fill(PROMPT_USER, _rolled)} AS user_prompt
FROM ({SUMMARY}) s LEFT JOIN ({STATS_TXT}) st ON st.workout_id = s.workout_id
JOIN (SELECT set_id, previous_rolling_summary FROM done_sets JOIN ({ROLLING}) USING (session_id, series_number)) r
  ON r.set_id = s.workout_id
""")

_d0, _d1 = K.FEEDBACK_DISCLAIMER.split("{}")
FEEDBACK_HTML = f"""'<div class="feedback-details">' || '<p>💪 ' || encouragement || '</p>' || '<p>🔥 ' || positive_point || '</p>'
       || '<p>🏋️ ' || summary || ' </p>' || '<p>🔎 ' || main_feedback || ' ' || secondary_feedback || '</p>'
       || '<small> ' || '{_d0}' || '2024-02-01 00:00:00' || '{_d1}' || '</small></div><hr>'"""
sql("feedback_text", SEG + RESP + f"""
SELECT session_id, series_number, {FEEDBACK_HTML} AS feedback_html
FROM pp WHERE status = 'parsed'
""")

_WCOLS = ["id", "workout_name", "timestamp_start", "rep_goal", "strictness_crit", "strictness_definition",
          "left_side", "ldmrks_of_interest"]
_ACOLS = ["workout_id", "frame", "timestamp", "rep_count", "down", "form_issues"]
sql("quality_nulls", SET_CTES + " UNION ALL ".join(
    [f"SELECT 'workout' AS \"table\", '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM wk" for c in _WCOLS]
    + [f"SELECT 'workout_analysis', '{c}', count(*) FILTER (WHERE {c} IS NULL) FROM wa" for c in _ACOLS]
    + ["SELECT 'workout_analysis', 'angles_data', 0 FROM (SELECT 1) t"]
))


def _keys(table: str, src: str, keys: str) -> str:
    return (f"SELECT '{table}' AS \"table\", '{keys}' AS key, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, "
            f"count(*) FILTER (WHERE n > 1) AS duplicate_keys FROM (SELECT {keys}, count(*) AS n FROM {src} GROUP BY {keys})")


sql("quality_pk", SET_CTES + " UNION ALL ".join([
    _keys("workout", "wk", "id"),
    _keys("workout_analysis", "wa", "workout_id,timestamp"),
    _keys("raw_landmarks", "wa", "workout_id,frame"),
]))

sql("quality_fk", SET_CTES + """
SELECT 'workout_analysis -> workout' AS "check", count(*) AS rows FROM wa WHERE workout_id NOT IN (SELECT id FROM wk)
UNION ALL SELECT 'raw_landmarks -> workout', count(*) FROM wa WHERE workout_id NOT IN (SELECT id FROM wk)
UNION ALL SELECT 'frames of sets without start frame', count(*) FROM wa WHERE workout_id NOT IN (SELECT workout_id FROM sf)
""")

sql("stored_set_summary", ORACLE["set_summary"])
sql("latest_set_summary", SET_CTES + f"""
SELECT workout_id, workout_name, series_number, rep_goal, strictness_crit, frame_start, {r6('duration')} AS duration,
       total_repetitions, {r6('average_time_repetitions')} AS average_time_repetitions, issue_summary, worst_reps_summary
FROM ({SUMMARY}) WHERE workout_id = (SELECT max(id) FROM wk)
""")
