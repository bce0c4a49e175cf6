"""DuckDB SQL for every registered query (the correctness oracle).

Each string runs on views named after the driver's tables.  The SQL is an
independent formulation with plain window functions over whole partitions
(fine for a single-node check); the Spark plans use chunked scans instead.
Shared fragments are composed with Python string helpers.
"""

from __future__ import annotations

from .. import constants as K

ORACLE: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    if name in ORACLE:
        raise ValueError(f"duplicate oracle {name}")
    ORACLE[name] = text.strip()


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def np_round(x: str, n: int) -> str:
    s = 10 ** n
    return f"(round_even(({x}) * {s}, 0) / {s})"


def angle(ax: str, ay: str, bx: str, by: str, cx: str, cy: str) -> str:
    ux, uy, vx, vy = f"(({ax}) - ({bx}))", f"(({ay}) - ({by}))", f"(({cx}) - ({bx}))", f"(({cy}) - ({by}))"
    dot = f"({ux} * {vx} + {uy} * {vy})"
    norm = f"(sqrt({ux} * {ux} + {uy} * {uy}) * sqrt({vx} * {vx} + {vy} * {vy}))"
    return f"degrees(acos({dot} / {norm}))"


K_EXPR = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

# --------------------------------------------------------------------------
# adapters
# --------------------------------------------------------------------------

SIGNAL_EVENTS = f"""
SELECT user_id AS workout_id, ts, event_id,
       {K_EXPR} * 180 / 99 AS angle,
       event_type <> 'error' AS form
FROM events
"""

SIGNAL_LINEITEM = """
SELECT l_suppkey AS workout_id, l_shipdate, l_orderkey, l_linenumber, l_partkey,
       (l_quantity - 1) * 180 / 49 AS angle,
       l_returnflag <> 'R' AS form
FROM lineitem
"""

EVENT_BASE = f"""
SELECT user_id AS workout_id, ts, event_id,
       {K_EXPR} * 180 / 99 AS theta,
       CAST(round(value * 100) AS BIGINT) AS vi,
       user_id % 2 = 0 AS is_left
FROM events
"""


def latch_sql(src: str, order: str, angle_col: str = "angle", pfu: str = "prev_form", pfd: str = "prev_form",
              keys: str = "workout_id") -> str:
    """Hysteresis latch over ``src`` (which has ``{keys}``, frame order ``order``)."""
    w_incl = f"PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    w_excl = f"PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
lt_e AS (
  SELECT *, CASE WHEN NOT isnan({angle_col}) AND {angle_col} <= {K.DOWN_THRESHOLD} AND {pfu} THEN 1
                 WHEN NOT isnan({angle_col}) AND {angle_col} >= {K.UP_THRESHOLD} AND {pfd} THEN 0 END AS event
  FROM {src}),
lt_d AS (
  SELECT *, coalesce(last_value(event IGNORE NULLS) OVER ({w_incl}) = 1, false) AS down,
            coalesce(last_value(event IGNORE NULLS) OVER ({w_excl}) = 1, false) AS prev_down
  FROM lt_e),
lt_r AS (
  SELECT *, coalesce(event = 0, false) AND prev_down AS rep_inc FROM lt_d),
lt AS (
  SELECT *, CAST(sum(CAST(rep_inc AS BIGINT)) OVER ({w_incl}) AS BIGINT) AS rep_count FROM lt_r)
"""


def signal_state_sql(signal: str, order: str) -> str:
    return f"""
WITH sig AS ({signal}),
fr AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS frame,
            coalesce(lag(form) OVER w, false) AS prev_form
  FROM sig WINDOW w AS (PARTITION BY workout_id ORDER BY {order})),
{latch_sql("fr", "frame")}
"""


EVENTS_STATE = signal_state_sql(SIGNAL_EVENTS, "ts, event_id")
LINEITEM_STATE = signal_state_sql(SIGNAL_LINEITEM, "l_shipdate, l_orderkey, l_linenumber, l_partkey")

REP_TOTALS = """
SELECT workout_id, count(*) AS frames, CAST(max(rep_count) AS BIGINT) AS reps FROM lt GROUP BY workout_id
"""

sql("rep_counts", EVENTS_STATE + REP_TOTALS)
FRAME_STATE = EVENTS_STATE + f"""
SELECT workout_id, frame, {r6('angle')} AS angle, down, rep_count, form AS form_ok FROM lt
"""
sql("frame_state", FRAME_STATE)
sql("stream_frame_state", FRAME_STATE)
sql("scale_frame_state", LINEITEM_STATE + """
SELECT workout_id, frame, down, rep_count, form AS form_ok FROM lt
""")
sql("scale_rep_counts", LINEITEM_STATE + REP_TOTALS)


# --------------------------------------------------------------------------
# poses and form rules
# --------------------------------------------------------------------------

def pushup_points(src: str) -> str:
    return f"""
SELECT *, hx + 0.2 * cos(radians(phi)) AS kx, hy + 0.2 * sin(radians(phi)) AS ky FROM (
SELECT *, sx + 0.3 AS hx, sy AS hy FROM (
  SELECT *, 0.5 AS ex, 0.55 AS ey, 0.5 AS wx, 0.75 AS wy,
         0.5 + 0.2 * sin(radians(theta)) AS sx, 0.55 + 0.2 * cos(radians(theta)) AS sy,
         (vi % 4000) / 100 + 0.0025 AS phi, 0.95 AS tx, 0.8 AS ty
  FROM ({src})))
"""


def squat_points(src: str) -> str:
    return f"""
SELECT *, hx + 0.2 * (-sin(radians(theta)) * cos(radians(psi)) + cos(radians(theta)) * sin(radians(psi))) AS sx,
          hy + 0.2 * (-sin(radians(theta)) * sin(radians(psi)) - cos(radians(theta)) * cos(radians(psi))) AS sy
FROM (
  SELECT *, 0.5 AS ax, 0.9 AS ay, 0.5 AS kx, 0.7 AS ky,
         0.5 + 0.2 * sin(radians(theta)) AS hx, 0.7 + 0.2 * cos(radians(theta)) AS hy,
         0.6 AS tx, 0.92 AS ty,
         CASE WHEN theta > 150 THEN 180 - (vi % 3000) / 100 - 0.0025
              ELSE 20 + (vi % 10000) / 100 + 0.0025 END AS psi
  FROM ({src}))
"""


def pushup_features_sql(src: str, p: str = "", dev: str = "15.0") -> str:
    """CTEs ``{p}ang``, ``{p}ft2``: push-up angles, form flags and issue bits."""
    return f"""
{p}ang AS (
  SELECT *, {angle('wx', 'wy', 'ex', 'ey', 'sx', 'sy')} AS rep,
            {angle('sx', 'sy', 'hx', 'hy', 'kx', 'ky')} AS aux
  FROM ({pushup_points(src)})),
{p}ft AS (
  SELECT *,
    NOT ({np_round('wx', 1)} = {np_round('sx', 1)} OR (NOT isnan(rep) AND rep <= {K.ELBOW_THRESHOLD})) AS b0,
    NOT ({np_round('ky', 2)} < least({np_round('wy', 2)}, {np_round('ty', 2)})) AS b1,
    NOT (NOT isnan(aux) AND aux > {K.GOAL_BODY_ANGLE} - (({dev}) + {K.VARIATION})
         AND aux < {K.GOAL_BODY_ANGLE} + (({dev}) + {K.VARIATION})) AS b2
  FROM {p}ang),
{p}ft2 AS (
  SELECT * EXCLUDE (b0, b1, b2), NOT (b0 OR b1 OR b2) AS fu, NOT (b0 OR b1 OR b2) AS fd,
         b0 AS ub0, b1 AS ub1, b2 AS ub2, b0 AS db0, b1 AS db1, b2 AS db2
  FROM {p}ft)
"""


def squat_features_sql(src: str, p: str = "", dev: str = "15.0") -> str:
    return f"""
{p}ang AS (
  SELECT *, {angle('ax', 'ay', 'kx', 'ky', 'hx', 'hy')} AS rep,
            {angle('sx', 'sy', 'hx', 'hy', 'kx', 'ky')} AS aux
  FROM ({squat_points(src)})),
{p}ft AS (
  SELECT *,
    NOT ({np_round('sx', 1)} - {np_round('ax', 1)} < {K.VARIATION}) AS shb,
    NOT ({np_round('kx', 1)} - {np_round('ax', 1)} < {K.VARIATION}) AS ub0,
    NOT (CASE WHEN NOT isnan(rep) AND rep > {K.UP_THRESHOLD}
              THEN NOT isnan(aux) AND (180 - aux) < ({dev}) ELSE true END) AS ub1,
    NOT ({np_round('kx', 1)} - {np_round('tx', 1)} < {K.VARIATION}) AS db0,
    NOT (CASE WHEN NOT isnan(rep) AND rep < {K.UP_THRESHOLD} AND rep > {K.DOWN_THRESHOLD} THEN true
              ELSE NOT isnan(aux) AND 45 - ({dev}) < aux AND aux < 90 + ({dev}) END) AS db1
  FROM {p}ang),
{p}ft2 AS (
  SELECT *, shb AS ub2, shb AS db2,
         NOT (ub0 OR ub1 OR shb) AS fu, NOT (db0 OR db1 OR shb) AS fd
  FROM {p}ft)
"""


PUSHUP_MESSAGE = f"""
CASE WHEN NOT (b0 OR b1 OR b2) THEN '{K.PUSHUP_GOOD}'
     ELSE concat_ws(', ', CASE WHEN b0 THEN '{K.PUSHUP_MSG_SHOULDERS}' END,
                          CASE WHEN b1 THEN '{K.PUSHUP_MSG_KNEES}' END,
                          CASE WHEN b2 THEN '{K.PUSHUP_MSG_BODY}' END) END
"""


def _tpl(t: str, x: str) -> str:
    a, b = t.split("{}")
    return f"'{a}' || {x} || '{b}'"


SQUAT_MESSAGE = f"""
CASE WHEN NOT (b0 OR b1 OR b2) THEN '{K.SQUAT_GOOD}'
     ELSE concat_ws(', ',
        CASE WHEN b0 THEN CASE WHEN down THEN '{K.SQUAT_MSG_KNEES_DOWN}' ELSE '{K.SQUAT_MSG_KNEES_UP}' END END,
        CASE WHEN b1 THEN CASE WHEN down THEN {_tpl(K.SQUAT_MSG_HIPS_DOWN, "printf('%.1f', aux)")}
                               ELSE {_tpl(K.SQUAT_MSG_HIPS_UP, "printf('%.1f', aux)")} END END,
        CASE WHEN b2 THEN '{K.SQUAT_MSG_SHOULDERS}' END) END
"""


def latch_ctes(src: str, order: str, angle_col: str, pfu: str, pfd: str, keys: str, p: str) -> str:
    """Latch CTEs ending in ``{p}lt`` (same logic as ``latch_sql``, prefixed)."""
    w_incl = f"PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    w_excl = f"PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"""
{p}lt_e AS (
  SELECT *, CASE WHEN NOT isnan({angle_col}) AND {angle_col} <= {K.DOWN_THRESHOLD} AND {pfu} THEN 1
                 WHEN NOT isnan({angle_col}) AND {angle_col} >= {K.UP_THRESHOLD} AND {pfd} THEN 0 END AS event
  FROM {src}),
{p}lt_d AS (
  SELECT *, coalesce(last_value(event IGNORE NULLS) OVER ({w_incl}) = 1, false) AS down,
            coalesce(last_value(event IGNORE NULLS) OVER ({w_excl}) = 1, false) AS prev_down
  FROM {p}lt_e),
{p}lt_r AS (
  SELECT *, coalesce(event = 0, false) AND prev_down AS rep_inc FROM {p}lt_d),
{p}lt AS (
  SELECT *, CAST(sum(CAST(rep_inc AS BIGINT)) OVER ({w_incl}) AS BIGINT) AS rep_count FROM {p}lt_r)
"""


def pose_state_ctes(features: str, message: str, p: str = "") -> str:
    """CTEs ending in ``{p}st``: per-frame pose state (frame, down, rep_count, form, message)."""
    return f"""
{features},
{p}fr AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS frame,
            coalesce(lag(fu) OVER w, false) AS pfu,
            coalesce(lag(fd) OVER w, false) AS pfd,
            first_value(is_left) OVER (PARTITION BY workout_id ORDER BY ts, event_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS left_side
  FROM {p}ft2 WINDOW w AS (PARTITION BY workout_id ORDER BY ts, event_id)),
{latch_ctes(p + "fr", "frame", "rep", "pfu", "pfd", "workout_id", p)},
{p}st0 AS (
  SELECT *, CASE WHEN down THEN fd ELSE fu END AS form_ok,
         CASE WHEN down THEN db0 ELSE ub0 END AS b0,
         CASE WHEN down THEN db1 ELSE ub1 END AS b1,
         CASE WHEN down THEN db2 ELSE ub2 END AS b2
  FROM {p}lt),
{p}st AS (SELECT * EXCLUDE (b0, b1, b2), {message} AS form_issues FROM {p}st0)
"""


def pushup_state_sql(strictness: str = "loose") -> str:
    dev = str(K.STRICTNESS_DEGREES[strictness])
    return "WITH " + pose_state_ctes(pushup_features_sql(EVENT_BASE, "", dev), PUSHUP_MESSAGE, "")


def squat_state_sql(strictness: str = "loose") -> str:
    dev = str(K.STRICTNESS_DEGREES[strictness])
    return "WITH " + pose_state_ctes(squat_features_sql(EVENT_BASE, "", dev), SQUAT_MESSAGE, "")


FORM_VIEW = f"""
SELECT workout_id, frame, left_side, down, rep_count, form_ok, form_issues,
       {r6('rep')} AS rep_angle, {r6('aux')} AS aux_angle
FROM st
"""
POSE_TOTALS = """
SELECT workout_id, count(*) AS frames, CAST(max(rep_count) AS BIGINT) AS reps FROM st GROUP BY workout_id
"""

sql("pushup_form", pushup_state_sql() + FORM_VIEW)
sql("pushup_reps", pushup_state_sql() + POSE_TOTALS)
sql("squat_form", squat_state_sql() + FORM_VIEW)
sql("squat_reps", squat_state_sql() + POSE_TOTALS)
