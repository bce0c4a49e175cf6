"""Frame streams built from the driver's tables.

The driver's tables carry no poses, so each adapter derives a keyed,
ordered frame stream from one of them; every adapter also exists as SQL in
``plans/oracle.py``.  Each adapter adds ``chunk``: a coarse, order-preserving
bucket of its ordering key, bounded in size by construction (a key holding a
third of all rows is still split into many chunks), used by ``operators.scan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import BODY_PART_INDEX, N_LANDMARKS, SIDE_LANDMARKS
from .tables import read_table

__all__ = ["read_table"]

EVENT_ORDER = ["ts", "event_id"]
LINEITEM_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
EMBEDDING_ORDER = ["vec_id"]

CHUNK_SHIFT = 20  # an id bucket spans 2^20 ids
BUCKETS = 1 << 44  # above every bucket number of a 64-bit id, so a bucket never runs into the next day


def events_chunk() -> Column:
    """Day of ``ts`` and a 2^20-wide ``event_id`` bucket: at most 2^20 rows a chunk.

    Order preserving because event ids are assigned in time order (an ingestion
    sequence; holds for the given table).
    """
    day = F.unix_date(F.to_date("ts")).cast("bigint")
    return (day * F.lit(BUCKETS) + F.shiftright(F.col("event_id"), CHUNK_SHIFT)).alias("chunk")


def session_chunk(events: DataFrame, max_rows: int = 1 << 16) -> DataFrame:
    """Add the ``chunk`` of a session's events: one for a whole session, hours of ``ts`` where it has over ``max_rows``.

    A live session sends 10 frames a second, so an hour holds 36,000 of them.
    Order preserving by ``ts`` alone.  Events without a time or an id have no chunk.
    """
    from ..operators.scan import adaptive_chunk

    hour = F.unix_date(F.to_date("ts")).cast("bigint") * 24 + F.hour("ts")
    out = adaptive_chunk(events, ["session_id"], F.lit(0), hour, max_rows=max_rows)
    # a missing session is no key to join on: its events are always dealt by days
    day = events_chunk()
    chunk = F.when(F.col("session_id").isNull(), day).otherwise(F.col("chunk")["fine"])
    return out.withColumn("chunk", F.when(day.isNotNull(), chunk))


def seq_chunk(col: str = "seq", shift: int = 16) -> Column:
    """Native streams: ``seq >> 16`` holds at most 65,536 frames a chunk."""
    return F.shiftright(F.col(col), shift).alias("chunk")


def event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def event_theta() -> Column:
    """Angle signal in degrees from the event's ``k`` (0..99 -> 0..180)."""
    return event_k() * 180 / 99


# --------------------------------------------------------------------------
# Adapter A: angle signal from events (form given)
# --------------------------------------------------------------------------

def events_signal(spark: SparkSession, base: str) -> DataFrame:
    ev = read_table(spark, base, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    return ev.select(
        F.col("user_id").alias("workout_id"),
        "ts",
        "event_id",
        events_chunk(),
        event_theta().alias("angle"),
        (F.col("event_type") != "error").alias("form"),
    )


# --------------------------------------------------------------------------
# Adapter C: angle signal from lineitem (scale)
# --------------------------------------------------------------------------

def lineitem_signal(spark: SparkSession, base: str) -> DataFrame:
    """Chunks: ship month, refined to (day of month, 2^20 order keys) only for
    (supplier, month) groups above 2^20 rows (``scan.adaptive_chunk``)."""
    from ..operators.scan import adaptive_chunk

    li = read_table(
        spark, base, "lineitem",
        ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"],
    )
    sig = li.select(
        F.col("l_suppkey").alias("workout_id"),
        *LINEITEM_ORDER,
        ((F.col("l_quantity") - 1) * 180 / 49).alias("angle"),
        (F.col("l_returnflag") != "R").alias("form"),
    )
    d = F.to_date("l_shipdate")
    month = (F.year(d) * 12 + F.month(d)).cast("bigint")
    fine = F.dayofmonth(d).cast("bigint") * F.lit(BUCKETS) + F.shiftright(F.col("l_orderkey"), CHUNK_SHIFT)
    return adaptive_chunk(sig, ["workout_id"], month, fine)


# --------------------------------------------------------------------------
# Adapter B: geometric poses from events
# --------------------------------------------------------------------------

def _sin(deg: Column) -> Column:
    return F.sin(F.radians(deg))


def _cos(deg: Column) -> Column:
    return F.cos(F.radians(deg))


def _pose(points: dict[str, tuple[Column, Column]], left: Column, vis_left: Column) -> Column:
    """33-landmark array: body parts at the side's indices, others at (0.5, 0.5)."""
    half = F.lit(0.5)
    elems = []
    for i in range(N_LANDMARKS):
        x, y = half, half
        for part, (li, ri) in BODY_PART_INDEX.items():
            if part not in points:
                continue
            px, py = points[part]
            if i == li:
                x = F.when(left, px).otherwise(x)
                y = F.when(left, py).otherwise(y)
            if i == ri:
                x = F.when(~left, px).otherwise(x)
                y = F.when(~left, py).otherwise(y)
        if i == SIDE_LANDMARKS[0]:
            vis = vis_left
        elif i == SIDE_LANDMARKS[1]:
            vis = F.lit(0.5)
        else:
            vis = F.lit(0.0)
        elems.append(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), vis.alias("visibility")))
    return F.array(*elems)


def _event_base(spark: SparkSession, base: str) -> DataFrame:
    from ..operators.scan import ensure_parallel

    ev = ensure_parallel(read_table(spark, base, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"]))
    return ev.select(
        F.col("user_id").alias("workout_id"),
        "ts",
        "event_id",
        events_chunk(),
        event_theta().alias("theta"),
        F.round(F.col("value") * 100).cast("bigint").alias("vi"),
        ((F.col("user_id") % 2) == 0).alias("is_left"),
    )


def _side_visibility() -> Column:
    return F.when(F.col("is_left"), F.lit(0.9)).otherwise(F.lit(0.2))


Points = dict[str, tuple[Column, Column]]


def with_pushup_points(df: DataFrame) -> tuple[DataFrame, Points]:
    """Push-up points from ``theta``/``vi`` (elbow angle = theta, body angle = 180 - phi).

    Sines, then shoulder, then knee are columns of ``df`` (named ``__pu...``):
    each is used by several landmarks of both sides and computed once.
    """
    th = F.col("theta")
    phi = (F.col("vi") % 4000) / 100 + 0.0025
    ex, ey = F.lit(0.5), F.lit(0.55)
    c = lambda n: F.col(f"__pu_{n}")
    df = df.withColumns({"__pu_s": _sin(th), "__pu_c": _cos(th), "__pu_ps": _sin(phi), "__pu_pc": _cos(phi)})
    df = df.withColumns({"__pu_sx": ex + 0.2 * c("s"), "__pu_sy": ey + 0.2 * c("c")})
    df = df.withColumn("__pu_hx", c("sx") + 0.3)
    df = df.withColumns({"__pu_kx": c("hx") + 0.2 * c("pc"), "__pu_ky": c("sy") + 0.2 * c("ps")})
    points = {
        "elbow": (ex, ey),
        "wrist": (F.lit(0.5), F.lit(0.75)),
        "shoulder": (c("sx"), c("sy")),
        "hip": (c("hx"), c("sy")),
        "knee": (c("kx"), c("ky")),
        "ankle": (c("kx") + 0.1, c("ky")),
        "toes": (F.lit(0.95), F.lit(0.8)),
    }
    return df, points


def with_squat_points(df: DataFrame) -> tuple[DataFrame, Points]:
    """Squat points from ``theta``/``vi`` (knee angle = theta, hip angle = psi), staged as ``with_pushup_points``."""
    th = F.col("theta")
    vi = F.col("vi")
    psi = F.when(th > 150, 180 - (vi % 3000) / 100 - 0.0025).otherwise(20 + (vi % 10000) / 100 + 0.0025)
    kx, ky = F.lit(0.5), F.lit(0.7)
    c = lambda n: F.col(f"__sq_{n}")
    df = df.withColumns({"__sq_s": _sin(th), "__sq_c": _cos(th), "__sq_psi": psi})
    df = df.withColumns({"__sq_ps": _sin(c("psi")), "__sq_pc": _cos(c("psi"))})
    df = df.withColumns({"__sq_hx": kx + 0.2 * c("s"), "__sq_hy": ky + 0.2 * c("c")})
    df = df.withColumns({
        "__sq_sx": c("hx") + 0.2 * (-c("s") * c("pc") + c("c") * c("ps")),
        "__sq_sy": c("hy") + 0.2 * (-c("s") * c("ps") - c("c") * c("pc")),
    })
    points = {
        "ankle": (F.lit(0.5), F.lit(0.9)),
        "knee": (kx, ky),
        "hip": (c("hx"), c("hy")),
        "shoulder": (c("sx"), c("sy")),
        "toes": (F.lit(0.6), F.lit(0.92)),
    }
    return df, points


def _with_pose(df: DataFrame, points: Points) -> DataFrame:
    """``landmarks`` of the points, whose helper columns go."""
    out = df.withColumn("landmarks", _pose(points, F.col("is_left"), _side_visibility()))
    return out.drop(*[n for n in df.columns if n.startswith("__pu_") or n.startswith("__sq_")])


def with_pushup_pose(df: DataFrame) -> DataFrame:
    return _with_pose(*with_pushup_points(df))


def with_squat_pose(df: DataFrame) -> DataFrame:
    return _with_pose(*with_squat_points(df))


def pushup_poses(spark: SparkSession, base: str) -> DataFrame:
    return with_pushup_pose(_event_base(spark, base)).select("workout_id", "ts", "event_id", "chunk", "landmarks")


def squat_poses(spark: SparkSession, base: str) -> DataFrame:
    return with_squat_pose(_event_base(spark, base)).select("workout_id", "ts", "event_id", "chunk", "landmarks")


def set_exercise() -> Column:
    """Exercise of a user's set: push-ups when (user_id div 2) is even, else squats."""
    return F.when((F.floor(F.col("workout_id") / 2) % 2) == 0, F.lit("push-ups")).otherwise(F.lit("squats"))


def set_strictness() -> Column:
    return F.element_at(F.array(F.lit("loose"), F.lit("moderate"), F.lit("strict")), (F.col("workout_id") % 3 + 1).cast("int"))


def set_events(spark: SparkSession, base: str) -> DataFrame:
    """The events that ``set_poses`` builds poses from, with the set's exercise."""
    return _event_base(spark, base).withColumn("exercise", set_exercise())


def with_set_pose(df: DataFrame) -> DataFrame:
    """The poses of events of ``set_events``: one array, of the exercise's points (a part it lacks is at (0.5, 0.5))."""
    df, pushup = with_pushup_points(df)
    df, squat = with_squat_points(df)
    half = (F.lit(0.5), F.lit(0.5))
    picked, points = {}, {}
    for part in pushup:
        for axis, p, q in zip("xy", pushup[part], squat.get(part, half)):
            picked[f"__pu_{part}_{axis}"] = F.when(F.col("exercise") == "push-ups", p).otherwise(q)
        points[part] = (F.col(f"__pu_{part}_x"), F.col(f"__pu_{part}_y"))
    return _with_pose(df.withColumns(picked), points)


def set_poses(spark: SparkSession, base: str) -> DataFrame:
    """One set per user with mixed exercises and strictness levels.

    Columns: workout_id, ts, event_id, chunk, exercise, strictness, rep_goal,
    landmarks.  ``rep_goal = 3 + user_id % 5``; frames are not cut at the goal.
    """
    return with_set_pose(set_events(spark, base)).select(
        "workout_id", "ts", "event_id", "chunk", "exercise",
        set_strictness().alias("strictness"),
        (F.lit(3) + F.col("workout_id") % 5).cast("int").alias("rep_goal"),
        "landmarks",
    )


# --------------------------------------------------------------------------
# Adapter D: poses from embeddings
# --------------------------------------------------------------------------

def embedding_poses(spark: SparkSession, base: str) -> DataFrame:
    em = read_table(spark, base, "embeddings", ["vec_id", "embedding", "label"])
    e = F.col("embedding")
    pts = [
        F.struct(
            (F.lit(0.5) + F.get(e, (2 * i) % 64).cast("double")).alias("x"),
            (F.lit(0.5) + F.get(e, (2 * i + 1) % 64).cast("double")).alias("y"),
            F.lit(0.0).alias("visibility"),
        )
        for i in range(N_LANDMARKS)
    ]
    return em.select(
        F.col("label").cast("bigint").alias("workout_id"),
        "vec_id",
        F.shiftright(F.col("vec_id"), 16).alias("chunk"),
        F.array(*pts).alias("landmarks"),
    )


# --------------------------------------------------------------------------
# Adapter E: control messages and frames of sessions, from events
# --------------------------------------------------------------------------

def session_events(spark: SparkSession, base: str) -> DataFrame:
    """Events of a session with their sequence number ``n`` (1-based, by ts, event_id)."""
    from ..operators.scan import number_frames

    ev = read_table(spark, base, "events", ["event_id", "ts", "user_id", "event_type", "props"])
    ev = ev.select(
        F.col("user_id").alias("session_id"), "ts", "event_id", "event_type", event_k().alias("k"),
    )
    numbered = number_frames(session_chunk(ev), ["session_id"], EVENT_ORDER, "chunk", frame_col="n0")
    return numbered.withColumn("n", F.col("n0") + 1).drop("n0")


def session_messages(spark: SparkSession, base: str) -> DataFrame:
    """One row per control message or frame: session_id, seq, chunk, type, value, angle, form.

    signup with k % 4 = 0: ``start`` at seq, then ``workout``=push-ups at seq + 1;
    signup with k % 4 = 1: ``workout``=squats; with k % 4 = 2: ``strictness``=strict;
    any other signup: ``strictness``=moderate; purchase: ``reps`` = k % 3;
    view, click, error: a frame with angle k*180/99 and form = not error.
    So every event gives a message (the first kind of signup two).
    """
    ev = session_events(spark, base)
    seq = F.col("n") * 10
    et, k = F.col("event_type"), F.col("k")
    msgs = F.when(
        (et == "signup") & (k % 4 == 0),
        F.array(
            F.struct(seq.alias("seq"), F.lit("start").alias("type"), F.lit(None).cast("string").alias("value")),
            F.struct((seq + 1).alias("seq"), F.lit("workout").alias("type"), F.lit("push-ups").alias("value")),
        ),
    ).when(
        (et == "signup") & (k % 4 == 1),
        F.array(F.struct(seq.alias("seq"), F.lit("workout").alias("type"), F.lit("squats").alias("value"))),
    ).when(
        (et == "signup") & (k % 4 == 2),
        F.array(F.struct(seq.alias("seq"), F.lit("strictness").alias("type"), F.lit("strict").alias("value"))),
    ).when(
        et == "signup",
        F.array(F.struct(seq.alias("seq"), F.lit("strictness").alias("type"), F.lit("moderate").alias("value"))),
    ).when(
        et == "purchase",
        F.array(F.struct(seq.alias("seq"), F.lit("reps").alias("type"), (k % 3).cast("string").alias("value"))),
    ).when(
        et.isin("view", "click", "error"),
        F.array(F.struct(seq.alias("seq"), F.lit("frame").alias("type"), F.lit(None).cast("string").alias("value"))),
    ).otherwise(F.array().cast("array<struct<seq:bigint,type:string,value:string>>"))
    out = ev.select("session_id", "ts", "chunk", "k", "event_type", F.inline(msgs))
    is_frame = F.col("type") == "frame"
    return out.select(
        "session_id", "seq", "chunk", "ts", "type", "value",
        F.when(is_frame, F.col("k") * 180 / 99).alias("angle"),
        F.when(is_frame, F.col("event_type") != "error").alias("form"),
    )



# --------------------------------------------------------------------------
# Adapter F: native frame and control tables of pose sessions, from events
# --------------------------------------------------------------------------

def native_sessions(spark: SparkSession, base: str, gaps: bool = False, held: bool = False) -> tuple[DataFrame, DataFrame]:
    """(frames, controls) in the native schemas.

    Controls as adapter E, plus ``strictness`` = strict for signup with
    k % 4 = 2 and moderate for k % 4 = 3.  Frames: view, click and error
    events, each with a 33-point push-up pose (facing side by user parity).
    With ``gaps``, no pose was found in the frames of error events: null
    landmarks for even k, an empty list for odd k.  ``held``: the numbered
    events, still without poses, are kept in a checkpoint, for tables that are
    read several times.
    """
    from ..operators.scan import checkpoint, ensure_parallel, number_frames

    ev = ensure_parallel(read_table(spark, base, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"]))
    ev = ev.select(
        F.col("user_id").alias("session_id"), "ts", "event_id", "event_type", event_k().alias("k"),
        event_theta().alias("theta"), F.round(F.col("value") * 100).cast("bigint").alias("vi"),
        ((F.col("user_id") % 2) == 0).alias("is_left"),
    )
    numbered = number_frames(session_chunk(ev), ["session_id"], EVENT_ORDER, "chunk", frame_col="n0")
    numbered = checkpoint(numbered) if held else numbered
    seq = (F.col("n0") + 1) * 10
    et, k = F.col("event_type"), F.col("k")
    ctl_t = "array<struct<seq:bigint,type:string,value:string>>"
    msgs = F.when(
        (et == "signup") & (k % 4 == 0),
        F.array(
            F.struct(seq.alias("seq"), F.lit("start").alias("type"), F.lit(None).cast("string").alias("value")),
            F.struct((seq + 1).alias("seq"), F.lit("workout").alias("type"), F.lit("push-ups").alias("value")),
        ),
    ).when(
        (et == "signup") & (k % 4 == 1),
        F.array(F.struct(seq.alias("seq"), F.lit("workout").alias("type"), F.lit("squats").alias("value"))),
    ).when(
        (et == "signup") & (k % 4 == 2),
        F.array(F.struct(seq.alias("seq"), F.lit("strictness").alias("type"), F.lit("strict").alias("value"))),
    ).when(
        (et == "signup") & (k % 4 == 3),
        F.array(F.struct(seq.alias("seq"), F.lit("strictness").alias("type"), F.lit("moderate").alias("value"))),
    ).when(
        et == "purchase",
        F.array(F.struct(seq.alias("seq"), F.lit("reps").alias("type"), (k % 3).cast("string").alias("value"))),
    ).otherwise(F.array().cast(ctl_t))
    controls = numbered.select("session_id", "ts", F.inline(msgs))
    posed, pose = with_pushup_pose(numbered.where(et.isin("view", "click", "error"))), F.col("landmarks")
    if gaps:
        pose = F.when(et != "error", pose).when(k % 2 == 1, F.slice(pose, 1, 0))
    frames = posed.select("session_id", seq.alias("seq"), "ts", pose.alias("landmarks"))
    return frames, controls
