"""Per-set analytics over the stored tables, for all sets at once.

Every function takes the ``workout`` and/or ``workout_analysis`` tables and
returns a DataFrame keyed by ``workout_id``.  Per-set scalars (start frame,
goal, landmark map) form a small ``params`` table joined by ``workout_id``;
AQE broadcasts it when its runtime size is below the broadcast threshold and
otherwise plans a sort-merge join whose hot partitions it splits (skew join).
Aggregates are partial (map-side) before any exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numeric import np_round, py_round, sql_round
from .exercises import DISPLAY_ANGLES
from .scan import number_frames


def seconds_between(a: Column | str, b: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def is_issue(col: Column, good_match: str = "exact") -> Column:
    """Issue frames: not equal to the push-up good label (faithful, ``exact``), or
    not starting with ``Good`` (``prefix``)."""
    if good_match == "prefix":
        return F.substring(col, 1, 4) != F.lit(K.GOOD_PREFIX)
    return ~col.like(K.GOOD_LABEL_EXACT)


# ---------------------------------------------------------------------------
# Start frame and set metadata
# ---------------------------------------------------------------------------

def start_frames(analysis: DataFrame) -> DataFrame:
    """First frame whose form text starts with 'Good', minus 10 (may be negative).

    Sets without such a frame get no row (no feedback for them).
    """
    good = F.substring("form_issues", 1, 4) == F.lit(K.GOOD_PREFIX)
    return (
        analysis.where(good)
        .groupBy("workout_id")
        .agg((F.min("frame") - K.SETUP_BACKTRACK_FRAMES).cast("bigint").alias("frame_start"))
    )


def set_params(workout: DataFrame, analysis: DataFrame) -> DataFrame:
    """Per-set scalars used by the other queries: start frame, goal, landmark map."""
    return start_frames(analysis).join(
        workout.select(
            F.col("id").alias("workout_id"), "rep_goal", "ldmrks_of_interest", "workout_name", "series_number",
            "strictness_crit", "strictness_definition",
        ),
        "workout_id",
        "inner",
    )


def trimmed(analysis: DataFrame, params: DataFrame) -> DataFrame:
    """Frames at or after the set's start frame, with the set's scalars attached."""
    return analysis.join(params, "workout_id", "inner").where(F.col("frame") >= F.col("frame_start"))


def set_metadata(workout: DataFrame, analysis: DataFrame) -> DataFrame:
    """Set row + ``end_time`` (last frame time) + ``duration`` (Python-rounded seconds)."""
    ends = analysis.groupBy("workout_id").agg(F.max("timestamp").alias("end_time"))
    m = workout.join(ends, workout["id"] == ends["workout_id"], "left").drop("workout_id")
    return m.withColumn("duration", py_round(seconds_between("timestamp_start", "end_time"), 2))


# ---------------------------------------------------------------------------
# repetitions
# ---------------------------------------------------------------------------

def total_reps(trim: DataFrame) -> DataFrame:
    return trim.groupBy("workout_id").agg(F.max("rep_count").cast("bigint").alias("total_repetitions"))


def rep_spans(trim: DataFrame) -> DataFrame:
    """Per repetition up to the goal: first/last frame and duration (SQL-rounded to 0.1 s)."""
    reps = (F.col("rep_count") + 1).cast("bigint")
    return (
        trim.where(reps <= F.col("rep_goal"))
        .groupBy("workout_id", "rep_count")
        .agg(
            F.min("frame").cast("bigint").alias("start_frame"),
            F.max("frame").cast("bigint").alias("end_frame"),
            F.min("timestamp").alias("t0"),
            F.max("timestamp").alias("t1"),
        )
        .select(
            "workout_id", "start_frame", "end_frame",
            (F.col("rep_count") + 1).cast("bigint").alias("repetitions"),
            sql_round(seconds_between("t0", "t1"), 1).alias("duration"),
        )
    )


def avg_rep_time(spans: DataFrame) -> DataFrame:
    """Mean of the rounded durations, numpy-rounded to 2 decimals.

    Durations carry one decimal, so the mean is taken from the exact integer
    sum of tenths (one correctly rounded division).
    """
    tenths = F.round(F.col("duration") * 10).cast("bigint")
    mean = F.sum(tenths).cast("double") / (F.count(tenths).cast("double") * 10.0)
    return spans.groupBy("workout_id").agg(np_round(mean, 2).alias("average_time_repetitions"))


# ---------------------------------------------------------------------------
# issues
# ---------------------------------------------------------------------------

def issue_histogram(trim: DataFrame) -> DataFrame:
    return trim.groupBy("workout_id", "form_issues").agg(F.count(F.lit(1)).alias("count"))


def issue_frames(trim: DataFrame, good_match: str = "exact") -> DataFrame:
    """Frames of each issue as runs of consecutive frames (gaps and islands).

    One row per run: first frame, last frame, frame count.  The run id is the
    frame minus its position among the set's frames with that issue, computed
    by a chunked scan (no whole-set window).
    """
    f = trim.where(is_issue(F.col("form_issues"), good_match)).select(
        "workout_id", "form_issues", "frame", F.shiftright(F.col("frame").cast("bigint"), 16).alias("chunk")
    )
    pos = number_frames(f, ["workout_id", "form_issues"], ["frame"], "chunk", frame_col="pos", materialize=True)
    return (
        pos.withColumn("run", F.col("frame") - F.col("pos"))
        .groupBy("workout_id", "form_issues", "run")
        .agg(
            F.min("frame").cast("bigint").alias("first_frame"),
            F.max("frame").cast("bigint").alias("last_frame"),
            F.count(F.lit(1)).alias("frames"),
        )
        .drop("run")
    )


def worst_reps(trim: DataFrame, top: int = 3, good_match: str = "exact") -> DataFrame:
    """Top repetitions by number of issue frames (ties: lower repetition first).

    The per-set ``row_number`` runs on the small per-repetition table and is
    planned with a WindowGroupLimit (partial top-k before the exchange).
    """
    per_rep = (
        trim.where(is_issue(F.col("form_issues"), good_match))
        .groupBy("workout_id", (F.col("rep_count") + 1).cast("bigint").alias("repetitions"))
        .agg(F.count("form_issues").alias("count"))
    )
    w = Window.partitionBy("workout_id").orderBy(F.desc("count"), F.asc("repetitions"))
    return per_rep.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# ---------------------------------------------------------------------------
# angles
# ---------------------------------------------------------------------------

def angle_names(analysis: DataFrame) -> DataFrame:
    """Distinct angle names over all sets (one row, sorted list)."""
    names = analysis.select(F.inline("angles_data")).select("name").distinct()
    return names.agg(F.array_sort(F.collect_list("name")).alias("angle_names"))


def all_angle_names() -> list[str]:
    out: list[str] = []
    for specs in DISPLAY_ANGLES.values():
        for name, _feat, _parts in specs:
            if name not in out:
                out.append(name)
    return out


def _name_is(name: str):
    def pred(a: Column) -> Column:
        return a["name"] == F.lit(name)

    return pred


def angle_pivot(trim: DataFrame, names: list[str] | None = None, issues_only: bool = False,
                good_match: str = "exact") -> DataFrame:
    """One row per frame: ``{name}_angle`` (SQL-rounded to 2) and ``{name}_indices``.

    The pivot reads the nested array directly (``filter(angles_data, name = n)``)
    instead of exploding and regrouping: each frame already is one row.  Joint
    indices are mapped to body-part names through the set's landmark map (J2).
    """
    names = names or all_angle_names()
    src = trim.where(is_issue(F.col("form_issues"), good_match)) if issues_only else trim
    cols = []
    m = F.col("ldmrks_of_interest")
    for n in names:
        hit = F.get(F.filter("angles_data", _name_is(n)), 0)
        cols.append(sql_round(hit["value"], 2).alias(f"{n}_angle"))
        cols.append(F.transform(hit["joint_indices"], lambda i: F.element_at(m, i)).alias(f"{n}_indices"))
    return src.select("workout_id", F.col("frame").cast("bigint").alias("frame"), *cols)


def exact_moments(value: Column, scale: Column) -> list[Column]:
    """count, mean and sample std from exact integer sums.

    ``value * scale`` is an integer for every input (frame numbers: scale 1;
    values rounded to 2 decimals: scale 100), so the sums are exact and the
    result is one correctly rounded division: the same double on any engine.
    Algebraic aggregates: constant memory, partial aggregation before the
    exchange.
    """
    vi = F.round(value * scale).cast("bigint")
    sq = (vi.cast("decimal(38,0)") * vi.cast("decimal(38,0)"))
    n = F.count(vi)
    s1 = F.sum(vi).cast("double")
    s2 = F.sum(sq)
    sc = F.max(scale).cast("double")
    var_num = (n.cast("decimal(38,0)") * s2 - F.sum(vi).cast("decimal(38,0)") * F.sum(vi).cast("decimal(38,0)")).cast("double")
    var_den = (n * (n - 1)).cast("double")
    return [
        n.alias("count"),
        (s1 / (n.cast("double") * sc)).alias("mean"),
        F.when(n > 1, F.sqrt(var_num / var_den) / sc).alias("std"),
    ]


def describe_long(df: DataFrame, key: str, columns: dict[str, int], dense: tuple[str, ...] = ()) -> DataFrame:
    """Descriptive statistics per (key, column), as ``DataFrame.describe`` gives.

    ``columns``: name -> scale (see ``exact_moments``).  count (non-NaN),
    mean, sample std, min, 25/50/75 % (linear interpolation), max.  NaN is
    missing.  Exact percentiles use Spark's ``percentile`` (its buffer is a
    value->count map: bounded for values rounded to 2 decimals).  Columns in
    ``dense`` hold consecutive integers per key (frame numbers), whose
    quartiles follow exactly from min and max.
    """
    stacked = df.select(
        key,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("column"),
                        F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value"),
                        F.lit(sc).alias("scale"),
                    )
                    for c, sc in columns.items()
                ]
            )
        ),
    )
    v = F.col("value")
    aggs = exact_moments(v, F.col("scale")) + [F.min(v).alias("min"), F.max(v).alias("max")]
    pct_cols = [c for c in columns if c not in dense]
    if pct_cols:
        pv = F.when(~F.col("column").isin(*dense), v) if dense else v
        aggs.append(F.percentile(pv, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("pct"))
    else:
        aggs.append(F.lit(None).cast("array<double>").alias("pct"))
    out = stacked.groupBy(key, "column").agg(*aggs)
    span = F.col("max") - F.col("min")

    def q(i: int, p: float) -> Column:
        if not dense:
            return F.col("pct")[i]
        return F.when(F.col("column").isin(*dense), F.col("min") + F.lit(p) * span).otherwise(F.col("pct")[i])

    return out.select(
        key, "column", "count", "mean", "std", "min",
        q(0, 0.25).alias("p25"), q(1, 0.5).alias("p50"), q(2, 0.75).alias("p75"), "max",
    )


def angle_stats(trim: DataFrame, names: list[str] | None = None) -> DataFrame:
    names = names or all_angle_names()
    piv = angle_pivot(trim, names)
    cols = {"frame": 1, **{f"{n}_angle": 100 for n in names}}
    return describe_long(piv, "workout_id", cols, dense=("frame",))


def interest_coordinates(raw: DataFrame, params: DataFrame) -> DataFrame:
    """Rounded coordinates of the set's landmarks of interest, long form.

    One row per (set, frame, ``{part}_x``/``{part}_y``) from the wide table,
    using the index -> part map of the set.
    """
    xs = F.array(*[F.col(f"landmark_{i}_x") for i in range(K.N_LANDMARKS)])
    ys = F.array(*[F.col(f"landmark_{i}_y") for i in range(K.N_LANDMARKS)])
    j = raw.join(params.select("workout_id", "frame_start", "ldmrks_of_interest"), "workout_id", "inner").where(
        F.col("frame") >= F.col("frame_start")
    )
    entries = F.map_entries("ldmrks_of_interest")
    pairs = F.flatten(
        F.transform(
            entries,
            lambda e: F.array(
                F.struct(F.concat(e["value"], F.lit("_x")).alias("column"), sql_round(F.get(xs, e["key"]), 2).alias("value")),
                F.struct(F.concat(e["value"], F.lit("_y")).alias("column"), sql_round(F.get(ys, e["key"]), 2).alias("value")),
            ),
        )
    )
    return j.select("workout_id", F.col("frame").cast("bigint").alias("frame"), F.inline(pairs))


def landmark_stats(raw: DataFrame, params: DataFrame) -> DataFrame:
    long = interest_coordinates(raw, params)
    v = F.col("value")
    return long.groupBy("workout_id", "column").agg(
        *exact_moments(v, F.lit(100)),
        F.min(v).alias("min"),
        F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("pct"),
        F.max(v).alias("max"),
    ).select(
        "workout_id", "column", "count", "mean", "std", "min",
        F.col("pct")[0].alias("p25"), F.col("pct")[1].alias("p50"), F.col("pct")[2].alias("p75"), "max",
    )
