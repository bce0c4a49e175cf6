"""Registered queries: summaries, prompt rows, responses, quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round6
from ..operators import analytics as AN
from ..operators import quality as Q
from ..operators import sessions as S
from ..operators import text as TX
from .registry import query
from .sessions import session_segments
from .sets import raw_table, set_tables

GENERATED_AT = "2024-02-01 00:00:00"


def set_summary_frame(spark: SparkSession, base: str) -> DataFrame:
    """One keyed row per set with every scalar and text the prompt needs."""
    w, an = set_tables(spark, base)
    return summarize_sets(w, an)


def summarize_sets(w: DataFrame, an: DataFrame) -> DataFrame:
    """A14 from the ``workout`` and ``workout_analysis`` tables."""
    params = AN.set_params(w, an)
    trim = AN.trimmed(an, params)
    meta = AN.set_metadata(w, an).select(F.col("id").alias("workout_id"), "duration")
    spans = AN.rep_spans(trim)
    out = (
        params.select("workout_id", "workout_name", "series_number", "rep_goal", "strictness_crit",
                      "strictness_definition", "frame_start")
        .join(meta, "workout_id", "left")
        .join(AN.total_reps(trim), "workout_id", "left")
        .join(AN.avg_rep_time(spans), "workout_id", "left")
        .join(TX.issue_summary(AN.issue_histogram(trim)), "workout_id", "left")
        .join(TX.worst_rep_summary(AN.worst_reps(trim)), "workout_id", "left")
    )
    return out.withColumns(
        {
            "issue_summary": F.coalesce(F.col("issue_summary"), F.lit("")),
            "worst_reps_summary": F.coalesce(F.col("worst_reps_summary"), F.lit("")),
        }
    )


@query("issue_summary_text")
def issue_summary_text(spark: SparkSession, base: str) -> DataFrame:
    w, an = set_tables(spark, base)
    return TX.issue_summary(AN.issue_histogram(AN.trimmed(an, AN.set_params(w, an))))


@query("worst_rep_text")
def worst_rep_text(spark: SparkSession, base: str) -> DataFrame:
    w, an = set_tables(spark, base)
    return TX.worst_rep_summary(AN.worst_reps(AN.trimmed(an, AN.set_params(w, an))))


def _summary_view(s: DataFrame) -> DataFrame:
    return s.select(
        "workout_id", "workout_name", F.col("series_number").cast("bigint").alias("series_number"),
        F.col("rep_goal").cast("bigint").alias("rep_goal"), "strictness_crit", "frame_start",
        round6("duration").alias("duration"), "total_repetitions",
        round6("average_time_repetitions").alias("average_time_repetitions"), "issue_summary", "worst_reps_summary",
    )


@query("set_summary")
def set_summary(spark: SparkSession, base: str) -> DataFrame:
    return _summary_view(set_summary_frame(spark, base))


@query("latest_set_summary")
def latest_set_summary(spark: SparkSession, base: str) -> DataFrame:
    """The single-set mode: summary of the set with the highest id.

    The latest id is a one-row aggregate, broadcast (size 1).  It reduces both
    tables first, so only that set's rows reach the analytics.
    """
    w, an = set_tables(spark, base)
    latest = F.broadcast(w.agg(F.max("id").alias("id")))
    w = w.join(latest, "id", "left_semi")
    an = an.join(latest.withColumnRenamed("id", "workout_id"), "workout_id", "left_semi")
    return _summary_view(summarize_sets(w, an))


@query("stored_set_summary")
def stored_set_summary(spark: SparkSession, base: str) -> DataFrame:
    """Store the three tables of the sets in the shared folder, read them back
    and run the analytics pack on the stored tables (S4-S8, S11)."""
    import uuid

    from ..operators.tables import read_sets, save_sets
    from ..session import ensure_checkpoint_dir

    w, an = set_tables(spark, base)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/sets-{uuid.uuid4().hex}"
    save_sets(w, an, raw_table(spark, base), path)
    w2, an2, _raw = read_sets(spark, path)
    return _summary_view(summarize_sets(w2, an2))


@query("prompt_rows")
def prompt_rows(spark: SparkSession, base: str) -> DataFrame:
    return TX.prompt_rows(_prompt_values(*set_tables(spark, base)))


def _prompt_values(w: DataFrame, an: DataFrame) -> DataFrame:
    """The set summaries with their angle statistics as text."""
    stats = AN.angle_stats(AN.trimmed(an, AN.set_params(w, an)))
    stats = stats.select("workout_id", "column", "count", *[round6(c).alias(c) for c in
                                                             ("mean", "std", "min", "p25", "p50", "p75", "max")])
    return summarize_sets(w, an).join(TX.stats_text(stats), "workout_id", "left")


@query("session_prompts")
def session_prompts(spark: SparkSession, base: str) -> DataFrame:
    """Prompts of the sets of pose sessions, each with the rolling summary that the
    responses to the session's earlier sets left (X3, X4, W9)."""
    from ..operators import pose_sessions as PS
    from ..operators.scan import checkpoint
    from ..operators.store import number_rows
    from .native import native_segments

    seg = checkpoint(native_segments(spark, base)[0])
    key = ["session_id", "series_number"]
    sets = S.completed_sets(seg)
    rolling = TX.rolling_summaries(TX.parse_responses(response_texts(sets)))
    rolling = number_rows(sets.select(key), key, "workout_id").join(rolling, key)
    w, an, _raw = PS.set_tables(seg)
    values = _prompt_values(w, an).join(rolling.select("workout_id", "previous_rolling_summary"), "workout_id")
    return TX.prompt_rows(values, F.col("previous_rolling_summary"))


def responses(spark: SparkSession, base: str) -> DataFrame:
    """Stored coaching responses, one per completed set of the sessions (adapter E)."""
    return response_texts(S.completed_sets(session_segments(spark, base)))


def response_texts(sets: DataFrame) -> DataFrame:
    """One response per completed set.

    Built with ``to_json``: every third set wraps the JSON in a fenced block;
    sets whose repetition count is 3 mod 4 lack the ``summary`` field.
    """
    ser, reps = F.col("series_number").cast("string"), F.col("reps").cast("string")
    body = F.to_json(
        F.struct(
            F.concat(F.lit("Well done on set "), ser, F.lit("!")).alias("encouragement"),
            F.concat(F.lit("You completed "), reps, F.lit(" "), F.col("exercise_at_end"), F.lit(".")).alias("positive_point"),
            F.concat(F.lit("Keep a steady form over all "), F.col("frames").cast("string"), F.lit(" frames.")).alias("main_feedback"),
            F.concat(F.lit("The goal was "), F.col("rep_goal").cast("string"), F.lit(" reps.")).alias("secondary_feedback"),
            F.when(F.col("reps") % 4 != 3, F.concat(F.lit("Set "), ser, F.lit(" of "), F.col("workout_name"), F.lit(" done.")))
            .alias("summary"),
            F.concat(F.lit("After set "), ser, F.lit(": "), reps, F.lit(" "), F.col("exercise_at_end"), F.lit(".")).alias("Rolling_Summary"),
        )
    )
    wrapped = F.when(F.col("series_number") % 3 == 2, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return sets.select("session_id", "series_number", wrapped.alias("response"))


@query("parsed_responses")
def parsed_responses(spark: SparkSession, base: str) -> DataFrame:
    return TX.parse_responses(responses(spark, base))


@query("rolling_summary")
def rolling_summary(spark: SparkSession, base: str) -> DataFrame:
    r = TX.rolling_summaries(TX.parse_responses(responses(spark, base)))
    return r.select("session_id", "series_number", "previous_rolling_summary")


@query("feedback_text")
def feedback_text(spark: SparkSession, base: str) -> DataFrame:
    f = TX.feedback_block(TX.parse_responses(responses(spark, base)), F.lit(GENERATED_AT))
    return f.select("session_id", "series_number", "feedback_html")


@query("quality_nulls")
def quality_nulls(spark: SparkSession, base: str) -> DataFrame:
    w, an = set_tables(spark, base)
    wcols = ["id", "workout_name", "timestamp_start", "rep_goal", "strictness_crit", "strictness_definition",
             "left_side", "ldmrks_of_interest"]
    acols = ["workout_id", "frame", "timestamp", "rep_count", "down", "form_issues", "angles_data"]
    return Q.null_counts(w, "workout", wcols).unionByName(Q.null_counts(an, "workout_analysis", acols))


@query("quality_pk")
def quality_pk(spark: SparkSession, base: str) -> DataFrame:
    w, an = set_tables(spark, base)
    raw = raw_table(spark, base)
    return (
        Q.key_summary(w, "workout", ["id"])
        .unionByName(Q.key_summary(an, "workout_analysis", ["workout_id", "timestamp"]))
        .unionByName(Q.key_summary(raw, "raw_landmarks", ["workout_id", "frame"]))
    )


@query("quality_fk")
def quality_fk(spark: SparkSession, base: str) -> DataFrame:
    """Orphan rows per child table, and frames of sets that get no feedback."""
    w, an = set_tables(spark, base)
    raw = raw_table(spark, base)
    starts = AN.start_frames(an)
    no_feedback = an.join(starts, "workout_id", "left_anti")
    parts = [
        Q.orphans(an, w, "workout_id", "id").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit("workout_analysis -> workout").alias("check"), "rows"),
        Q.orphans(raw, w, "workout_id", "id").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit("raw_landmarks -> workout").alias("check"), "rows"),
        no_feedback.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("frames of sets without start frame").alias("check"), "rows"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
