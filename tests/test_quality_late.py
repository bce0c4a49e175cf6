"""Quality checks on injected faults; late rows in the streaming frame state."""

import datetime as dt
import time

from pyspark.sql import functions as F

from repsight.operators import quality as Q


def test_quality_checks_find_injected_faults(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b2")], "id long, name string")
    child = spark.createDataFrame([(1, 10, None), (1, 10, "x"), (3, 11, "y")], "workout_id long, frame int, note string")
    ks = Q.key_summary(parent, "workout", ["id"]).first()
    assert (ks["rows"], ks["distinct_keys"], ks["duplicate_keys"]) == (3, 2, 1)
    ck = Q.key_summary(child, "workout_analysis", ["workout_id", "frame"]).first()
    assert ck["duplicate_keys"] == 1
    nulls = {r["column"]: r["nulls"] for r in Q.null_counts(child, "t", ["workout_id", "note"]).collect()}
    assert nulls == {"workout_id": 0, "note": 1}
    orphans = Q.orphans(child, parent, "workout_id", "id")
    assert [r["workout_id"] for r in orphans.collect()] == [3]


def test_stream_late_rows_do_not_change_state(spark, tmp_path):
    from repsight.streaming.frames import frame_state_stream, run_to_table

    t0 = dt.datetime(2024, 1, 1)
    first = [(1, t0 + dt.timedelta(seconds=i), i, a, True) for i, a in enumerate([170.0, 60.0, 170.0])]
    late = [(1, t0 + dt.timedelta(seconds=1, milliseconds=500), 99, 60.0, True)]  # older than processed rows
    later = [(1, t0 + dt.timedelta(seconds=10), 10, 60.0, True), (1, t0 + dt.timedelta(seconds=11), 11, 170.0, True)]
    schema = "workout_id long, ts timestamp_ntz, event_id long, angle double, form boolean"
    path = str(tmp_path / "sig")
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(path)
    time.sleep(1.1)
    spark.createDataFrame(late + later, schema).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = run_to_table(spark, frame_state_stream(src), "late").orderBy("ts").collect()
    by_id = {r["event_id"]: r for r in out}
    assert by_id[99]["late"] and by_id[99]["frame"] is None
    # the processed sequence 170, 60, 170 | 60, 170 gives two repetitions and frames 0..4
    assert [by_id[i]["frame"] for i in (0, 1, 2, 10, 11)] == [0, 1, 2, 3, 4]
    assert by_id[11]["rep_count"] == 2
