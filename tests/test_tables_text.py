
from pyspark.sql import functions as F

from repsight import constants as K
from repsight.operators import tables as TB
from repsight.operators import text as TX
from repsight.schemas import POSE
from repsight.sources.landmarks import landmark_dimension, read_landmark_csv, split_valid_poses


def test_flatten_typical_empty_and_missing(spark):
    full = [dict(x=float(i), y=float(-i), visibility=0.3) for i in range(33)]
    df = spark.createDataFrame([(1, full), (2, []), (3, full[:3])], f"id long, landmarks {POSE.simpleString()}")
    flat = TB.flatten_landmarks(df, keep=("id",)).orderBy("id").collect()
    assert len(flat[0]) == 1 + 66
    assert flat[0]["landmark_5_x"] == 5.0 and flat[0]["landmark_5_y"] == -5.0
    assert flat[1]["landmark_0_x"] is None
    assert flat[2]["landmark_2_y"] == -2.0 and flat[2]["landmark_3_x"] is None


def test_pose_validation_rejects(spark):
    good = [dict(x=0.1, y=0.2, visibility=None) for _ in range(33)]
    bad_x = [dict(x=None, y=0.2, visibility=0.0)] + good[1:]
    df = spark.createDataFrame([(1, good), (2, bad_x), (3, good[:12]), (4, None)], f"id long, landmarks {POSE.simpleString()}")
    ok, rej = split_valid_poses(df)
    assert [r["id"] for r in ok.collect()] == [1]
    reasons = {r["id"]: r["reject_reason"] for r in rej.collect()}
    assert reasons == {2: "invalid landmark", 3: "too few landmarks", 4: "no pose"}


def test_landmark_csv_reader(spark, tmp_path):
    lines = ["index,side,name"] + [
        f"{i} , {'' if s is None else s}, {n}" for i, s, n in K.LANDMARK_DIMENSION
    ]
    p = tmp_path / "landmarks.csv"
    p.write_text("\n".join(lines) + "\n")
    got = read_landmark_csv(spark, str(p)).orderBy("index").collect()
    expected = landmark_dimension(spark).orderBy("index").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in expected]
    assert got[0]["side"] is None and got[13]["name"] == "elbow"


def test_parse_responses(spark):
    full = '{"encouragement":"a","positive_point":"b","main_feedback":"c","secondary_feedback":"d","summary":"e","Rolling_Summary":"f"}'
    rows = [(1, 1, full), (1, 2, "```json\n" + full + "\n```"), (1, 3, '{"encouragement":"a"}'), (1, 4, "not json"),
            (1, 5, full.replace('"f"', '"g"'))]
    df = spark.createDataFrame(rows, "session_id long, series_number long, response string")
    p = TX.parse_responses(df)
    st = {r["series_number"]: r["status"] for r in p.collect()}
    assert st == {1: "parsed", 2: "parsed", 3: "rejected", 4: "rejected", 5: "parsed"}
    r = TX.rolling_summaries(p).orderBy("series_number").collect()
    assert [x["previous_rolling_summary"] for x in r] == [K.FIRST_ROLLING_SUMMARY, "f", "f", "f", "f"]


def test_fill_template(spark):
    df = spark.createDataFrame([("x", 3)], "a string, b int")
    out = df.select(TX.fill("A={a}; B={b}.", {"a": F.col("a"), "b": F.col("b").cast("string")}).alias("t")).first()
    assert out["t"] == "A=x; B=3."


def test_writers_round_trip(spark, tmp_path):
    from repsight.plans.sets import raw_table, set_tables

    base = "/root/testdata/sf0.001"
    w, an = set_tables(spark, base)
    raw = raw_table(spark, base)
    out = str(tmp_path / "store")
    TB.save_sets(w, an, raw, out)
    w2 = spark.read.parquet(f"{out}/workout")
    a2 = spark.read.parquet(f"{out}/workout_analysis")
    r2 = spark.read.parquet(f"{out}/raw_landmarks")
    assert w2.count() == w.count() and a2.count() == an.count() and r2.count() == raw.count()
    assert [f.name for f in a2.schema.fields] == ["workout_id", "frame", "timestamp", "rep_count", "down",
                                                  "form_issues", "angles_data"]
    assert len(r2.columns) == 3 + 66
    # nested angles round-trip intact
    assert a2.select(F.size("angles_data").alias("n")).distinct().collect()[0]["n"] == 2


def test_parse_controls(spark):
    from repsight.sources.controls import parse_controls

    rows = [(1, '{"type":"reps","value":5}'), (2, '{"type":"start","value":true}'), (3, '{"type":"workout","value":"squats"}'),
            (4, '{"value":"x"}'), (5, '{"type":"reps","value":'), (6, '{"type":"strictness"}')]
    df = spark.createDataFrame(rows, "seq long, message string")
    ok, rej = parse_controls(df)
    got = {r["seq"]: (r["type"], r["value"]) for r in ok.collect()}
    assert got == {1: ("reps", "5"), 2: ("start", "true"), 3: ("workout", "squats"), 6: ("strictness", None)}
    assert {r["seq"]: r["reject_reason"] for r in rej.collect()} == {4: "no type", 5: "malformed JSON"}


def test_parse_pose_json_rejects_bad_coordinates(spark):
    from repsight.sources.landmarks import parse_pose_json

    def pose(first: str) -> str:
        rest = ",".join('{"x":0.5,"y":0.5}' for _ in range(32))
        return f"[{first},{rest}]"

    rows = [
        (1, pose('{"x":1,"y":1,"visibility":0.2}')),
        (2, pose('{"x":"not a number","y":1}')),
        (3, pose('{"x":null,"y":1}')),
        (4, pose('{"x":[1,2],"y":1}')),
        (5, pose('{"x":{"x":1},"y":1}')),
        (6, pose('{"x":1}')),
    ]
    ok, rej = parse_pose_json(spark.createDataFrame(rows, "id long, pose_json string"))
    good = ok.collect()
    assert [r["id"] for r in good] == [1]
    assert good[0]["landmarks"][1]["visibility"] == 0.0  # default
    assert sorted(r["id"] for r in rej.collect()) == [2, 3, 4, 5, 6]


def test_letterbox_golden(spark):
    from repsight.operators.geometry import letterbox

    df = spark.createDataFrame([(640, 480), (480, 640), (256, 256), (1920, 1080)], "w int, h int")
    got = {(r["w"], r["h"]): (r["new_w"], r["new_h"], r["x_off"], r["y_off"]) for r in letterbox(df, "w", "h").collect()}
    assert got[(640, 480)] == (256, 192, 0, 32)
    assert got[(480, 640)] == (192, 256, 32, 0)
    assert got[(256, 256)] == (256, 256, 0, 0)
    assert got[(1920, 1080)] == (256, 144, 0, 56)


def test_frame_message_without_pose(spark):
    import json

    from repsight.operators.text import frame_message

    df = spark.createDataFrame([(None, 3, True, "x", None, False, False)],
                               f"lm {POSE.simpleString()}, reps long, ok boolean, msg string, "
                               "ang array<struct<name:string,value:double,joint_indices:array<int>>>, "
                               "down boolean, has_pose boolean")
    m = json.loads(df.select(frame_message(F.col("lm"), F.col("reps"), F.col("ok"), F.col("msg"), F.col("ang"),
                                           F.col("down"), F.col("has_pose")).alias("j")).first()["j"])
    assert m == {"landmarks": [], "rep_count": 3, "form_ok": True, "form_message": "Initializing...",
                 "display_angles": [], "is_down_phase": False}


def test_prompt_says_the_format_and_the_earlier_sets(spark):
    """The system prompt asks for the fields that the parser needs; each set is told what came before it."""
    cols = ("workout_id long, rep_goal int, workout_name string, series_number int, strictness_crit string, "
            "strictness_definition double, duration double, total_repetitions long, average_time_repetitions double, "
            "issue_summary string, worst_reps_summary string, angle_stats_text string, rolling string")
    rows = [(1, 3, "squats", 2, "strict", 10.0, 12.5, 3, 4.17, "Bend (2 times)", "Rep 1 (2 issues)", "stats", "Set 1 went {well}."),
            (2, None, None, None, None, None, None, None, None, None, None, None, "")]
    out = TX.prompt_rows(spark.createDataFrame(rows, cols), F.col("rolling")).orderBy("workout_id").collect()
    lines = out[0].system_prompt.split("\n")
    assert lines[0] == ("You are a data-driven fitness coach. The user's goal was 3 squats. This is set number 2 of the session. "
                        "Form strictness: 'strict' (allowed deviation 10.0 degrees).")
    assert [x.split('"')[1] for x in lines[2:]] == ["encouragement", "positive_point", "main_feedback", "secondary_feedback",
                                                    "summary", "Rolling_Summary"]
    assert out[0].user_prompt == (
        "What happened before this set:\nSet 1 went {well}.\n\nSet 2 took 12.50 s; 3 repetitions were counted, one every 4.17 s "
        "on average.\nFrames by form message: Bend (2 times)\nWhere form failed most often: Rep 1 (2 issues)\n\n"
        "Joint angles over the set:\nstats")
    assert "goal was N/A N/A" in out[1].system_prompt and "took 0 s; 0 repetitions" in out[1].user_prompt
