"""Typed messages, the validation step, damaged files and orphans of streams."""

import json

from pyspark.sql import Observation
from pyspark.sql import functions as F

from repsight.operators import messages as M
from repsight.operators import validation as V


def test_values_keep_their_json_type(spark):
    given = ['3', '3.7', '-3.7', '"3"', '"3.7"', '" +4 "', 'true', 'false', 'null', '[3]', '{"a":3}', '1e2', '99999999999', '"x"']
    want = [3, 3, -3, 3, None, 4, 1, 0, None, None, None, 100, None, None]
    rows = [(i, f'{{"type":"reps","value":{v}}}') for i, v in enumerate(given)] + [
        (20, '{"type":"reps"}'), (21, '{"type":"workout","value":"squats"}'), (22, '{"value":1}'), (23, '{"type":'), (24, None), (25, '[1]')
    ]
    df = spark.createDataFrame(rows, "seq long, message string")
    got = {r.seq: r for r in M.typed_controls(df).collect()}
    assert [got[i].goal for i in range(len(given))] == want
    assert {i for i in range(len(given)) if got[i].reject_reason} == {i for i, w in enumerate(want) if w is None}
    assert got[20].goal == 1 and (got[21].type, got[21].value, got[21].goal, got[21].reject_reason) == ("workout", "squats", None, None)
    assert [got[i].reject_reason for i in (22, 23, 24, 25)] == ["no type", "malformed JSON", "malformed JSON", "no type"]


def test_envelopes_are_read_back(spark):
    df = spark.createDataFrame([('say "hi"\n<br>é💪', "ready"), (None, None)], "m string, s string")
    out = M.read_envelopes(df.select(M.envelope("data", F.col("m"), F.col("s")).alias("envelope"), "m")).collect()
    assert json.loads(out[0].envelope) == {"type": "data", "message": 'say "hi"\n<br>é💪', "status": "ready"}
    assert (out[0].type, out[0].message, out[0].status) == ("data", out[0].m, "ready") and out[1].type == "data"


def test_one_validation_step_has_two_outputs_and_counts(spark):
    rows = [(1, "push-ups", "Strict", 0.5), (2, "abs", "harsh", None), (3, "squats", "harsh", 0.1), (4, "squats", None, 0.1),
            (5, "squats", "loose", float("nan")), (6, "squats", "loose", float("inf")), (7, None, "loose", 1.0)]
    df = spark.createDataFrame(rows, "id long, exercise string, strictness string, x double")
    rules = V.setting_rules() | V.coordinate_rule("x")
    good, bad = V.split(df, rules)
    assert [r.id for r in good.collect()] == [1] and good.columns == df.columns
    assert {r.id: r.reject_reason for r in bad.collect()} == {
        2: "unknown exercise", 3: "unknown strictness", 4: "unknown strictness", 5: "broken coordinates",
        6: "broken coordinates", 7: "unknown exercise",
    }
    seen = Observation("validation")
    assert V.checked(df, rules, seen).count() == 7
    assert seen.get == {"rows": 7, "unknown exercise": 2, "unknown strictness": 2, "broken coordinates": 2}


def test_damaged_landmark_lines_are_kept(spark, tmp_path):
    from repsight.sources.landmarks import read_damaged_landmark_csv

    (tmp_path / "l.csv").write_text("index,side,name\n0 , ,nose\n1 , left, inner eye \nx , left,ear\n2 , left\n3 , left,eye,5\n\n")
    got = [tuple(r) for r in read_damaged_landmark_csv(spark, str(tmp_path / "l.csv")).collect()]
    assert got[:2] == [(0, None, "nose", None), (1, "left", "inner eye", None)]
    assert [r[3] for r in got[2:]] == ["x , left,ear", "2 , left", "3 , left,eye,5"]
