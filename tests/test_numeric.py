import math

import numpy as np
import pytest

from repsight.functions.numeric import joint_angle, js_to_fixed0, np_round, py_fixed, py_round, round6, sql_round


@pytest.mark.parametrize(
    "p1,p2,p3,expected",
    [
        ((0, 0), (1, 1), (1, 0), 45.0),
        ((0, 0), (0, 1), (1, 1), 90.0),
        ((0, 0), (0, 1), (1, 2), 135.0),
        ((0, 0), (0, 1), (0, 2), 180.0),
    ],
)
def test_angle_golden(spark, p1, p2, p3, expected):
    df = spark.createDataFrame([(float(p1[0]), float(p1[1]), float(p2[0]), float(p2[1]), float(p3[0]), float(p3[1]))],
                               "ax double, ay double, bx double, by double, cx double, cy double")
    got = df.select(joint_angle("ax", "ay", "bx", "by", "cx", "cy").alias("a")).first()["a"]
    assert got == pytest.approx(expected)


def test_angle_null_point_and_zero_limb(spark):
    df = spark.createDataFrame(
        [(0.0, 0.0, 1.0, 0.0, None, None), (1.0, 1.0, 1.0, 1.0, 2.0, 2.0)],
        "ax double, ay double, bx double, by double, cx double, cy double",
    )
    got = [r["a"] for r in df.select(joint_angle("ax", "ay", "bx", "by", "cx", "cy").alias("a")).collect()]
    assert got[0] is None  # missing point: bad input
    assert math.isnan(got[1])  # zero-length limb: NaN as numpy


def test_rounding_rules(spark):
    vals = [0.575, 0.25, 0.35, 0.45, 2.675, 1.005, 0.125, 179.995, 0.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select(
        "x",
        np_round("x", 1).alias("np1"), np_round("x", 2).alias("np2"),
        sql_round("x", 1).alias("sq1"), sql_round("x", 2).alias("sq2"),
        py_round("x", 2).alias("py2"), py_fixed("x", 1).alias("f1"), py_fixed("x", 2).alias("f2"),
        js_to_fixed0("x").alias("js"),
    ).collect()
    for r in rows:
        x = r["x"]
        assert r["np1"] == float(np.round(x, 1))
        assert r["np2"] == float(np.round(x, 2))
        assert r["py2"] == round(x, 2)
        assert r["f1"] == f"{x:.1f}"
        assert r["f2"] == f"{x:.2f}"
        assert r["sq1"] == math.floor(x * 10 + 0.5) / 10
        assert r["js"] == math.floor(x + 0.5)


def test_py_fixed_nan_and_round6(spark):
    df = spark.createDataFrame([(float("nan"),), (1.23456749,), (1e15,)], "x double")
    r = df.select(py_fixed("x", 1).alias("t"), round6("x").alias("r")).collect()
    assert r[0]["t"] == "nan" and math.isnan(r[0]["r"])
    assert r[1]["r"] == 1.234567
    assert r[2]["r"] == 1e15


def test_invert_map(spark):
    from repsight.functions.numeric import invert_map

    df = spark.createDataFrame([({11: "shoulder", 13: "elbow"},)], "m map<int,string>")
    got = df.select(invert_map("m").alias("r")).first()["r"]
    assert got == {"shoulder": 11, "elbow": 13}
    odd = spark.createDataFrame([({1: "a", 2: "b", 3: "a", 4: None},), ({},), (None,)], "m map<int,string>")
    assert [r["r"] for r in odd.select(invert_map("m").alias("r")).collect()] == [{"b": 2, "a": 3}, {}, None]
