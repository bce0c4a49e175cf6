"""Chunked scans against sequential models, with chunks small enough that
every carry path (across many chunks, empty chunks of events) is exercised."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from models import latch_sequence
from repsight.operators.scan import Scan, hysteresis_latch, number_frames, prefix_scan


def _random_signal(seed: int, keys: int = 12, n: int = 80):
    rnd = random.Random(seed)
    rows = []
    for k in range(keys):
        length = rnd.randint(1, n)
        for i in range(length):
            r = rnd.random()
            if r < 0.05:
                a = float("nan")
            elif r < 0.12:
                a = 90.0
            elif r < 0.19:
                a = 150.0
            else:
                a = rnd.uniform(0, 180)
            rows.append((k, i * 3 + rnd.randint(0, 2), a, rnd.random() < 0.7, rnd.random() < 0.6))
    return rows


@pytest.mark.parametrize("shift", [0, 2, 5, 30])
def test_latch_matches_sequential_model(spark, shift):
    rows = _random_signal(seed=shift + 7)
    df = spark.createDataFrame(rows, "key long, seq long, angle double, fu boolean, fd boolean")
    df = df.withColumn("chunk", F.shiftright("seq", shift))
    n = number_frames(df, ["key"], ["seq"], "chunk", lags={"pfu": ("fu", False), "pfd": ("fd", False)})
    out = hysteresis_latch(n, ["key"], ["seq"], "chunk", "angle", "pfu", "pfd", 90.0, 150.0)
    got = out.select("key", "seq", "frame", "down", "rep_count").toPandas().sort_values(["key", "seq"])
    pdf = pd.DataFrame(rows, columns=["key", "seq", "angle", "fu", "fd"]).sort_values(["key", "seq"])
    for key, g in pdf.groupby("key"):
        d, r, _f = latch_sequence(list(g["angle"]), list(g["fu"]), list(g["fd"]))
        mine = got[got["key"] == key]
        assert list(mine["frame"]) == list(range(len(g)))
        assert list(mine["down"]) == d
        assert list(mine["rep_count"]) == r


def test_prefix_scan_kinds(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(5):
        for i in range(rnd.randint(1, 60)):
            v = rnd.choice([None, rnd.randint(-5, 5)])
            rows.append((k, i, v))
    df = spark.createDataFrame(rows, "key long, seq long, v long").withColumn("chunk", F.shiftright("seq", 2))
    out = prefix_scan(
        df, ["key"], ["seq"], "chunk",
        [
            Scan("s_in", F.coalesce(F.col("v"), F.lit(0)), "sum"),
            Scan("s_ex", F.coalesce(F.col("v"), F.lit(0)), "sum", inclusive=False),
            Scan("l_in", F.col("v"), "last", default=-99),
            Scan("l_ex", F.col("v"), "last", inclusive=False, default=-99),
            Scan("c", None, "count"),
            Scan("f", F.col("v"), "first"),
        ],
    ).toPandas().sort_values(["key", "seq"])
    pdf = pd.DataFrame(rows, columns=["key", "seq", "v"])
    for key, g in pdf.groupby("key"):
        vals = list(g["v"])
        mine = out[out["key"] == key]
        s = 0
        last = -99
        first = next((x for x in vals if x is not None and not (isinstance(x, float) and math.isnan(x))), None)
        for i, (x, row) in enumerate(zip(vals, mine.itertuples())):
            xv = 0 if x is None or (isinstance(x, float) and math.isnan(x)) else int(x)
            assert row.s_ex == s
            assert row.l_ex == last
            s += xv
            if not (x is None or (isinstance(x, float) and math.isnan(x))):
                last = int(x)
            assert row.s_in == s
            assert row.l_in == last
            assert row.c == i + 1
            if first is None:
                assert row.f is None or math.isnan(row.f)
            else:
                assert row.f == first


def test_latch_plan_shuffles_big_side_once(spark):
    """The frame rows are exchanged once on (key, chunk); later steps reuse it."""
    rows = _random_signal(seed=1)
    df = spark.createDataFrame(rows, "key long, seq long, angle double, fu boolean, fd boolean")
    df = df.withColumn("chunk", F.shiftright("seq", 3))
    n = number_frames(df, ["key"], ["seq"], "chunk", lags={"pfu": ("fu", False), "pfd": ("fd", False)})
    plan = n._jdf.queryExecution().executedPlan().toString()
    # exchanges: frames on (key, chunk) + the small per-chunk summary paths
    assert "hashpartitioning(key" in plan


@pytest.mark.parametrize("max_rows", [1, 5, 10_000])
def test_adaptive_chunks_keep_results(spark, max_rows):
    """Refined (hot) and coarse chunks give the same latch as the model."""
    from repsight.operators.scan import adaptive_chunk

    rows = _random_signal(seed=max_rows)
    df = spark.createDataFrame(rows, "key long, seq long, angle double, fu boolean, fd boolean")
    df = adaptive_chunk(df, ["key"], F.shiftright("seq", 6), F.col("seq") % 64, max_rows=max_rows)
    n = number_frames(df, ["key"], ["seq"], "chunk", lags={"pfu": ("fu", False), "pfd": ("fd", False)})
    out = hysteresis_latch(n, ["key"], ["seq"], "chunk", "angle", "pfu", "pfd", 90.0, 150.0)
    got = out.select("key", "seq", "down", "rep_count").toPandas().sort_values(["key", "seq"])
    pdf = pd.DataFrame(rows, columns=["key", "seq", "angle", "fu", "fd"]).sort_values(["key", "seq"])
    for key, g in pdf.groupby("key"):
        d, r, _f = latch_sequence(list(g["angle"]), list(g["fu"]), list(g["fd"]))
        mine = got[got["key"] == key]
        assert list(mine["down"]) == d and list(mine["rep_count"]) == r


def test_hot_key_is_split_and_exact(spark):
    """One key holds ~95% of the rows: it spans many chunks (many tasks), and
    the latch still equals the sequential model."""
    rnd = random.Random(17)
    rows = []
    for k, length in ((0, 6000), (1, 150), (2, 120)):
        for i in range(length):
            rows.append((k, i, rnd.uniform(0, 180), rnd.random() < 0.8, rnd.random() < 0.7))
    df = spark.createDataFrame(rows, "key long, seq long, angle double, fu boolean, fd boolean")
    df = df.withColumn("chunk", F.shiftright("seq", 7))
    assert df.where("key = 0").select("chunk").distinct().count() >= 40
    n = number_frames(df, ["key"], ["seq"], "chunk", lags={"pfu": ("fu", False), "pfd": ("fd", False)})
    out = hysteresis_latch(n, ["key"], ["seq"], "chunk", "angle", "pfu", "pfd", 90.0, 150.0)
    got = out.select("key", "seq", "down", "rep_count").toPandas().sort_values(["key", "seq"])
    pdf = pd.DataFrame(rows, columns=["key", "seq", "angle", "fu", "fd"])
    for key, g in pdf.groupby("key"):
        d, r, _f = latch_sequence(list(g["angle"]), list(g["fu"]), list(g["fd"]))
        mine = got[got["key"] == key]
        assert list(mine["down"]) == d and list(mine["rep_count"]) == r


def test_scan_within_equals_scan_of_all_keys(spark):
    """Counters inside a key give what they give as keys, also where they rise inside a chunk."""
    rnd = random.Random(11)
    rows = []
    for k in range(6):
        a = e = 0
        for i in range(rnd.randint(1, 70)):
            a, e = a + (rnd.random() < 0.1), e + (rnd.random() < 0.1)
            rows.append((k, i, a, e, rnd.choice([None, rnd.randint(-5, 5)]), rnd.choice([60.0, 120.0, 170.0, float("nan")]),
                         rnd.random() < 0.7, rnd.random() < 0.6))
    df = spark.createDataFrame(rows, "key long, seq long, a long, e long, v long, angle double, fu boolean, fd boolean")
    df = df.withColumn("chunk", F.shiftright("seq", 2))

    def scans(keys, within):
        out = prefix_scan(df, keys, ["seq"], "chunk", [
            Scan("s", F.coalesce(F.col("v"), F.lit(0)), "sum"), Scan("sx", F.col("v"), "sum", inclusive=False),
            Scan("l", F.col("v"), "last", default=-99), Scan("lx", F.col("v"), "last", inclusive=False),
            Scan("c", None, "count"), Scan("h", F.col("fu"), "held", default=-7, of="l"),
        ], keep_partitioning=True, within=within)
        out = hysteresis_latch(out, keys, ["seq"], "chunk", "angle", "fu", "fd", 90.0, 150.0, within)
        return out.orderBy("key", "seq")

    names = ["key", "seq", "s", "sx", "l", "lx", "c", "h", "down", "rep_inc", "rep_count"]
    want = scans(["key", "a", "e"], []).select(names).collect()
    got = scans(["key"], ["a", "e"])
    assert got.select(names).collect() == want
    assert any(r["down"] for r in want) and any(r["rep_count"] for r in want)
    assert not [c for c in got.columns if c.startswith("__")]


@pytest.mark.parametrize("shift", [0, 2, 30])
def test_held_value_is_the_scan_of_a_scan(spark, shift):
    """``held`` in one pass: the as-of value at the last marked row, also where that value comes from earlier chunks."""
    rnd = random.Random(shift)
    rows = [(k, i, rnd.choice([None, None, None, rnd.randint(0, 9)]), rnd.random() < 0.15) for k in range(8) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, seq long, v long, mark boolean").withColumn("chunk", F.shiftright("seq", shift))
    out = prefix_scan(df, ["key"], ["seq"], "chunk", [
        Scan("l", F.col("v"), "last", default=-1), Scan("h", F.col("mark"), "held", default=-2, of="l"),
    ])
    got = {(r["key"], r["seq"]): (r["l"], r["h"]) for r in out.collect()}
    for k in range(8):
        last, held = -1, -2
        for key, seq, v, mark in (r for r in rows if r[0] == k):
            last = last if v is None else v
            held = last if mark else held
            assert got[key, seq] == (last, held)
