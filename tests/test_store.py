"""Saves of several tables as one, and dense numbers."""

import pytest
from pyspark.sql import functions as F

from repsight.operators.store import SetStore, number_rows

TABLES = {"a": ("id long, x string", ("id",)), "b": ("id long, y double", ())}


@pytest.fixture
def store(spark, tmp_path):
    from pyspark.sql.types import StructType

    return SetStore(spark, str(tmp_path / "store"), {k: (StructType.fromDDL(s), keys) for k, (s, keys) in TABLES.items()})


def rows(spark, lo, hi):
    ids = spark.range(lo, hi)
    return {"a": ids.withColumn("x", F.lit("t")), "b": ids.withColumn("y", F.rand(1))}


def both(store):
    return [sorted(r.id for r in store.read(t).collect()) for t in TABLES]


def test_a_save_is_in_all_tables_or_in_none(spark, store, monkeypatch):
    assert both(store) == [[], []] and store.last_id() == 0
    assert store.save("0", rows(spark, 0, 5), 4)
    assert both(store) == [list(range(5))] * 2 and store.last_id() == 4

    # killed between the tables, and between the last table and the commit
    write = SetStore._write

    def fails_on_b(self, batch, name, df):
        if name == "b":
            raise RuntimeError("killed")
        return write(self, batch, name, df)

    monkeypatch.setattr(SetStore, "_write", fails_on_b)
    with pytest.raises(RuntimeError):
        store.save("1", rows(spark, 5, 9), 8)
    monkeypatch.setattr(SetStore, "_write", write)
    commit = SetStore._commit
    monkeypatch.setattr(SetStore, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.save("1", rows(spark, 5, 9), 8)
    monkeypatch.setattr(SetStore, "_commit", commit)
    assert both(store) == [list(range(5))] * 2 and not store.committed("1")

    # run again: once in both tables, and a second run changes nothing
    assert store.save("1", rows(spark, 5, 9), 8) and not store.save("1", rows(spark, 5, 9), 8)
    assert both(store) == [list(range(9))] * 2 and store.last_id() == 8
    # two attempts at a time: the first commit counts
    assert not store._commit("1", {"a": [], "b": []}, 99) and store.last_id() == 8


def test_saving_sets_again_changes_nothing(spark, tmp_path):
    from repsight.operators.tables import read_sets, save_sets
    from repsight.plans.sets import raw_table, set_tables

    base, out = "/root/testdata/sf0.001", str(tmp_path / "sets")
    w, an = set_tables(spark, base)
    raw = raw_table(spark, base)
    assert save_sets(w, an, raw, out) and not save_sets(w, an, raw, out)
    assert [t.count() for t in read_sets(spark, out)] == [w.count(), an.count(), raw.count()]


def test_numbers_are_dense_and_in_order(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("id")).repartition(5)
    got = number_rows(df, ["k"], "n", after=41).select("k", "n").collect()
    assert sorted((r.n, r.k) for r in got) == [(i + 42, i) for i in range(1000)]
    assert number_rows(df.limit(0), ["k"], "n").count() == 0


def test_rerun_micro_batch_saves_each_set_once(spark, tmp_path, monkeypatch):
    """A stream whose save is killed once and started again: each set is in every table once, numbered without gaps."""
    from repsight.operators.tables import read_sets
    from repsight.plans import streams
    from repsight.streaming.pose_sessions import pose_session_stream
    from repsight.streaming.sink import save_sets_stream

    path = streams.stage_native(spark, "/root/testdata/sf0.001", files=4)
    schema = spark.read.parquet(path).schema
    frames = lambda: pose_session_stream(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path)
    )
    out, commit, calls = str(tmp_path / "out"), SetStore._commit, []

    def once(self, *given):
        calls.append(given)
        if len(calls) == 1:
            raise RuntimeError("killed")
        return commit(self, *given)

    monkeypatch.setattr(SetStore, "_commit", once)
    with pytest.raises(Exception, match="killed"):
        save_sets_stream(spark, frames(), path, out)
    assert read_sets(spark, f"{out}/sets")[0].count() == 0
    save_sets_stream(spark, frames(), path, out)
    workout, analysis, raw = read_sets(spark, f"{out}/sets")
    ids = sorted(r.id for r in workout.collect())
    assert ids and ids == list(range(1, len(ids) + 1))
    keys = lambda t: sorted((r.workout_id, r.frame) for r in t.select("workout_id", "frame").collect())
    assert keys(analysis) == keys(raw) and len(set(keys(raw))) == len(keys(raw)) and {k for k, _ in keys(raw)} == set(ids)
