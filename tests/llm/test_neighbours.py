"""Neighbour search: scores, ties and recall against brute force."""

import numpy as np
from pyspark.sql import functions as F

from repsight.llm import neighbours
from repsight.llm.queries import QUERIES

MID = "/root/testdata/sf0.1"


def exact(ids, x, q, k):
    score = x @ x[q]
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), float(score[j])) for j in order]


def test_query_recall(spark):
    rows = spark.read.parquet(f"{MID}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    by = {}
    for r in QUERIES["op2_collision_counting_search"](spark, MID).collect():
        by.setdefault(r.query_id, []).append(r)
    queries = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert set(by) == {ids[q] for q in queries}
    at, recall = {d: i for i, d in enumerate(ids)}, []
    for q in queries:
        got = sorted(by[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
        assert all(abs(r.score - x[at[r.vec_id]] @ x[q]) < 1e-9 and r.vec_id != ids[q] for r in got)
        recall.append(len({r.vec_id for r in got} & {j for j, _ in exact(ids, x, q, 20)}) / 20)
    assert np.mean(recall) >= 0.9


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    vec = lambda: [float(v) for v in rng.normal(size=4)]
    rows = [(i, vec()) for i in range(1, 41)]
    rows += [(60, [1.0, 2.0, 3.0, 4.0])] * 3 + [(61, [1.0, 2.0, 3.0, 4.0]), (80, [1.0, 2.0, 3.0, 4.0])]  # ties and repeated rows
    bad = [(100, None), (120, []), (140, [0.0] * 4), (160, [1.0, None, 1.0, 1.0]), (180, [float("nan")] * 4),
           (200, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    other = [(220, [1.0, 1.0]), (221, [2.0, 0.5])]  # vectors of another length only meet each other
    df = spark.createDataFrame(rows + bad + other, "vec_id long, embedding array<double>")
    df = df.withColumn("d", F.lit("x")).withColumn("row", F.lit(None)).withColumn("q", F.lit(1))
    got = {}
    for r in neighbours.nearest(df, k=5, every=20).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q in (20, 40, 80):
        i = int(np.flatnonzero(ids == q)[0])
        assert got[q] == [(j, round(s, 9)) for j, s in exact(ids, x, i, 5)]
    assert len(got[60]) == 15 and got[220] == [(221, 2.5)]
    assert set(got) == {20, 40, 60, 80, 220}
    assert neighbours.nearest(df.limit(0)).count() == 0
    few = neighbours.nearest(df.where("vec_id in (20, 1, 2)"), k=20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_index_verifies_all_when_windows_span_all():
    x = np.eye(6) * np.arange(1, 7)[:, None]
    index = neighbours.Index(x, 36.0, 16)
    found = list(index.search(x[:2], 99, 16, 1.5, lambda j: np.arange(6) != j))
    assert sorted((j, len(hit)) for j, hit, _ in found) == [(0, 5), (1, 5)]
