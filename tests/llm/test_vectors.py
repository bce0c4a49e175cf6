"""Clustering, cover-tree links and codes of embeddings against SQL, brute force and planted rows."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from repsight.llm import centroids, codes, cover, vectors
from repsight.llm.queries import ORACLE, QUERIES

from .conftest import SMALL

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("name", [q for q in sorted(QUERIES) if q.split("_")[0] in ("op11", "op12", "op13")])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    got = QUERIES[name](spark, SMALL)
    columns = got.columns
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})")
    assert [TYPES[f.dataType.simpleString()] for f in got.schema.fields] == [str(t) for t in want.types]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())


def table(spark, rows, label="string"):
    given = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {label}")
    return given.withColumns({"cluster": F.lit("x"), "v": F.lit(1), "row": F.lit(None), "salt": F.lit(2), "cls": F.lit("y"), "n": F.lit(0)})


def odd(size, seed=5, rows=400):
    """Vectors in groups, ties, repeated rows, null ids and labels, and rows that take no part."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, size))
    x = [(i, (middle[i % 6] + 0.05 * rng.normal(size=size)).tolist(), "ab"[i % 2]) for i in range(rows)]
    x += [x[3]] * 5 + [(900, x[3][1], None), (None, x[4][1], "a"), (None, x[4][1], None), (3, x[9][1], "b")]
    x += [(901, (-np.array(x[5][1])).tolist(), "a"), (902, (7 * np.array(x[5][1])).tolist(), "b")]
    bad = [None, [], [NAN] * size, [1.0] * (size - 1) + [INF], [None] + [1.0] * (size - 1)]
    return x, x + [(1000 + i, v, "a") for i, v in enumerate(bad)]


def integers(rows, scale):
    return [[int(np.floor(scale * v)) for v in r[1]] for r in rows]


def far(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y))


def test_clusters_equal_plain_rounds(spark):
    good, all_ = odd(64)
    x = integers(good, 64)
    key = lambda i: (good[i][0] is None, hashlib.sha256(f"1:{good[i][0]}".encode()).hexdigest(), good[i][1])
    centres = [x[i] for i in sorted(range(len(x)), key=key)[:16]]
    nearest = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(3):
        at = [nearest(v) for v in x]
        for c in set(at):
            own = [v for v, a in zip(x, at) if a == c]
            centres[c] = [sum(column) // len(own) for column in zip(*own)]
    want = Counter((r[0], nearest(v), far(v, centres[nearest(v)])) for r, v in zip(good, x))
    given = table(spark, all_ + [(2000, [1.0] * 63, "a"), (2001, [1.0] * 65, "a")])
    found, last = centroids.clusters(given)
    rows = found.collect()
    assert Counter((r.vec_id, r.cluster, r.distance) for r in rows) == want
    assert last.tolist() == centres
    assert sum(r.scans for r in rows) < 3 * len(rows)  # the bounds spare comparisons where there are groups
    few = centroids.report(given.where("vec_id in (1, 2)")).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in few) == [(1, 0, 0), (2, 0, 0)]
    assert centroids.report(given.limit(0)).count() == 0 and centroids.report(given.where("vec_id >= 1000")).count() == 0


def test_approach_bounds_every_point_of_the_sphere():
    rng = np.random.default_rng(1)
    tighter = 0
    for _ in range(300):
        d = int(rng.integers(1, 9))
        old, new, centre = rng.normal(size=(3, d)) * rng.uniform(0.1, 4)
        radius = abs(rng.normal())
        bound, way = centroids.approach(old, new, centre, radius), np.linalg.norm(new - old)
        assert bound <= way
        tighter += bound < 0.9 * way
        x = rng.normal(size=(400, d))
        x = centre + radius * rng.uniform(size=(400, 1)) ** (1 / d) * x / np.linalg.norm(x, axis=1, keepdims=True)
        x = np.concatenate([x, centre + radius * (x - centre) / np.linalg.norm(x - centre, axis=1, keepdims=True)])
        assert (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max() <= bound + 1e-9
    assert tighter > 100
    still = np.ones(3)
    assert centroids.approach(still, still, np.zeros(3), 5.0) == 0


def brute_links(rows, threshold):
    """Links and components of (vec_id, vector) by comparing all."""
    x = [np.array(v, dtype=float) if v and None not in v and np.isfinite(v).all() and any(v) else None for _, v in rows]
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    n = len(x)
    near = [
        [j for j in range(n) if j != i and x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and cos(x[i], x[j]) >= threshold]
        for i in range(n)
    ]
    out, seen = [None] * n, set()
    for i in range(n):
        if i not in seen:
            group, stack = {i}, [i]
            while stack:
                for j in near[stack.pop()]:
                    if j not in group:
                        group.add(j)
                        stack.append(j)
            seen |= group
            least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            for j in group:
                out[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least)
    return Counter(out)


def spread(size, seed=8):
    """Dense groups, chains across the threshold and scattered vectors."""
    rng = np.random.default_rng(seed)
    rows, middle = [], rng.normal(size=(5, size))
    for i in range(500):
        s = (0.02, 0.2, 0.5, 1.0, 3.0)[i % 5]
        rows.append((i * 7 % 503, (middle[i // 5 % 5] + s * rng.normal(size=size)).tolist()))
    return rows


@pytest.mark.parametrize("leaf, threshold", [(16_384, 0.9), (90, 0.9), (150, 0.5)])
def test_links_equal_brute_force(spark, monkeypatch, leaf, threshold):
    monkeypatch.setattr(cover, "LEAF", leaf)
    monkeypatch.setattr(cover, "_LEAF", 8)
    rows = spread(12) + [(r[0], r[1]) for r in odd(9, rows=60)[1]]
    got = cover.near_duplicates(table(spark, [(*r, "") for r in rows]), threshold).collect()
    assert Counter(tuple(r) for r in got) == brute_links(rows, threshold)


@pytest.mark.parametrize("threshold", [0.9, 0.999])
def test_blocks_of_a_node_that_no_split_reduces_are_joined(spark, monkeypatch, threshold):
    monkeypatch.setattr(cover, "LEAF", 40)
    rng = np.random.default_rng(8)
    # all within half of the root's radius: the root's net is one child with all of them
    rows = [(i, (np.eye(6)[0] + 0.15 * rng.normal(size=6)).tolist()) for i in range(150)]
    got = cover.near_duplicates(table(spark, [(*r, "") for r in rows]), threshold).collect()
    assert Counter(tuple(r) for r in got) == brute_links(rows, threshold)


def test_blocks_of_an_unsplit_node_are_joined(spark, monkeypatch):
    monkeypatch.setattr(cover, "LEAF", 40)
    whole = [F.lit("d6").alias("node"), F.lit(2.0).alias("radius"), F.lit(2.0).alias("far"), F.lit(True).alias("own")]
    monkeypatch.setattr(cover, "grow", lambda classes, kind, reach: classes.select("cls", "n", "v", *whole))
    rng = np.random.default_rng(9)
    rows = [(i, (np.eye(6)[i % 3] + 0.2 * rng.normal(size=6)).tolist()) for i in range(150)]
    got = cover.near_duplicates(table(spark, [(*r, "") for r in rows]), 0.9).collect()
    assert Counter(tuple(r) for r in got) == brute_links(rows, 0.9)


def test_net_splits_what_the_sample_holds():
    rng = np.random.default_rng(8)
    rows = pd.DataFrame({"v": [(np.eye(6)[0] + 0.05 * rng.normal(size=6)).tobytes() for _ in range(50)]})
    rows = rows.assign(residents=10 * cover.LEAF, radius=2.0, far=0.0)
    assert len(cover._split("f8")(("d6",), rows)["centres"].iloc[0]) // 48 > 1


def test_links_of_no_rows_and_odd_rows(spark):
    given = table(spark, odd(9)[1])
    assert cover.near_duplicates(given.limit(0)).count() == 0
    bad = cover.near_duplicates(given.where("vec_id >= 1000")).collect()
    assert sorted(tuple(r) for r in bad) == [(i, 0, i, True) for i in range(1000, 1005)]
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, -0.0]), (3, [1e300, 1e300]), (4, [1e-300, 1e-300])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in cover.near_duplicates(zero).collect())
    assert got[:2] == [(1, 0, 1, True), (2, 0, 2, True)]


def test_trees_cover_their_vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    tree = cover.Tree(unit)
    assert sorted(tree.order.tolist()) == list(range(3000))
    for k, (c, low, high) in enumerate(zip(tree.centre, tree.low, tree.high)):
        d = np.linalg.norm(unit[tree.order[low:high]] - unit[c], axis=1)
        assert d.max() <= tree.radius[k] + cover.SLACK
        if kids := tree.kids[k]:
            assert tree.centre[kids[0]] == c  # nested
            assert [tree.low[kids[0]], tree.high[kids[-1]]] == [low, high]
            assert len(kids) == cover._FAN or max(tree.radius[j] for j in kids) <= tree.radius[k] / 2 + cover.SLACK


def plain_codes(rows, scale, positions, entries, rounds):
    x = integers(rows, scale)
    step = len(x[0]) // positions
    first = sorted(range(len(x)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    parts = [[v[p * step : (p + 1) * step] for v in x] for p in range(positions)]
    books = [[parts[p][i] for i in first] for p in range(positions)]
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            at = [nearest(v, book) for v in parts[p]]
            for e in set(at):
                own = [v for v, a in zip(parts[p], at) if a == e]
                book[e] = [sum(column) // len(own) for column in zip(*own)]
    out = []
    for i, r in enumerate(rows):
        code = [nearest(parts[p][i], books[p]) for p in range(positions)]
        out.append((r[0], code, sum(far(parts[p][i], books[p][e]) for p, e in enumerate(code)), r[2]))
    return out, books


@pytest.mark.parametrize("bits", [15, 5])
def test_codes_equal_plain_rounds(spark, monkeypatch, bits):
    monkeypatch.setattr(codes, "SALT_BITS", bits)
    monkeypatch.setattr(codes, "SALT_ROWS", 1 << bits)
    good, all_ = odd(24)
    want, books = plain_codes(good, 4096, 8, 16, 6)
    given = table(spark, all_ + [(2000, [1.0] * 7, "a")])
    got, found = codes.compress(given)
    assert [b.tolist() for b in found] == books
    assert Counter((r.vec_id, tuple(r.code), r.error, r.label) for r in got.collect()) == Counter(
        (i, tuple(c), e, label) for i, c, e, label in want
    )
    sums = {}
    for _, _, e, label in want:
        sums[label] = sums.get(label, 0) + e
    hexed = Counter((i, "".join(f"{c:02x}" for c in code), e, sums[label]) for i, code, e, label in want)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in codes.report(given).collect()) == hexed


def test_codes_of_few_and_no_rows(spark):
    given = table(spark, odd(24)[1])
    few = codes.report(given.where("vec_id in (1, 2)")).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in few) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]
    assert codes.report(given.limit(0)).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(spark.createDataFrame([(1, "a", [1.0, 2.0])], "vec_id long, label string, embedding array<double>"))


def test_stayers_are_not_exchanged(spark):
    given = table(spark, odd(24)[1])
    kept = codes.keep(given, 24, 64)
    x = vectors.unpacked(pa.array([bytes(r.v) for r in kept.limit(4).collect()], pa.binary()), 24)
    books = [x[:, p * 3 : p * 3 + 3] for p in range(8)]
    dealt = kept.select("row", "v").mapInArrow(codes._deal(24, 8, books, np.int32), codes._OWNERS)
    owners = codes.Owners(codes._joined(dealt).repartition(8, *codes.OWNER), 8)  # as many as shuffle partitions
    plan = codes.migrate(owners.rows, [b + 1 for b in books], 3, np.int32)._jdf.queryExecution().executedPlan().toString()
    owners.drop()
    # the movers' exchange is the only one, and the stayers' side of the join reads the buckets
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_packing_of_vectors():
    for x in ([[1, -2], [3, 4]], [[300, -300]], [[1 << 20, 5], [0, 0]]):
        x = np.array(x)
        assert vectors.unpacked(vectors.packed(x), 2).tolist() == x.tolist()
    assert vectors.unpacked(pa.array([b"\x01\x02", b"\x01\x00\xff\xff"], pa.binary()), 2).tolist() == [[1, 2], [1, -1]]
    big = np.array([[vectors.LIMIT, -vectors.LIMIT], [3, 4]])
    assert vectors.squares(big, -big).tolist() == [[far(a, -b) for b in big] for a in big]
    with pytest.raises(ValueError, match="beyond"):
        vectors.whole_numbers(np.array([[1e30]]), 64)
