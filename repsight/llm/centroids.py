"""Centroid clustering with bounds that geometric drift keeps tight.

Every vector keeps its centroid, the exact squared distance to it and a lower
bound on its distance to any other centroid.  When centroids have moved, the
distance to the own one is computed anew, and a vector whose lower bound still
exceeds it keeps its centroid; the others are compared with all centroids.

The lower bound of all vectors of a cluster falls by the most that a move can
bring a foreign centroid nearer to any point of the cluster's sphere (around
the centroid, through the farthest vector).  A centroid that moves by D can
come nearer by D only to points straight ahead.  In the plane through its old
and new place and the sphere's centre, the sphere is seen under an angle; a
point at the angle a from the direction of the move comes nearer at the rate
cos a, and the angle only grows on the way.  So D times the cosine of the
sphere's nearest edge bounds the approach, summed over ``STEPS`` equal parts of
the way; it is negative where the centroid leaves the sphere behind.

Each round is one pass over the vectors, written to the checkpoint folder, and
one sum per cluster and component, added up in each task before the exchange.
The driver only holds the centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.llm.vectors import first_vectors, matrix, packed, squares, unpacked, whole_numbers

STEPS = 8
SLACK = 1e-9  # relative margin of the bounds, far above the rounding of their sums
_STATE = "vec_id long, v binary, cluster int, distance long, lower double, scans int"


def approach(old: np.ndarray, new: np.ndarray, centre: np.ndarray, radius: float) -> float:
    """A bound on |x - old| - |x - new| for all x within ``radius`` of ``centre``; at most |new - old|."""
    way = float(np.linalg.norm(new - old))
    if way == 0:
        return 0.0
    ahead = (new - old) / way
    total = 0.0
    for step in range(STEPS):
        sight = centre - (old + ahead * (way * step / STEPS))
        far = float(np.linalg.norm(sight))
        if far <= radius:
            total += 1.0
            continue
        angle = math.acos(max(-1.0, min(1.0, float(sight @ ahead) / far))) - math.asin(radius / far)
        total += math.cos(max(0.0, angle))
    return min(way, way * total / STEPS + SLACK * way)


def loosening(old: np.ndarray, new: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """By how much the lower bound of each cluster's vectors falls when the centroids move from old to new."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    return np.array([
        max((approach(a[j], b[j], a[i], radii[i]) for j in range(len(a)) if j != i), default=0.0) for i in range(len(a))
    ])


def _assign(size: int, scale: int, centres: np.ndarray, loosen: np.ndarray | None) -> Callable:
    """First pass (``loosen`` is None): reads (vec_id, embedding); later ones read the state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if loosen is None:
                rows, given = matrix(batch.column("embedding"), size)
                ids, x = batch.column("vec_id").take(pa.array(rows)), whole_numbers(given, scale)
                n = len(x)
                cluster, distance = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                lower, scans, vectors = np.zeros(n), np.zeros(n, dtype=np.int32), packed(x)
                unsure = np.arange(n)
            else:
                vectors, ids = batch.column("v"), batch.column("vec_id")
                x = unpacked(vectors, size)
                cluster = batch.column("cluster").to_numpy().astype(np.int64)
                lower = batch.column("lower").to_numpy() - loosen[cluster]
                scans = batch.column("scans").to_numpy().copy()
                distance = ((x - centres[cluster]) ** 2).sum(axis=1)
                own = np.sqrt(distance.astype(np.float64))
                unsure = np.flatnonzero(~(own + SLACK * (own + np.abs(lower) + 1) < lower))
            if len(unsure):
                all_ = squares(x[unsure], centres)
                best = all_.argmin(axis=1)  # ties: the smaller number
                at = np.arange(len(unsure))
                cluster[unsure], distance[unsure] = best, all_[at, best]
                others = all_.astype(np.float64)
                others[at, best] = np.inf
                lower[unsure] = np.sqrt(others.min(axis=1))
                scans[unsure] += 1
            yield pa.record_batch(
                [ids, vectors, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(lower),
                 pa.array(scans, pa.int32())],
                names=["vec_id", "v", "cluster", "distance", "lower", "scans"],
            )

    return run


def _sums(size: int) -> Callable:
    """Per task and cluster: component sums, the number of vectors (place -1) and the largest distance (-2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, cluster = unpacked(batch.column("v"), size), batch.column("cluster").to_numpy()
            distance = batch.column("distance").to_numpy()
            for c in np.unique(cluster):
                at = cluster == c
                row = sums.setdefault(int(c), np.zeros(size + 2, dtype=np.int64))
                row[:size] += x[at].sum(axis=0)
                row[size] += int(at.sum())
                row[size + 1] = max(row[size + 1], distance[at].max())
        places = [*range(size), -1, -2]
        for c, row in sums.items():
            yield pa.record_batch(
                [pa.array([c] * len(row), pa.int32()), pa.array(places, pa.int32()), pa.array(row, pa.int64())],
                names=["cluster", "place", "s"],
            )

    return run


def clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, scans) of every kept vector, and the final centroids (k, size) as int64.

    The centroids start as the ``k`` vectors of the smallest sha256 of
    ``seed:vec_id``, in that order (ties by the vector, null ids last).

    Kept are rows of exactly ``size`` components, none null or not finite, as
    integers floor(scale * x); rows of a null vec_id and repeated rows are
    vectors like others.  ``distance`` is the exact squared distance to the
    final centroid, ``scans`` the number of passes that compared the vector
    with all centroids.  Fewer than ``k`` vectors give as many centroids; an
    empty table gives no row and no centroid.  Other columns are ignored,
    whatever their names.  A component beyond 2^26 / scale is an error, as its
    squared distances would not fit a long.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    centres = first_vectors(vectors, key, k, size, scale)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding"))
    if not len(centres):
        empty = rows.where(F.lit(False)).select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.withColumn("scans", F.lit(0)), centres
    state = rows.mapInArrow(_assign(size, scale, centres, None), _STATE).checkpoint()
    for done in range(rounds):
        found = state.select("v", "cluster", "distance").mapInArrow(_sums(size), "cluster int, place int, s long")
        totals = found.groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.max("s").alias("m"))
        by = {(r["cluster"], r["place"]): r for r in totals.collect()}  # k * (size + 2) rows at most
        moved, radii = centres.copy(), np.zeros(len(centres))
        for c in {c for c, _ in by}:
            count = int(by[c, -1]["s"])
            moved[c] = [int(by[c, i]["s"]) // count for i in range(size)]
            radii[c] = math.sqrt(by[c, -2]["m"]) * (1 + SLACK)
        loosen = loosening(centres, moved, radii)
        centres = moved
        state = state.mapInArrow(_assign(size, scale, centres, loosen), _STATE)
        state = state.checkpoint() if done < rounds - 1 else state.drop("v", "lower").checkpoint()
    return state.select("vec_id", "cluster", "distance", "scans"), centres


def digest(centre: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centre).encode()).hexdigest()


def report(vectors: DataFrame, **given) -> DataFrame:
    """``clusters`` with each cluster's and the whole inertia and the digest of the final centroid."""
    found, centres = clusters(vectors, **given)
    spark = vectors.sparkSession
    names = spark.createDataFrame([(i, digest(c)) for i, c in enumerate(centres)], "cluster int, centroid_sha256 string")
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # one row a centroid
    total = each.agg(F.sum("cluster_inertia")).first()[0]
    sums = each.join(names, "cluster").withColumn("inertia", F.lit(total).cast("long"))
    return found.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans"
    )
