"""Approximate nearest neighbours by collision counting.

Every vector is projected on ``projections`` random lines, and each line holds
the projections of a block of vectors as one sorted array.  A query opens a
window around its own projection on every line; virtual rehashing widens the
windows by the factor ``ratio`` from round to round without a new index.  A
vector that lies in the windows of at least ``threshold`` of the lines is
verified by its exact inner product.  A query is done with a block when a
share of it is verified, and at least as many vectors as neighbours are asked
for; windows that span everything verify every vector.

Inner products are turned into distances by one more component,
sqrt(M^2 - |x|^2) with M the largest norm, which is 0 for a query: then the
nearest vector is that of the largest inner product.  Every vector is
indexed; queries and vectors meet in cells of bounded size, a block of either.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part.

    Left out: a null vec_id, a null, empty or zero vector, and one that holds
    a null or a number that is not finite.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(
        F.col("vec_id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )


def nearest(
    vectors: DataFrame,
    k: int = 20,
    every: int = 20,
    projections: int = 96,
    threshold: float = 0.65,
    ratio: float = 1.15,
    block: int = 8192,
    query_block: int = 1024,
    verified: float = 0.25,
) -> DataFrame:
    """The ``k`` nearest found of each query: query_id, rank, vec_id, score.

    Queries are the usable rows whose vec_id is divisible by ``every``;
    candidates all usable rows of another vec_id.  Vectors of unequal length
    never meet: each length is searched by itself.  ``score`` is the inner
    product of the given vectors in double precision; ties go to the smaller
    vec_id.  A vec_id of several rows has several candidates, and as a query
    the results of each of its rows.  Fewer than ``k`` other rows give all of
    them.  ``verified`` is the share of a block after which a query stops
    widening its windows there (with at least ``10 * k`` verified; a block
    of fewer vectors is verified whole).
    """
    rows = usable(vectors).withColumn("d", F.size("v")).checkpoint(eager=True)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    sizes = rows.groupBy("d").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"),
        F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m2"),
    )
    sizes = sizes.select(
        "d", "m2", F.ceil(F.col("n") / block).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.col("q") / query_block), F.lit(1)).cast("int").alias("parts"),
    )
    joined = rows.join(F.broadcast(sizes), "d")
    b = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    p = F.pmod(F.xxhash64("row", F.lit("query")), F.col("parts")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    side = joined.withColumn("b", b).withColumn("p", each("parts")).select("d", "b", "p", "vec_id", "v", "m2")
    asked = (
        joined.where(F.col("vec_id") % every == 0)
        .withColumn("p", p).withColumn("b", each("blocks")).select(
            F.col("d").alias("qd"), F.col("b").alias("qb"), F.col("p").alias("qp"), F.col("vec_id").alias("query_id"),
            F.col("v").alias("q"), "row",
        )
    )

    def search(key: tuple, base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["row", "query_id", "vec_id", "score"]
        if base.empty or queries.empty:
            return pd.DataFrame({c: pd.Series(dtype="float64" if c == "score" else "int64") for c in names})
        base = base.sort_values("vec_id", kind="stable")
        x, ids = np.stack(base["v"].to_numpy()), base["vec_id"].to_numpy()
        q, qids = np.stack(queries["q"].to_numpy()), queries["query_id"].to_numpy()
        index = Index(x, float(base["m2"].iloc[0]), projections)
        need = max(10 * k, math.ceil(verified * len(x)))
        out = {c: [] for c in names}
        lines = math.ceil(threshold * projections)
        for j, hit, score in index.search(q, need, lines, ratio, lambda j: ids != qids[j]):
            best = np.lexsort((ids[hit], -score))[:k]
            out["row"].append(np.full(len(best), queries["row"].iloc[j]))
            out["query_id"].append(np.full(len(best), qids[j]))
            out["vec_id"].append(ids[hit][best])
            out["score"].append(score[best])
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})

    found = asked.groupBy("qd", "qb", "qp").cogroup(side.groupBy("d", "b", "p")).applyInPandas(
        lambda key, queries, base: search(key, base, queries), "row long, query_id long, vec_id long, score double"
    )
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Index:
    """Sorted projections of one block of vectors."""

    def __init__(self, x: np.ndarray, m2: float, projections: int):
        self.x, self.unit = x, 1 / math.sqrt(m2)
        self.lines = np.random.default_rng(20).normal(size=(x.shape[1] + 1, projections))
        rest = np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))
        at = ((np.concatenate([x, rest[:, None]], axis=1) * self.unit) @ self.lines).T
        order = np.argsort(at, axis=1, kind="stable")
        self.at = np.take_along_axis(at, order, axis=1)
        self.rank = np.empty(order.shape, dtype=np.uint32)  # place of every vector on every line
        np.put_along_axis(self.rank, order, np.arange(len(x), dtype=np.uint32)[None, :], axis=1)
        if len(x) < 1 << 16:
            self.rank = self.rank.astype(np.uint16)

    def search(
        self, q: np.ndarray, need: int, threshold: int, ratio: float, allowed: Callable[[int], np.ndarray]
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, numbers of the verified vectors, their inner products) for all queries."""
        n, kind = len(self.x), self.rank.dtype
        own = (q / np.sqrt((q * q).sum(axis=1, keepdims=True))) @ self.lines[:-1]
        open_, half = np.arange(len(q)), 0.8
        while len(open_):
            # windows of the queries still open, as places on each sorted line
            low = np.stack([np.searchsorted(a, own[open_, i] - half, "left") for i, a in enumerate(self.at)])
            high = np.stack([np.searchsorted(a, own[open_, i] + half, "right") for i, a in enumerate(self.at)])
            whole = ((low == 0) & (high == n)).all(axis=0)
            low, width = low.astype(kind), (high - low).astype(kind)
            left = []
            for i, j in enumerate(open_):
                # a place lies in [low, low + width) when its distance from low, as an unsigned number, is below width
                inside = (self.rank - low[:, i, None]) < width[:, i, None]
                counts = inside.view(np.uint8).sum(axis=0, dtype=np.uint8 if len(self.lines[0]) < 256 else np.uint32)
                hit = np.flatnonzero((counts >= threshold) & allowed(j))
                if len(hit) >= need or whole[i]:
                    yield j, hit, self.x[hit] @ q[j]
                else:
                    left.append(j)
            open_, half = np.array(left, dtype=int), half * ratio
