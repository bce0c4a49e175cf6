"""Connected components of a link table, as rounds of grouped minima and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    return df.checkpoint(eager=True)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the component's smallest node.

    Alternates two rewrites until the links no longer change: every larger
    neighbour of a node is tied to the smallest neighbour, then every smaller
    one.  Each keeps the components and the number of links never grows, so
    the rounds are logarithmic in practice.  Minima are pre-aggregated, so a
    node with very many links costs no single task; the join back is left to
    the skew handling of adaptive execution.  Each round is checkpointed.  An
    empty table, self links and repeated links are allowed.
    """
    links = _cut(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        links = _cut(
            small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == state:
            break
        state = now
    # a star per component by now: every node but the root has one link
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
