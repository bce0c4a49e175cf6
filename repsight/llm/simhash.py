"""SimHash near-duplicate detection with pigeonhole blocks.

A document's fingerprint has a bit set where over half of its shingle hashes
have it set.  Two fingerprints are linked when they differ in at most
``max_bits`` bits.  The 64 bits are cut into ``blocks`` parts; ``max_bits``
differing bits touch at most as many parts, so two linked fingerprints agree
on ``blocks - max_bits`` whole parts: every such choice of parts is a table,
and linked fingerprints share the key of at least one table.  Candidates of a
key are verified by their Hamming distance.

Only distinct fingerprints take part, so copies cost one row.  A key shared by
many distinct fingerprints is cut into cells of bounded size that cover every
pair of its members, and a cell gives a spanning forest of its links instead
of all pairs: no pair is lost and no group is held in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repsight.llm.common import binary
from repsight.llm.graph import components

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned fingerprint of a UTF-8 text; 0 without words."""
    words = text.lower().split()  # on bytes: A-Z only; split at 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [_hash(b" ".join(words))]
    else:
        hashes = list(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(shingle))))))
    total = np.zeros(64, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 65536):
        bits = np.unpackbits(values[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """Every row of ``docs`` with its text (null: empty) replaced by fp, the fingerprint's 64 bits as a long."""
    rest = [c for c in docs.columns if c != "text"]
    kind = docs.select(*rest).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, text = batch.columns
            fps = np.array([fingerprint(t, shingle) for t in binary(text)], dtype=np.uint64)
            yield pa.record_batch([*kept, pa.array(fps.view(np.int64))], names=[*rest, "fp"])

    return docs.select(*rest, F.col("text").cast("string")).mapInArrow(run, kind)


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of every choice of ``blocks - max_bits`` of the parts, as signed longs."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(members: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """Linked members of one cell: (members, the one that they were reached from)."""
    left = members
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier, reached = left[:0], []
        frontier = np.array([root], dtype=left.dtype)
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(frontier), 256):
                d = np.bitwise_count(frontier[at : at + 256, None] ^ left[None, :])
                near |= (d <= max_bits).any(axis=0)
            frontier, left = left[near], left[~near]
            reached.append(frontier)
        if reached and (found := np.concatenate(reached)).size:
            yield found, root


def links(fps: DataFrame, max_bits: int = 4, blocks: int = 7, cell: int = 512) -> DataFrame:
    """(a, b): links that join exactly the fingerprints (column fp, distinct) that chains of
    at most ``max_bits`` differing bits connect.

    ``cell`` bounds the members of a candidate key that are compared at once;
    a larger key is cut into that many-membered parts, and every two parts meet
    in one cell.
    """
    masks = block_masks(blocks, max_bits)
    keyed = fps.select(
        F.explode(
            F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))
        ).alias("x"),
        "fp",
    ).select("x.t", "x.k", "fp")
    shared = keyed.groupBy("t", "k").count().where("count > 1")
    parts = F.ceil(F.col("count") / cell).cast("int")
    member = (
        keyed.join(shared, ["t", "k"])
        .withColumn("parts", parts)
        .withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("t", "k", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            yield from cells(now, False)
            n = len(now[0])
            at = n
            if n:
                same = np.logical_and.reduce([c == c[-1] for c in now[:4]])
                at = n - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [c[at:] for c in now]
        if rest is not None:
            yield from cells(rest, True)

    def cells(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        """Links of the complete cells; the last one is complete only at the end."""
        n = len(cols[0])
        if not n:
            return
        new = np.ones(n, dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        fp = cols[4].view(np.uint64)
        two = starts[ends - starts == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits
        a, b = [fp[two[near]]], [fp[two[near] + 1]]
        for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
            for found, root in _forest(fp[s:e], max_bits):
                a.append(found)
                b.append(np.full(len(found), root, dtype=np.uint64))
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = member.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


def _representatives(fps: DataFrame, of: Column, max_bits: int, blocks: int, cell: int) -> DataFrame:
    """(fp, rep): for every fingerprint the least ``of`` that its links reach."""
    classes = fps.groupBy("fp").agg(F.min(of).alias("rep")).checkpoint(eager=True)
    roots = components(links(classes.select("fp"), max_bits, blocks, cell))
    at = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    return at.select("fp", "root").join(at.groupBy("root").agg(F.min("rep").alias("rep")), "root").select("fp", "rep")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 7, cell: int = 512
) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text
    counts as empty; a text without words has fingerprint 0 and is linked like
    any other.  Repeated rows come back repeated.  ``component_id`` is the
    smallest doc_id that links reach, null only where no reached row has an id.
    An empty table gives an empty result.
    """
    fps = fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), shingle).checkpoint(eager=True)
    found = _representatives(fps, F.col("doc_id"), max_bits, blocks, cell)
    return fps.join(found, "fp").select("doc_id", "fp", F.col("rep").alias("component_id"))


def deduplicate(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 7, cell: int = 512
) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Rows without an id come after all others; rows of equal id are told apart
    by the md5 of their text, and of rows equal in both one stays.  A null text
    counts as empty.  All columns are kept, whatever their names; an empty table
    stays empty.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    fps = fingerprints(docs.select(key.alias("row"), "text"), shingle).checkpoint(eager=True)
    kept = _representatives(fps, F.col("row"), max_bits, blocks, cell).select(F.col("rep").alias("row")).distinct()
    rows = docs.select(F.struct("*").alias("given"), key.alias("row")).alias("d")
    rows = rows.join(kept.alias("k"), F.col("d.row").eqNullSafe(F.col("k.row")), "left_semi")
    return rows.dropDuplicates(["row"]).select("given.*")
