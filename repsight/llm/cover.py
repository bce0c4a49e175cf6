"""Exact near-duplicate embeddings by traversing cover trees in pairs.

On unit vectors a cosine of at least c is a distance of at most
t = sqrt(2 - 2c).  A node of a cover tree has a centre and a covering radius,
the greatest distance of its vectors from the centre; its children are a net
of its vectors, the centre first, each next one the vector farthest from those
before, until half the node's radius covers all or ``FAN`` children are made.
A pair of nodes whose centres lie farther apart than t and both radii holds no
pair within t; where centres and radii together lie within t, every pair is
one.  Radii are measured, not assumed, so no pair is lost where a net of
``FAN`` is too small for the data.

The upper levels are grown over the whole table: a node of more than ``LEAF``
vectors is split by the net of a bounded sample of it, all of its vectors go to
the nearest child, and to each later child whose radius they reach as visitors,
a node of radius 0 in the traversal.  A node with no two vectors farther apart
than t is left whole, however large.  Below, tasks join blocks of at most
``LEAF`` residents with blocks of visitors, and with the other blocks of a node
that no net splits, building both trees and pairing them.  What leaves a task are the number of links of each vector and one edge
to its group in the task, never the pairs.

Equal vectors are one class with a count from the start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.llm.common import hash_below
from repsight.llm.graph import components
from repsight.llm.vectors import lists

LEAF = 16_384  # residents of a node, or of a block of one, that a task joins at once
FAN = 64  # children of a node
SAMPLE = 2_048  # vectors of a node that its children are chosen from
_LEAF, _FAN = 512, 16  # the same within a task
SLACK = 1e-6  # margin of the bounds, above the rounding of distances from float64 products
_NODE = "cls long, n long, v binary, node string, radius double, far double, own boolean"


def units(blobs: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, the given vectors) as float64."""
    x = np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1).astype(np.float64)
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True)), scaled


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(x: np.ndarray, first: int, most: int, enough: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(numbers of the net's vectors, nearest of them, distance to it): farthest first, until all lie within ``enough``."""
    chosen = [first]
    near = distances(x, x[first : first + 1])[:, 0]
    nearest = np.zeros(len(x), dtype=np.int64)
    while len(chosen) < most:
        c = int(near.argmax())
        if near[c] <= max(enough, SLACK):
            break
        d = distances(x, x[c : c + 1])[:, 0]
        closer = d < near
        nearest[closer], near[closer] = len(chosen), d[closer]
        chosen.append(c)
    return chosen, nearest, near


class Tree:
    """A cover tree of a block: nodes as arrays, the vectors in an order in which every node is a run."""

    def __init__(self, unit: np.ndarray):
        self.order = np.arange(len(unit))
        self.centre, self.radius, self.low, self.high, self.kids = [0], [], [0], [len(unit)], []
        far = distances(unit, unit[:1])[:, 0]
        self.radius.append(float(far.max()))
        node = 0
        while node < len(self.centre):
            low, high, kids = self.low[node], self.high[node], []
            members = self.order[low:high]
            if high - low > _LEAF and self.radius[node] > SLACK:
                at = int(np.flatnonzero(members == self.centre[node])[0])
                chosen, nearest, near = net(unit[members], at, _FAN, self.radius[node] / 2)
                if len(chosen) > 1:
                    by = np.argsort(nearest, kind="stable")
                    ends = np.cumsum(np.bincount(nearest, minlength=len(chosen)))
                    for k, c in enumerate(chosen):
                        kids.append(len(self.centre))
                        run = by[ends[k - 1] if k else 0 : ends[k]]
                        self.centre.append(int(members[c]))
                        self.radius.append(float(near[run].max()))
                        self.low.append(low + (int(ends[k - 1]) if k else 0))
                        self.high.append(low + int(ends[k]))
                    self.order[low:high] = members[by]
            self.kids.append(kids)
            node += 1
        self.at = unit[self.centre]
        self.radius = np.array(self.radius)


class Block:
    """Vectors of one side of a task's join, and what is found of them."""

    def __init__(self, rows: pd.DataFrame, kind: str):
        self.cls, self.n = rows["cls"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
        self.unit, self.given = units(list(rows["v"]), kind)
        self.norm = np.sqrt((self.given * self.given).sum(axis=1))
        self.tree = Tree(self.unit)
        order = self.tree.order  # from here on in the tree's order
        self.cls, self.n, self.unit, self.given, self.norm = (
            z[order] for z in (self.cls, self.n, self.unit, self.given, self.norm)
        )
        self.short = self.unit.astype(np.float32)
        self.links = np.zeros(len(order), dtype=np.int64)


def linked(a: Block, i: slice, b: Block, j: slice, threshold: float) -> np.ndarray:
    """Which pairs have a cosine of at least ``threshold`` in double precision.

    Products of float32 decide all pairs that are farther from the threshold than their rounding.
    """
    rough = a.short[i] @ b.short[j].T
    found = rough >= threshold
    close = np.abs(rough - threshold) < max(1e-5, (a.short.shape[1] + 8) * 2.0**-23)
    if close.any():
        x, y = np.nonzero(close)
        dots = (a.given[i][x] * b.given[j][y]).sum(axis=1)
        found[x, y] = dots / (a.norm[i][x] * b.norm[j][y]) >= threshold
    return found


class Groups:
    """Labels of the vectors of both blocks; linked ones come to share the least."""

    def __init__(self, count: int):
        self.label = np.arange(count)

    def join(self, i: int, j: int) -> None:
        low, high = sorted((int(self.label[i]), int(self.label[j])))
        if low != high:
            self.label[self.label == high] = low

    def join_all(self, at: np.ndarray) -> None:
        labels = np.unique(self.label[at])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]

    def join_links(self, rows: np.ndarray, columns: np.ndarray, found: np.ndarray) -> None:
        while True:
            open_ = found & (self.label[rows][:, None] != self.label[columns][None, :])
            some = np.flatnonzero(open_.any(axis=1))
            if not len(some):
                return
            for x, y in zip(some, open_[some].argmax(axis=1)):
                self.join(rows[x], columns[y])


def pairs(a: Block, b: Block, groups: Groups, shift: int, threshold: float) -> None:
    """Traverse both trees from their roots and count the links of a's vectors with b's (``a is b``: among them)."""
    reach, same = math.sqrt(2 - 2 * threshold), a is b
    left, right = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    while len(left):
        d = np.sqrt(np.maximum(2 - 2 * (a.tree.at[left] * b.tree.at[right]).sum(axis=1), 0))
        radii = a.tree.radius[left] + b.tree.radius[right]
        near = d <= reach + radii + SLACK
        whole = d + radii < reach - SLACK
        next_left, next_right = [], []
        for x, y, all_ in zip(left[near].tolist(), right[near].tolist(), whole[near].tolist()):
            i, j = slice(a.tree.low[x], a.tree.high[x]), slice(b.tree.low[y], b.tree.high[y])
            mine, its = a.tree.kids[x], b.tree.kids[y]
            own = same and x == y
            if all_ or not (mine or its):
                rows, columns = np.arange(i.start, i.stop), np.arange(j.start, j.stop) + shift
                if all_:
                    a.links[i] += b.n[j].sum() - (a.n[i] if own else 0)
                    if not own:
                        b.links[j] += a.n[i].sum()
                    groups.join_all(np.concatenate([rows, columns]))
                else:
                    found = linked(a, i, b, j, threshold)
                    if own:
                        np.fill_diagonal(found, False)
                    if found.any():
                        a.links[i] += found @ b.n[j]
                        if not own:
                            b.links[j] += a.n[i] @ found
                        groups.join_links(rows, columns, found)
            elif own:
                for k, c in enumerate(mine):
                    next_left += [c] * (len(mine) - k)
                    next_right += mine[k:]
            elif mine and (not its or a.tree.radius[x] >= b.tree.radius[y]):
                next_left += mine
                next_right += [y] * len(mine)
            else:
                next_left += [x] * len(its)
                next_right += its
        left, right = np.array(next_left, dtype=np.int64), np.array(next_right, dtype=np.int64)


def join_block(rows: pd.DataFrame, kind: str, threshold: float, among: bool) -> pd.DataFrame:
    """(cls, links, other): links of each vector of a block's residents (``own``) and visitors, and its group's first."""
    own = rows["own"].to_numpy(bool)
    sides = [Block(part, kind) if len(part) else None for part in (rows[own], rows[~own])]
    home, away = sides
    here = [s for s in sides if s]
    groups = Groups(sum(len(s.cls) for s in here))
    if home and among:
        pairs(home, home, groups, 0, threshold)
    if home and away:
        pairs(home, away, groups, len(home.cls), threshold)
    cls, links = np.concatenate([s.cls for s in here]), np.concatenate([s.links for s in here])
    some = links > 0
    return pd.DataFrame({"cls": cls[some], "links": links[some], "other": cls[groups.label][some]})


def _split(kind: str) -> Callable:
    """Children of a node from a sample of its residents: their centres, one after another."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("far", kind="stable")  # nested: the vector nearest to the node's centre comes first
        unit, _ = units(list(rows["v"]), kind)
        most = int(min(FAN, math.ceil(2 * rows["residents"].iloc[0] / LEAF)))
        chosen, _, near = net(unit, 0, most, float(rows["radius"].iloc[0]) / 2)
        if len(chosen) == 1:  # few vectors lie far out and none of them is in the sample: split by what it holds
            chosen, _, _ = net(unit, 0, max(most, 2), float(near.max()) / 2)
        return pd.DataFrame({"node": [key[0]], "centres": [unit[chosen].tobytes()]})

    return run


def _far(blobs: list[bytes], centres: list[bytes], nodes: list[str], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their distances to the children) for the rows of each node in a batch."""
    by: dict[str, list[int]] = {}
    for i, node in enumerate(nodes):
        by.setdefault(node, []).append(i)
    for rows in by.values():
        unit, _ = units([blobs[i] for i in rows], kind)
        yield np.array(rows), distances(unit, np.frombuffer(centres[rows[0]]).reshape(-1, unit.shape[1]))


def _homes(kind: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            child, far = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows)
            given = [batch.column(c).to_pylist() for c in ("v", "centres", "node")]
            for rows, d in _far(*given, kind):
                child[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
            kept = [batch.column(c) for c in ("cls", "n", "v", "node")]
            yield pa.record_batch([*kept, pa.array(child), pa.array(far)], names=["cls", "n", "v", "node", "child", "far"])

    return run


def _visits(kind: str, reach: float) -> Callable:
    """Rows at the node's children: home, and the later ones within reach; a visitor (child is null) at all within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, v, node, home, centres, radii = (
                batch.column(c).to_pylist() for c in ("cls", "n", "v", "node", "child", "centres", "radii")
            )
            out = []
            for rows, d in _far(v, centres, node, kind):
                covers = np.full(d.shape[1], -np.inf)  # a child that is no vector's home is visited by none
                for r in radii[rows[0]]:
                    covers[r["child"]] = r["radius"]
                first = np.array([-1 if home[i] is None else home[i] for i in rows])
                at = np.arange(d.shape[1])[None, :]
                for k, c in zip(*np.nonzero((at == first[:, None]) | (at > first[:, None]) & (d <= reach + covers + SLACK))):
                    i = rows[k]
                    out.append((cls[i], n[i], v[i], f"{node[i]}.{c}", float(covers[c]), float(d[k, c]), bool(c == first[k])))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            names = ["cls", "n", "v", "node", "radius", "far", "own"]
            for low in range(0, len(out), 1 << 14):
                part = out[low : low + (1 << 14)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)

    return run


def grow(classes: DataFrame, kind: str, reach: float) -> DataFrame:
    """Residents and visitors (``_NODE``) of the leaves of the tree over all classes: (cls, n, v, size)."""
    root = F.concat(F.lit("d"), F.col("size").cast("string"))  # vectors of unequal length never meet
    live = classes.select("cls", "n", "v", root.alias("node"), F.lit(2.0).alias("radius"), F.lit(2.0).alias("far"), F.lit(True).alias("own"))
    leaves, before = None, None
    while True:
        sizes = live.where("own").groupBy("node").agg(F.count(F.lit(1)).alias("residents"), F.max("radius").alias("radius"))
        # a node too large for a task, unless all of it is linked or the last split took nothing from it
        open_ = sizes.where((F.col("residents") > LEAF) & (2 * F.col("radius") > reach - SLACK))
        if before is not None:
            parent = F.regexp_replace("node", r"\.\d+$", "")
            open_ = open_.withColumn("parent", parent).join(before, "parent", "left").where(
                F.col("was").isNull() | (F.col("was") > F.col("residents"))
            )
        open_ = open_.select("node", "residents").checkpoint()
        if open_.isEmpty():
            return live if leaves is None else leaves.unionByName(live)
        closed = live.join(open_.select("node"), "node", "left_anti")
        sample = live.where("own").join(open_, "node").where(hash_below(F.col("cls"), F.col("residents"), SAMPLE))
        nets = sample.select("node", "residents", "radius", "far", "v").groupBy("node").applyInPandas(_split(kind), "node string, centres binary")
        nets = nets.checkpoint()
        inner = live.join(nets, "node")
        homes = inner.where("own").select("cls", "n", "v", "node", "centres").mapInArrow(
            _homes(kind), "cls long, n long, v binary, node string, child int, far double"
        ).checkpoint()
        radii = homes.groupBy("node", "child").agg(F.max("far").alias("radius")).groupBy("node").agg(
            F.collect_list(F.struct("child", "radius")).alias("radii")  # at most FAN
        )
        at = homes.select("cls", "n", "v", "node", "child").unionByName(
            live.where(~F.col("own")).select("cls", "n", "v", "node", F.lit(None).cast("int").alias("child"))
        )
        below = at.join(nets.join(radii, "node"), "node").mapInArrow(_visits(kind, reach), _NODE)
        leaves = closed if leaves is None else leaves.unionByName(closed)
        before = open_.select(F.col("node").alias("parent"), F.col("residents").alias("was"))
        live = below.checkpoint()


def link_classes(classes: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((cls, links): vectors linked with each class, itself left out; (a, b): edges that span the groups)."""
    reach = math.sqrt(2 - 2 * threshold)
    rows = grow(classes, kind, reach)
    # a visitor that reaches the whole node, and a node that is linked throughout, need no comparison
    rows = rows.withColumn("all", ~F.col("own") & (F.col("far") + F.col("radius") < reach - SLACK))
    visitor = ~F.col("own") & ~F.col("all")
    nodes = rows.groupBy("node").agg(
        F.count_if("own").alias("residents"), F.count_if(visitor).alias("visitors"),
        F.sum(F.when(F.col("own"), F.col("n"))).alias("total"), F.min(F.when(F.col("own"), F.col("cls"))).alias("least"),
        F.sum(F.when(F.col("all"), F.col("n"))).alias("extra"), F.min(F.when(F.col("all"), F.col("cls"))).alias("hub"),
        (2 * F.max("radius") < reach - SLACK).alias("clique"),
    )
    parts = lambda n: F.greatest(F.ceil(F.col(n) / LEAF), F.lit(1)).cast("int")
    rows = rows.join(nodes.withColumns({"rb": parts("residents"), "vb": parts("visitors")}), "node").checkpoint()

    extra = F.coalesce("extra", F.lit(0)) + F.when(F.col("clique"), F.col("total") - F.col("n")).otherwise(0)
    known = rows.where("own or all").select(
        "cls", F.when(F.col("own"), extra).otherwise(F.col("total")).alias("links"),
        F.when(F.col("own"), F.col("hub")).otherwise(F.col("least")).alias("other"),
        F.when(F.col("own") & F.col("clique"), F.col("least")).alias("also"),
    )
    block = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    needed = "not (clique and visitors = 0)"
    own = rows.where(f"own and {needed}").withColumn("b", block("rb"))
    residents = own.withColumn("r", F.col("b")).withColumn("w", each("vb"))
    # a node that could not be split has several blocks of residents: each pair of them is joined once, as w >= vb
    several = own.where("rb > 1 and not clique")
    first = several.where("b < rb - 1").withColumn("r", F.col("b")).withColumn("w", F.explode(F.expr("sequence(vb + b + 1, vb + rb - 1)")))
    second = several.where("b > 0").withColumn("w", F.col("vb") + F.col("b")).withColumn("r", F.explode(F.expr("sequence(0, b - 1)")))
    residents = residents.select(*rows.columns, "r", "w").unionByName(first.select(*rows.columns, "r", "w")).unionByName(
        second.withColumn("own", F.lit(False)).select(*rows.columns, "r", "w")
    )
    visitors = rows.where("not own and not all").withColumn("w", block("vb")).withColumn("r", each("rb"))
    names = ["node", "r", "w", "cls", "n", "v", "own", "clique"]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return join_block(group, kind, threshold, key[2] == 0 and not group["clique"].iloc[0])

    found = residents.select(names).unionByName(visitors.select(names)).groupBy("node", "r", "w").applyInPandas(
        run, "cls long, links long, other long"
    ).checkpoint()
    counts = found.select("cls", "links").unionByName(known.select("cls", "links")).groupBy("cls").agg(F.sum("links").alias("links"))
    edges = found.select("cls", "other").unionByName(known.select("cls", "other")).unionByName(known.select("cls", F.col("also").alias("other")))
    return counts, edges.where("other is not null and cls != other").select(F.col("cls").alias("a"), F.col("other").alias("b"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding).

    Linked are rows whose cosine in double precision is at least
    ``threshold``; equal vectors, under one vec_id or several, are rows like
    others.  A vector that is null, empty or zero, or holds a null or a number
    that is not finite, links with nothing, and vectors of unequal length do
    not link.  ``component_id`` is the smallest vec_id that links reach; rows
    without vec_id link and are counted, but name no component (it is null if
    nothing else is in it).  ``kept`` marks the rows whose vec_id it is.  An
    empty table gives no row; other columns are ignored, whatever their names.
    """
    kind = "f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>").alias("embedding"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [
                None if x is None or not np.isfinite(x).all() or not x.any() else (x + 0.0).astype(kind).tobytes()
                for x in lists(batch.column("embedding"))
            ]
            yield pa.record_batch([batch.column("vec_id"), pa.array(blobs, pa.binary())], names=["vec_id", "v"])

    rows = given.mapInArrow(pack, "vec_id long, v binary").withColumn("same", F.unhex(F.sha2("v", 256)))
    classes = rows.where("v is not null").groupBy("same").agg(
        F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep")
    )
    size = (F.length("v") / int(kind[1])).cast("int")
    classes = classes.select("same", "v", "n", "rep", size.alias("size"), F.monotonically_increasing_id().alias("cls")).checkpoint()
    counts, edges = link_classes(classes.select("cls", "n", "v", "size"), kind, threshold)
    roots = components(edges).withColumnRenamed("node", "cls")
    found = classes.select("same", "cls", "n", "rep").join(counts, "cls", "left").join(roots, "cls", "left")
    found = found.withColumn("root", F.coalesce("root", "cls"))
    least = found.groupBy("root").agg(F.min("rep").alias("component"))
    found = found.join(least, "root").select(
        "same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component", F.lit(True).alias("usable")
    )
    out = rows.select("vec_id", "same").join(found, "same", "left")
    component = F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
