"""Chat formatting into a prefix tree.

Conversations that share their first turns share nodes: a node is one
formatted turn after one particular history.  The nodes are emitted once,
depth first, as one long sequence of tokens; every node has its place there,
the position id of its first token (the length of its history), and the
intervals of the sequence that its tokens attend to besides their own: its
ancestors.  Tokens are code points here.

A node is known by a hash of its history, of one length at any depth.  The
walk goes down the heaviest child first, so a history is a few unbranched
paths, each one interval of the sequence.  The walk is cut into buckets of
paths; a bucket is scanned as a stream with its first path's history given to
it as copies, which is all that any of its nodes needs from other buckets.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repsight.llm.common import bucket_of, partitions, rows_of, split_points

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Text without the control strings' first two characters; ``unescape`` gives it back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def format_turn(role: str, text: str) -> str:
    return START + escape(role).replace("\n", "\\n") + "\n" + escape(text) + END + "\n"


def parse_turn(segment: str) -> tuple[str, str]:
    role, text = _TURN.fullmatch(segment).groups()
    return unescape(role), unescape(text)


# a history's hash is a polynomial of its turns' hashes, so hashes of its pieces can be put together
PRIME, BASE = 2**127 - 1, int.from_bytes(hashlib.sha256(START.encode()).digest()[:15], "little")
DEPTHS = 10  # digits of a depth in a path
EDGE = DEPTHS + 32  # characters that a light edge adds to a path
CHUNK = 12  # turns of a conversation to a join key, as a power of two
SALTS = 16

_ROWS = "conv_id long, part int, frag int, place long, before string, hash string, chars long, n long, segment string, last boolean"


def _table(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out), fields)], names=[n for n, _ in fields])


def turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, node, parent, depth (from 1), position, n (characters), segment, last (whether the conversation ends here).

    ``conversations`` needs conv_id, turn, role, text; other columns are
    ignored.  Null roles and texts count as empty.  Turns follow each other by
    turn (null first), then role, then text; repeated rows are turns of their
    own.  Rows without conv_id make up one conversation.  An empty table gives
    an empty one.

    Conversations lie in ranges of their order, and one may span many ranges:
    a range hashes the pieces in it, and what its first piece follows is added
    from one row a range.
    """
    spark = conversations.sparkSession
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, frag, held, out, size = TaskContext.get().partitionId(), -1, None, [], 0
        for row in rows_of(batches):
            goes_on = held is not None and held[0] == row["conv_id"]
            if held is not None:
                out.append((*held, not goes_on))
            if not goes_on:
                frag, place, before, chars = frag + 1, 0, 0, 0
            segment = format_turn(row["role"], row["text"])
            own = int.from_bytes(hashlib.sha256(segment.encode()).digest()[:16], "little")
            after = (before * BASE + own) % PRIME
            place += 1
            held = (row["conv_id"], part, frag, place, f"{before:032x}", f"{after:032x}", chars, len(segment), segment)
            before, chars = after, chars + len(segment)
            size += len(segment)
            if size > 1 << 22 and out:
                yield _table(out, _ROWS)
                out, size = [], 0
        if held is not None:
            yield _table([*out, (*held, None)], _ROWS)  # the next range knows whether it is the last

    # the ranges' bounds are sampled on the driver, so texts are cut there; a cut text sorts as the text does
    cut = [F.left("role", F.lit(64)), F.left("text", F.lit(64))]
    ordered = rows.repartitionByRange(partitions(spark), "conv_id", "turn", *cut).sortWithinPartitions("conv_id", "turn", "role", "text")
    local = ordered.select("conv_id", "role", "text").mapInArrow(run, _ROWS).checkpoint(eager=True)

    end = F.struct("conv_id", "place", "hash", (F.col("chars") + F.col("n")).alias("chars"))
    found = local.groupBy("part").agg(  # one row a range
        F.max_by(end, F.when(F.col("frag") == 0, F.col("place"))).alias("first"),
        F.max_by(end, F.struct("frag", "place")).alias("last"), F.max("frag").alias("frags"),
    ).orderBy("part").collect()
    carried, closing, tail = {}, set(), None
    for r in found:
        first = r["first"]
        if tail is not None and tail[0] == first["conv_id"]:
            carried[r["part"]] = tail[1:]
        elif tail is not None:
            closing.add(part)
        part, (conv, place, hash_, chars) = r["part"], r["last"]
        turns_, value, before = carried.get(part, (0, 0, 0)) if r["frags"] == 0 else (0, 0, 0)
        tail = (conv, turns_ + place, (value * pow(BASE, place, PRIME) + int(hash_, 16)) % PRIME, before + chars)
    if found:
        closing.add(part)

    @F.pandas_udf("node string, parent string, depth long, position long, last boolean")
    def whole(
        part: pd.Series, frag: pd.Series, place: pd.Series, before: pd.Series, hash_: pd.Series, chars: pd.Series, last: pd.Series
    ) -> pd.DataFrame:
        out = []
        for p, f, at, b, h, c, z in zip(part, frag, place, before, hash_, chars, last):
            z = p in closing if z is None else bool(z)
            if f or p not in carried:
                out.append((h, b, at, c, z))
                continue
            turns_, value, more = carried[p]
            step = value * pow(BASE, at - 1, PRIME) % PRIME
            node, parent = (step * BASE + int(h, 16)) % PRIME, (step + int(b, 16)) % PRIME
            out.append((f"{node:032x}", f"{parent:032x}", turns_ + at, more + c, z))
        return pd.DataFrame(out, columns=["node", "parent", "depth", "position", "last"])

    told = local.withColumn("w", whole("part", "frag", "place", "before", "hash", "chars", "last"))
    return told.select("conv_id", "w.node", "w.parent", "w.depth", "w.position", "n", "segment", "w.last")


def paths(turn_rows: DataFrame) -> DataFrame:
    """One row per node: node, path, depth, position, n, ends, branches (whether it has several children).

    A node's heaviest child, by conversations, goes on with its path; each
    other child begins a path of its own, named by its parent's path, its depth
    and itself.  A conversation passes at most log2(conversations) + 1 such
    light edges, so that bounds a path's name, however long the conversation.
    Nodes sorted by path and depth are a depth-first walk: a path to its
    bottom, then what hangs from it, deepest first.
    """
    rows = turn_rows.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    nodes = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.sum(F.col("last").cast("long")).alias("ends"), F.min("conv").alias("conv"),
        F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("position").alias("position"), F.min("n").alias("n"),
    ).checkpoint(eager=True)
    kids = nodes.groupBy("parent").agg(
        F.max_by("node", F.struct("weight", "node")).alias("heavy"), F.count(F.lit(1)).alias("kids")
    )
    light = nodes.join(kids.select(F.col("heavy").alias("node")), "node", "left_anti").select(
        "node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    )
    salted = rows.select("conv", "node", "depth", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int").alias("salt"))
    edges = salted.join(light, ["node", "salt"]).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("edges"))
    held = rows.where("last").select("conv", "depth").join(edges, "conv", "left").select(
        "conv", "edges", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("depth", CHUNK))).alias("chunk")
    )
    placed = nodes.withColumn("chunk", F.shiftright("depth", CHUNK)).join(held, ["conv", "chunk"])
    above = F.filter(F.coalesce("edges", F.array().cast("array<struct<depth:long,node:string>>")), lambda e: e["depth"] <= F.col("depth"))
    named = F.transform(above, lambda e: F.concat(F.lpad((F.lit(10**DEPTHS) - e["depth"]).cast("string"), DEPTHS, "0"), e["node"]))
    several = kids.where("kids > 1").select(F.col("parent").alias("node"), F.lit(True).alias("several"))
    return placed.withColumn("path", F.array_join(named, "")).join(several, "node", "left").select(
        "node", "path", "depth", "position", "n", "ends", F.coalesce("several", F.lit(False)).alias("branches")
    )


_EMITTED = (
    "copy boolean, key string, depth long, start long, end long, position long, ancestors array<struct<start:long,end:long>>,"
    " segment string, loss_start long, loss_end long, ends long, branches boolean"
)


def emit(turn_rows: DataFrame) -> DataFrame:
    """The tree, depth first: one row per node, in buckets of the walk, each in order.

    copy, key (its history's hash), depth, start and end (its tokens' interval
    in the whole sequence), position (id of its first token), ancestors (the
    intervals that its tokens attend to besides their own history within the
    node: one for each path that its history takes), segment, loss_start and
    loss_end (interval under the loss mask: an assistant's text; null for other
    roles), ends (conversations that end here), branches (whether several turns
    follow it).  Rows with ``copy`` repeat the history of a bucket's first
    path; without them every node is there once.  A path lies in one bucket and
    is read as a stream; the copies of all buckets are no more rows than the
    conversations, as each bucket begins with another conversation.
    """
    spark = turn_rows.sparkSession
    named = paths(turn_rows).checkpoint(eager=True)
    points = split_points(named, "path", partitions(spark))
    narrow = named.withColumn("own", bucket_of(F.col("path"), points))
    heads = narrow.groupBy("own").agg(F.min("path").alias("head"), F.sum("n").alias("n")).orderBy("own").collect()
    offset, base, history = 0, {}, {}
    for b in heads:
        base[b["own"]] = offset
        offset += b["n"]
        for at in range(0, len(b["head"]), EDGE):
            below = 10**DEPTHS - int(b["head"][at : at + DEPTHS])  # depth at which the history leaves this path
            if below > 1:
                history.setdefault(b["head"][:at], []).append((below, b["own"]))
    # a row for each path that leads to a bucket's head: at most buckets times log2(conversations) + 1
    wanted = spark.createDataFrame(list(history.items()), "path string, copies array<struct<below:long,bucket:int>>")
    by_path = narrow.groupBy("own", "path").agg(F.sum("n").alias("n"))
    placed = by_path.withColumn("before", F.sum("n").over(Window.partitionBy("own").orderBy("path")) - F.col("n"))
    place = {r["path"]: base[r["own"]] + r["before"] for r in placed.join(F.broadcast(wanted.select("path")), "path").collect()}

    texts = turn_rows.groupBy("node").agg(F.first("segment").alias("segment"))
    given = F.transform(F.filter("copies", lambda c: F.col("depth") < c["below"]), lambda c: c["bucket"])
    dealt = narrow.join(F.broadcast(wanted), "path", "left").join(texts, "node").withColumn(
        "bucket", F.explode(F.concat(F.array("own"), F.coalesce(given, F.array().cast("array<int>"))))
    ).withColumn("copy", F.col("bucket") != F.col("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _EMITTED.split(", ")]
        span, whole = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.int64()
        kinds = [pa.bool_(), pa.string(), whole, whole, whole, whole, span, pa.string(), whole, whole, whole, pa.bool_()]
        out, size, bucket, at, stack = [], 0, None, 0, []  # stack: path, start and position of its first node
        for row in rows_of(batches):
            if row["bucket"] != bucket:
                bucket, stack = row["bucket"], []
                at = base[bucket]
            path, position, segment = row["path"], row["position"], row["segment"]
            if not stack or stack[-1][0] != path:
                while stack and not path.startswith(stack[-1][0]):
                    stack.pop()
                stack.append((path, place[path] if row["copy"] else at, position))
            start = stack[-1][1] + position - stack[-1][2]
            end = start + len(segment)
            at = at if row["copy"] else end
            spans = [(a[1], a[1] + b[2] - a[2]) for a, b in zip(stack, stack[1:])] + [(stack[-1][1], start)]
            role, text = parse_turn(segment)
            loss = (None, None)
            if role == "assistant":
                loss = (end - len(END) - 1 - len(escape(text)), end - len(END) - 1)
            out.append((
                row["copy"], row["node"], row["depth"], start, end, position,
                [{"start": s, "end": e} for s, e in spans if s < e], segment, *loss, row["ends"], row["branches"],
            ))
            size += len(segment) + 64
            if size > 1 << 22:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                out, size = [], 0
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    ordered = dealt.repartitionById(partitions(spark), "bucket").sortWithinPartitions("bucket", "path", "depth")
    columns = ["bucket", "path", "copy", "node", "depth", "position", "segment", "ends", "branches"]
    return ordered.select(*columns).mapInArrow(run, _EMITTED)


_READ = "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(emitted: DataFrame) -> DataFrame:
    """What a reader of the emitted sequence sees of each node at which a conversation ends.

    key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: from
    the texts in its attention intervals and its own, parsed and unescaped.
    What has been read is kept for the nodes where the walk will come back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, out = [], []  # of the nodes on the way: end, whether it branches, what has been read up to there
        empty = (0, hashlib.sha256(), 0, hashlib.sha256(), 0)
        for row in rows_of(batches):
            came = row["ancestors"][-1]["end"] if row["ancestors"] else None
            while kept and kept[-1][0] != came:
                kept.pop()
            n, all_, chars, loss, length = kept[-1][2] if came is not None else empty
            role, text = parse_turn(row["segment"])
            all_, loss = all_.copy(), loss.copy()
            all_.update(f"{role}\n{text}\n".encode())
            if row["loss_start"] is not None:
                masked = unescape(row["segment"][row["loss_start"] - row["start"] : row["loss_end"] - row["start"]])
                chars += len(masked)
                loss.update(masked.encode())
            now = (n + 1, all_, chars, loss, length + row["end"] - row["start"])
            if kept and not kept[-1][1]:
                kept.pop()  # it has no other child
            kept.append((row["end"], row["branches"], now))
            if row["ends"] and not row["copy"]:
                out.append((row["key"], now[0], all_.hexdigest(), chars, loss.hexdigest(), now[4]))
            if len(out) >= 4096:
                yield _table(out, _READ)
                out = []
        if out:
            yield _table(out, _READ)

    columns = ["copy", "key", "start", "end", "ancestors", "segment", "loss_start", "loss_end", "ends", "branches"]
    return emitted.select(*columns).mapInArrow(run, _READ)


def format_chats(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree, ends): the emitted tree, and (conv_id, key) that gives each conversation its last node.

    An empty table gives two empty results.
    """
    rows = turns(conversations)
    return emit(rows), rows.where("last").select("conv_id", F.col("node").alias("key"))
