"""Vector codes from Lloyd codebooks whose members stay where they are.

A vector is cut into equal parts, one per position, each with a codebook of its
own.  Owners hold the parts of one (position, entry, salt): a salt is a run of
at most ``SALT_ROWS`` input rows, so no owner grows with the table, however
many parts an entry attracts.  Owners are the rows of a table bucketed by that
key, their members' numbers and components in two packed columns.

A round sums the resident members of every owner, which gives the new entries,
and compares the members with them.  Members that keep their entry stay; only
the others go through an exchange, to their new owners.  The bucketed scan is
already grouped by owner, so the stayers are not exchanged.  Owners are
written anew each round, in the shared checkpoint folder, which also ends the
lineage: a lost executor costs one round's work at most.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.llm.common import partitions
from repsight.llm.vectors import first_vectors, matrix, packed, squares, unpacked, whole_numbers
from repsight.session import ensure_checkpoint_dir

SALT_BITS = 15
SALT_ROWS = 1 << SALT_BITS  # a member's number within its salt fits two bytes
OWNER = ["position", "entry", "salt"]
_OWNERS = "position int, entry int, salt long, ids binary, parts binary"


def _deal(size: int, positions: int, books: list[np.ndarray], kind: type) -> Callable:
    """Rows to (position, entry, salt) blocks; every owner of a salt gets a block, if only an empty one."""
    step = size // positions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, row = unpacked(batch.column("v"), size), batch.column("row").to_numpy()
            out = {"position": [], "entry": [], "salt": [], "ids": [], "parts": []}
            for salt in np.unique(row >> SALT_BITS):
                at = np.flatnonzero(row >> SALT_BITS == salt)
                ids = (row[at] & (SALT_ROWS - 1)).astype(np.uint16)
                for p, book in enumerate(books):
                    part = x[at, p * step : (p + 1) * step]
                    near = squares(part, book).argmin(axis=1)
                    for e in range(len(book)):
                        mine = near == e
                        out["position"].append(p)
                        out["entry"].append(e)
                        out["salt"].append(int(salt))
                        out["ids"].append(ids[mine].tobytes())
                        out["parts"].append(part[mine].astype(kind).tobytes())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


def _members(parts: bytes, step: int, kind: type) -> np.ndarray:
    return np.frombuffer(parts, dtype=kind).reshape(-1, step).astype(np.int64)


def _sums(step: int, kind: type) -> Callable:
    """Per task, position and entry: the sums of the resident members' components and their number (place -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("position", "entry", "parts"))
            for p, e, parts in zip(*columns):
                x = _members(parts, step, kind)
                if len(x):
                    row = sums.setdefault((p, e), np.zeros(step + 1, dtype=np.int64))
                    row[:step] += x.sum(axis=0)
                    row[step] += len(x)
        for (p, e), row in sums.items():
            n = len(row)
            yield pa.record_batch(
                [pa.array([p] * n, pa.int32()), pa.array([e] * n, pa.int32()), pa.array([*range(step), -1], pa.int32()),
                 pa.array(row, pa.int64())],
                names=["position", "entry", "place", "s"],
            )

    return run


def _movers(books: list[np.ndarray], step: int, kind: type) -> Callable:
    """Blocks of the members that change their entry, addressed to their new owners."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"position": [], "entry": [], "salt": [], "ids": [], "parts": []}
            columns = (batch.column(c).to_pylist() for c in out)
            for p, e, salt, i, b in zip(*columns):
                x = _members(b, step, kind)
                if not len(x):
                    continue
                near, number = squares(x, books[p]).argmin(axis=1), np.frombuffer(i, np.uint16)
                for to in np.unique(near[near != e]).tolist():
                    mine = near == to
                    out["position"].append(p)
                    out["entry"].append(to)
                    out["salt"].append(salt)
                    out["ids"].append(number[mine].tobytes())
                    out["parts"].append(x[mine].astype(kind).tobytes())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    return run


def _joined(blocks: DataFrame) -> DataFrame:
    """One row an owner: its blocks, of which there are at most as many as entries and batches of its salt."""
    found = blocks.groupBy(*OWNER).agg(F.collect_list(F.struct("ids", "parts")).alias("blocks"))
    glue = lambda name: F.aggregate("blocks", F.lit(b""), lambda a, b: F.concat(a, b[name]))
    return found.select(*OWNER, glue("ids").alias("ids"), glue("parts").alias("parts"))


class Owners:
    """The owners' table of one round: bucketed by owner, in the shared checkpoint folder."""

    def __init__(self, rows: DataFrame, buckets: int):
        spark = rows.sparkSession
        self.name = f"code_owners_{uuid.uuid4().hex}"
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/codes/{self.name}"
        writer = rows.write.format("parquet").option("path", path).bucketBy(buckets, *OWNER)
        writer.saveAsTable(self.name)
        self.rows = spark.table(self.name)

    def drop(self) -> None:
        """Forget the table's name; its files stay until the checkpoint folder is cleared."""
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def migrate(owners: DataFrame, books: list[np.ndarray], step: int, kind: type) -> DataFrame:
    """The owners' rows after their members went to the nearest entries: stayers in place, movers joined to them."""

    def settle(key: tuple, here: pa.Table, arrived: pa.Table) -> pa.Table:
        p, e = key[0].as_py(), key[1].as_py()
        ids, parts = [], []
        for i, b in zip(here["ids"].to_pylist(), here["parts"].to_pylist()):
            x = _members(b, step, kind)
            if len(x):
                stays = squares(x, books[p]).argmin(axis=1) == e
                ids.append(np.frombuffer(i, np.uint16)[stays].tobytes())
                parts.append(x[stays].astype(kind).tobytes())
        ids, parts = b"".join(ids + arrived["ids"].to_pylist()), b"".join(parts + arrived["parts"].to_pylist())
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        row = [p, e, key[2].as_py(), ids, parts]
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds)], names=[*OWNER, "ids", "parts"])

    moved = owners.mapInArrow(_movers(books, step, kind), _OWNERS)
    # the bucketed scan is grouped as it stands; an owner gets few blocks at most, from the other entries of its salt
    return owners.groupBy(*OWNER).cogroup(moved.groupBy(*OWNER)).applyInArrow(settle, _OWNERS)


def keep(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """(row, vec_id, label, v) of the rows of ``size`` components, none null or not finite; checkpointed."""
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = matrix(batch.column("embedding"), size)
            at = pa.array(rows)
            yield pa.record_batch(
                [batch.column("vec_id").take(at), batch.column("label").take(at), packed(whole_numbers(x, scale))],
                names=["vec_id", "label", "v"],
            )

    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(
        run, f"vec_id long, label {label}, v binary"
    )
    # numbers are consecutive within an input task, so a run of them is a salt
    return found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "v").checkpoint()


def common_size(vectors: DataFrame) -> int:
    """The number of components that most vectors have (ties: the greater), 0 for an empty table."""
    sizes = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return most["size"] if most else 0


def compress(
    vectors: DataFrame, positions: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, list[np.ndarray]]:
    """(row, vec_id, label, code: array<int>, error) of every kept vector, and the final codebooks.

    Kept are the rows of the table's commonest number of components (a
    multiple of ``positions``) without a null or a number that is not finite,
    as integers floor(scale * x).  Rows of another length cannot share the
    codebooks and are left out.  A null label or vec_id and repeated rows are
    kept like others; the first entries are the vectors of the smallest
    vec_ids, ties by the vector, null ids last.  Fewer vectors than
    ``entries`` give as many entries; an empty table gives no row and empty
    codebooks.  Columns other than vec_id, label and embedding are ignored.  A
    component beyond 2^26 / scale is an error.
    """
    spark = vectors.sparkSession
    size = common_size(vectors)
    if size % positions:
        raise ValueError(f"{size} components cannot be cut into {positions} equal parts")
    step, result = size // positions, "row long, code array<int>, error long"
    kept = keep(vectors, size, scale)
    start = first_vectors(vectors, F.col("vec_id").cast("long"), entries, size, scale) if size else []
    if not len(start):
        return kept.select("row", "vec_id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error")), []
    widest = kept.agg(F.max(F.length("v"))).first()[0] // size
    kind = {1: np.int8, 2: np.int16, 4: np.int32}[widest]
    books = [start[:, p * step : (p + 1) * step].copy() for p in range(positions)]
    dealt = kept.select("row", "v").mapInArrow(_deal(size, positions, books, kind), _OWNERS)
    buckets = partitions(spark)
    owners = Owners(_joined(dealt).repartition(buckets, *OWNER), buckets)
    for done in range(rounds):
        found = owners.rows.mapInArrow(_sums(step, kind), "position int, entry int, place int, s long")
        totals = found.groupBy("position", "entry", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
        by = {(r["position"], r["entry"], r["place"]): int(r["s"]) for r in totals.collect()}  # the codebooks' size
        for p, book in enumerate(books):
            for e in range(len(book)):
                if count := by.get((p, e, -1)):
                    book[e] = [by[p, e, i] // count for i in range(step)]
        if done < rounds - 1:
            before, owners = owners, Owners(migrate(owners.rows, books, step, kind), buckets)
            before.drop()

    final = [book.copy() for book in books]

    def gather(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        code = np.zeros((SALT_ROWS, positions), dtype=np.int32)
        error, there = np.zeros(SALT_ROWS, dtype=np.int64), np.zeros(SALT_ROWS, dtype=bool)
        for p, ids, parts in zip(blocks["position"], blocks["ids"], blocks["parts"]):
            if len(parts):
                at, far = np.frombuffer(ids, np.uint16), squares(_members(parts, step, kind), final[p])
                code[at, p] = far.argmin(axis=1)
                error[at] += far.min(axis=1)
                there[at] = True
        rows = np.flatnonzero(there)
        return pd.DataFrame({"row": (int(key[0]) << SALT_BITS) + rows, "code": list(code[rows]), "error": error[rows]})

    coded = owners.rows.select("salt", "position", "ids", "parts").groupBy("salt").applyInPandas(gather, result).checkpoint()
    owners.drop()
    return coded.join(kept.select("row", "vec_id", "label"), "row"), books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def report(vectors: DataFrame, **given) -> DataFrame:
    """``compress`` with the code in hex, the error summed over each label (nulls together) and the codebooks' digest."""
    coded, books = compress(vectors, **given)
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    rows = coded.select("vec_id", "label", hexed.alias("code"), "error")
    labels = rows.groupBy(F.col("label").alias("same_label")).agg(F.sum("error").alias("label_error"))
    both = rows.join(labels, F.col("label").eqNullSafe(F.col("same_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
