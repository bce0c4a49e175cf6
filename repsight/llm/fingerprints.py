"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds, for every prefix of a text, the polynomial of its code
points modulo two primes.  The hash of any span follows from two entries, so
the equality of two spans costs constant time, and the longest common
extension of two places is found by binary search.

A document's fingerprint is that array at places whose number grows with the
text: a grid whose step is a power of two of at most ``STEP``, and cuts behind
windows of ``WINDOW`` code points whose hash is the least within 2^level places
on either side, about one in every 2^(level + 1) places.  The level grows with
short texts and stays at ``LEVEL`` from some 2,000 code points on.  The grid of
a longer text is part of that of a shorter one, and so are its cuts, so two
fingerprints have comparable places.  By themselves they answer the equality
of spans between grid places, which stand where they stood, and between cuts,
which move with the text: the likeness is the share of the longer text that
equal spans cover, by the better of the two.

Where the whole arrays are at hand, ``alike`` extends the equal spans between
cuts on either side as far as the texts agree.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.llm.common import bucket_of, partitions, rows_of, split_points

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_114_129, 1_627_721)
GRID, CUTS, WINDOW = 16, 32, 8  # places of short texts, up to where the step and the level end
STEP, LEVEL = 128, 5
_CUT = np.dtype([("place", ">u4"), ("level", "u1"), ("a", ">u4"), ("b", ">u4")])


class _Powers:
    """Powers of a base modulo a prime, and those of its inverse, extended by doubling."""

    def __init__(self, base: int, prime: int):
        self.base, self.prime = base, prime
        self.values = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = pow(self.base, len(self.values), self.prime)
            self.values = np.concatenate([self.values, self.values * np.uint64(step) % np.uint64(self.prime)])
        return self.values[:n]


POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES)]
INVERSE = [pow(b, -1, p) for b, p in zip(BASES, PRIMES)]
INVERSE_POWERS = [_Powers(b, p) for b, p in zip(INVERSE, PRIMES)]


def _longest(equal: Callable[[int], bool], most: int) -> int:
    """The greatest length up to ``most`` that is equal, as all lesser ones are: by doubling, then by halving."""
    low, reach = 0, 1
    while reach <= most and equal(reach):
        low, reach = reach, 2 * reach
    high = min(most, reach - 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if equal(mid) else (low, mid - 1)
    return low


def _level(n: int) -> int:
    """Level of the cuts of a text of n code points."""
    return next((k for k in range(LEVEL) if n <= CUTS << k + 1), LEVEL)


def _thinned(at: np.ndarray, level: int) -> np.ndarray:
    """Cuts of one level without those nearer than 2^level to the one before: only equal windows lie so near."""
    step = 1 << level
    if len(at) < 2 or int(np.diff(at).min()) >= step:
        return at
    kept, least = [], 0
    for x in at.tolist():
        if x >= least:
            kept.append(x)
            least = x + step
    return np.array(kept, dtype=np.int64)


class Prefix:
    """Prefix hashes of a sequence of code points: entry i is the sum of (c[j] + 1) * base^j over j < i."""

    def __init__(self, codes: np.ndarray, before: Prefix | None = None, keep: int = 0):
        """The codes alone, or after the first ``keep`` codes of ``before``."""
        n = keep + len(codes)
        self.rows, self._cuts = [], None
        for k, (power, prime) in enumerate(zip(POWERS, PRIMES)):
            p = np.uint64(prime)
            terms = (codes.astype(np.uint64) + np.uint64(1)) * power.upto(n)[keep:] % p
            row = np.empty(n + 1, dtype=np.uint64)
            row[: keep + 1] = before.rows[k][: keep + 1] if before else 0
            row[keep + 1 :] = (np.cumsum(terms) + row[keep]) % p  # below 2^31 times the length: no overflow
            self.rows.append(row)

    def __len__(self) -> int:
        return len(self.rows[0]) - 1

    def span(self, i: int, j: int) -> tuple[int, ...]:
        """Hash of the span from i up to j, wherever it lies."""
        return tuple(
            int(row[j] + np.uint64(p) - row[i]) % p * pow(inverse, i, p) % p
            for row, p, inverse in zip(self.rows, PRIMES, INVERSE)
        )

    def equal(self, i: int, other: Prefix, j: int, length: int) -> bool:
        """Whether the spans of that length from i here and from j there are equal."""
        if i + length > len(self) or j + length > len(other):
            return False
        for row, there, power, p in zip(self.rows, other.rows, POWERS, PRIMES):
            x, y = int(row[i + length]) - int(row[i]), int(there[j + length]) - int(there[j])
            shift = int(power.upto(abs(i - j) + 1)[-1])  # the span that begins first lacks so many powers
            if (x * shift - y if i < j else x - y * shift) % p:
                return False
        return True

    def common_extension(self, i: int, other: Prefix, j: int, most: int | None = None) -> int:
        """Length of the longest common extension of place i here and place j there, up to ``most``."""
        room = min(len(self) - i, len(other) - j)
        return _longest(lambda n: self.equal(i, other, j, n), room if most is None else min(room, most))

    def common_ending(self, i: int, other: Prefix, j: int, most: int) -> int:
        """The same for the spans that end at place i here and at place j there."""
        return _longest(lambda n: self.equal(i - n, other, j - n, n), min(i, j, most))

    def cuts(self) -> tuple[np.ndarray, np.ndarray]:
        """Places behind windows whose hash is the least around them, equal ones included, and the cuts' levels."""
        if self._cuts is None:
            self._cuts = self._find_cuts()
        return self._cuts

    def _find_cuts(self) -> tuple[np.ndarray, np.ndarray]:
        n, p = len(self), np.uint64(PRIMES[0])
        if n < WINDOW:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        row, most = self.rows[0], n + 1 - WINDOW
        hashes = (row[WINDOW:] + p - row[:-WINDOW]) % p * INVERSE_POWERS[0].upto(n + 1)[:most] % p
        mixed = ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        edge, base = np.full(1 << LEVEL, 0xFFFFFFFF, np.uint32), _level(n)
        least = np.concatenate([edge, mixed, edge])  # of the 2^k windows from a place on, the edge before it
        at = np.arange(most)
        levels = np.full(most, base)
        for k in range(LEVEL + 1):
            if k >= base:
                holds = mixed[at] == np.minimum(least[at + len(edge)], least[at + len(edge) + 1 - (1 << k)])
                if k == base:
                    at, levels = at[holds], levels[holds]
                else:
                    levels[holds] = k
            least = np.minimum(least[: -1 << k], least[1 << k :])
        return at + WINDOW, levels

    def bounds(self, level: int) -> np.ndarray:
        """The cuts of a level, between the two ends of the text."""
        at, levels = self.cuts()
        at = _thinned(at[levels >= level], level)
        return np.concatenate([[0], at[at < len(self)], [len(self)]]).astype(np.int64)

    def spans(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the spans between successive places."""
        both = [
            (row[at[1:]] + np.uint64(p) - row[at[:-1]]) % np.uint64(p) * inverse.upto(len(row))[at[:-1]] % np.uint64(p)
            for row, p, inverse in zip(self.rows, PRIMES, INVERSE_POWERS)
        ]
        return both[0] << np.uint64(32) | both[1]

    def alike(self, other: Prefix) -> float:
        """0 to 1, from the whole arrays: the share of the longer text that equal spans between cuts cover, each
        extended on either side as far as the texts agree; 1 for equal texts."""
        n, m = len(self), len(other)
        if n == m and self.equal(0, other, 0, n):
            return 1.0
        level = max(_level(n), _level(m))
        here, there = self.bounds(level), other.bounds(level)
        mine, its = self.spans(here), other.spans(there)
        waiting: dict[int, list[int]] = {}
        for y in np.flatnonzero(np.isin(its, mine))[::-1].tolist():
            waiting.setdefault(int(its[y]), []).append(y)
        # (place here, place there, length) in order of the places here; equal spans meet in their order
        blocks = [(0, 0, 0)]
        for x in np.flatnonzero(np.isin(mine, its)).tolist():
            if found := waiting[int(mine[x])]:
                blocks.append((int(here[x]), int(there[found.pop()]), int(here[x + 1] - here[x])))
        blocks.append((n, m, 0))
        by_other = sorted(range(len(blocks)), key=lambda k: blocks[k][1:])
        rank = {k: r for r, k in enumerate(by_other)}
        free = [blocks[b][1] - sum(blocks[a][1:]) for a, b in zip(by_other, by_other[1:])]  # behind the block of a rank
        total = 0
        for k, ((i, j, length), (i2, j2, length2)) in enumerate(zip(blocks, blocks[1:])):
            total += length2
            if gap := i2 - i - length:
                r, r2 = rank[k], rank[k + 1] - 1
                more = self.common_extension(i + length, other, j + length, min(gap, free[r]))
                free[r] -= more
                ending = self.common_ending(i2, other, j2, min(gap - more, free[r2]))
                free[r2] -= ending
                total += more + ending
        return total / max(n, m)

    def marks(self) -> Marks:
        """What the fingerprint holds."""
        n, step = len(self), 1
        while n // step > GRID and step < STEP:
            step *= 2
        cuts, levels = self.cuts()
        if _level(n) == LEVEL:  # those of short texts are needed for longer ones' levels
            kept = np.isin(cuts, _thinned(cuts, LEVEL))
            cuts, levels = cuts[kept], levels[kept]
        grid = _grid_places(n, step)
        at = lambda places: np.stack([row[places] for row in self.rows], axis=1)
        return Marks(n, step, grid, at(grid), cuts, levels, at(cuts))

    def fingerprint(self) -> str:
        """See ``Marks``."""
        return str(self.marks())


def _grid_places(n: int, step: int) -> np.ndarray:
    at = np.arange(step, n + 1, step)
    return at if len(at) and at[-1] == n else np.append(at, n)


class Marks:
    """A fingerprint: prefix hashes (two numbers each) of a text of n code points at its grid places and cuts.

    As text ``length:step:grid:cuts``: hashes of the prefixes on the grid and of the whole, 16 hex digits each, and of
    each cut its place, its level and the hash of its prefix, 8, 2 and 16 hex digits.
    """

    def __init__(self, n: int, step: int, grid: np.ndarray, grid_hashes: np.ndarray, cuts: np.ndarray, levels: np.ndarray, cut_hashes: np.ndarray):
        self.n, self.step, self.grid, self.grid_hashes = n, step, grid, grid_hashes
        self.cuts, self.levels, self.cut_hashes = cuts, levels, cut_hashes
        self._places = None

    def __str__(self) -> str:
        marked = np.empty(len(self.cuts), dtype=_CUT)
        marked["place"], marked["level"] = self.cuts, self.levels
        marked["a"], marked["b"] = self.cut_hashes.T
        return f"{self.n}:{self.step}:{self.grid_hashes.astype('>u4').tobytes().hex()}:{marked.tobytes().hex()}"

    @classmethod
    def read(cls, fingerprint: str) -> Marks:
        n, step, grid, cuts = fingerprint.split(":")
        marked = np.frombuffer(bytes.fromhex(cuts), _CUT)
        hashes = np.stack([marked["a"], marked["b"]], axis=1).astype(np.uint64)
        return cls(
            int(n), int(step), _grid_places(int(n), int(step)),
            np.frombuffer(bytes.fromhex(grid), ">u4").reshape(-1, 2).astype(np.uint64),
            marked["place"].astype(np.int64), marked["level"].astype(np.int64), hashes,
        )

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """All places with their prefix hashes, in order, from 0 on."""
        if self._places is None:
            at = np.concatenate([[0], self.grid, self.cuts])
            hashes = np.concatenate([np.zeros((1, 2), dtype=np.uint64), self.grid_hashes, self.cut_hashes])
            at, first = np.unique(at, return_index=True)
            self._places = at, hashes[first]
        return self._places

    def spans(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, length) of the spans between the cuts of a level and the ends, wherever they lie."""
        at = _thinned(self.cuts[self.levels >= level], level)
        bounds = np.concatenate([[0], at[at < self.n], [self.n]]).astype(np.int64)
        there, hashes = self.places()
        ends = hashes[np.searchsorted(there, bounds)]
        both = [
            (ends[1:, k] + np.uint64(p) - ends[:-1, k]) % np.uint64(p) * inverse.upto(self.n + 1)[bounds[:-1]] % np.uint64(p)
            for k, (p, inverse) in enumerate(zip(PRIMES, INVERSE_POWERS))
        ]
        return both[0] << np.uint64(32) | both[1], np.diff(bounds)

    def common_prefix(self, other: Marks) -> tuple[int, int]:
        """(the longest common prefix up to a place that both have, the spans behind it that are equal where they stand)."""
        (here, mine), (there, its) = self.places(), other.places()
        places, i, j = np.intersect1d(here, there, assume_unique=True, return_indices=True)
        a, b = mine[i], its[j]
        low = _longest(lambda k: bool((a[k] == b[k]).all()), len(places) - 1)
        primes = np.array(PRIMES, dtype=np.uint64)
        equal = ((a[1:] + primes - a[:-1]) % primes == (b[1:] + primes - b[:-1]) % primes).all(axis=1)
        return int(places[low]), int(np.diff(places)[low:][equal[low:]].sum())

    def likeness(self, other: Marks) -> float:
        """0 to 1; 1 for equal texts (two empty ones too)."""
        n, m = self.n, other.n
        if n == m and np.array_equal(self.grid_hashes[-1], other.grid_hashes[-1]):
            return 1.0
        if not n or not m:
            return 0.0
        still = sum(self.common_prefix(other))
        # equal spans between the cuts of the level that both have, each as often as both have it
        level = max(_level(n), _level(m))
        (mine, long), (its, _) = self.spans(level), other.spans(level)
        mine, first, count = np.unique(mine, return_index=True, return_counts=True)
        its, times = np.unique(its, return_counts=True)
        both, i, j = np.intersect1d(mine, its, assume_unique=True, return_indices=True)
        moved = int((long[first[i]] * np.minimum(count[i], times[j])).sum())
        return min(1.0, max(still, moved) / max(n, m))


def likeness(one: str, other: str) -> float:
    """0 to 1, from the two fingerprints alone; 1 for equal texts (two empty ones too)."""
    return Marks.read(one).likeness(Marks.read(other))


def codes_of(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, key, copy, doc_id, text) such that each row's successor follows it in its bucket.

    Rows are in descending doc_id, those without id last, ties by the md5 of
    the text; rows equal in both are the same row for a successor.  Buckets are
    ranges of that order with sampled limits, so equal rows share one.  The
    first row of each bucket (with its equals, of which the first counts) is
    given to the bucket before as well, marked as a copy, and the very first
    row to the last bucket: so one exchange of the texts serves all successors.
    The key depends on the row alone, so it is the same in every job.
    """
    up = F.lpad(F.hex(F.bitwise_not(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))))), 16, "0")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.concat(F.coalesce(up, F.lit("G")), F.lit("."), F.md5("text")))
    points = split_points(keyed, "key", partitions(docs.sparkSession))
    keyed = keyed.withColumn("bucket", bucket_of(F.col("key"), points))
    heads = sorted(r[0] for r in keyed.groupBy("bucket").agg(F.min("key")).select("min(key)").collect())
    before = {k: bisect_right(points, heads[i - 1]) for i, k in enumerate(heads)}

    @F.pandas_udf("int")
    def also(key: pd.Series) -> pd.Series:
        return key.map(before).astype("Int32")

    twice = F.when(F.col("also").isNull(), F.array(F.struct("bucket", F.lit(0).alias("copy")))).otherwise(
        F.array(F.struct("bucket", F.lit(0).alias("copy")), F.struct(F.col("also").alias("bucket"), F.lit(1).alias("copy")))
    )
    return keyed.withColumn("also", also("key")).select(F.inline(twice), "key", "doc_id", "text")


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of an edited text, and their likeness.

    The edited text replaces the last floor(n / 2) code points by the first as
    many (or all) of the next document, in descending doc_id; the first
    document follows the last.  Returns doc_id, n_chars, edited_text,
    fingerprint, edited_fingerprint, near_edited, near_next: the ``likeness``
    of the fingerprint to the edited text's and to the next row's.  ``docs`` needs
    doc_id and text; other columns are ignored.  A null text counts as empty.
    Rows without id come after all others, rows of equal id in the order of
    their texts' md5; a single row follows itself.  No row gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, held = None, [], 0
        for row in rows_of(batches):
            codes = codes_of(row["text"])
            whole = Prefix(codes)
            now = (row["bucket"], row["doc_id"], row["text"], codes, whole, whole.marks())
            if last and last[0] == row["bucket"]:
                out.append(edit(last, now))
                held += len(row["text"])
            last = None if row["copy"] else now
            if held > 1 << 22 and out:
                yield frame(out)
                out, held = [], 0
        if out:
            yield frame(out)

    def edit(row: tuple, following: tuple) -> tuple:
        _, doc, text, codes, whole, marks = row
        n = len(codes)
        keep = n - n // 2
        edited = Prefix(following[3][: n // 2], whole, keep).marks()
        return (
            doc, n, text[:keep] + following[2][: n // 2], str(marks), str(edited), marks.likeness(edited),
            marks.likeness(following[5]),
        )

    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    dealt = with_next(docs).repartitionById(partitions(docs.sparkSession), "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "copy", "key").select("bucket", "copy", "doc_id", "text")
    return ordered.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double",
    )
