"""Packing token sequences into windows by Karmarkar-Karp differencing.

A document's ids are cut into whole windows and a rest, the rest into pieces of
at most ``piece`` ids: many small pieces level out where few large ones cannot.
The pieces of up to ``block`` documents are dealt to windows by multiway differencing: of the two
partial partitions with the widest spread, the fullest windows of the one meet
the emptiest of the other, until one partition is left.  Its windows are
nearly equal, and where one exceeds the capacity the number of windows rises.
Blocks are filled within each input split; the pieces that are left at the
splits' ends, less than a block each, are exchanged and packed together, in
blocks of about as many documents.  So little is shuffled, a block bounds the
memory, and a lost task is run again with the same result.
"""

from __future__ import annotations

import heapq
import re
import struct
from bisect import insort
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.llm.common import rows_of

_NOT_SPACE_FOR_ALL = re.compile("[\x1c-\x1f]")  # white space to str.split, but not to the tokenizer
_SPACES = re.compile("[ \t\n\r]+")


# Byte-level alphabet: a printable byte stands for itself, the others follow from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_REST = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_CHARS = [chr(b) if b in _PRINTABLE else chr(256 + _REST.index(b)) for b in range(256)]
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?#$%&*|]*)")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    """Ids by string; those of a new one are found by ``learn`` when it is looked up."""

    def __init__(self, learn: Callable[[str], bytes]):
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        found = self[key] = self.learn(key)
        return found


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, with bounded caches of words and of their runs.

    The runs have a cache of their own: words are learnt anew when theirs is
    full, which costs little while the runs are known.

    The tokenizer must be like ``word_bpe_49k.json``: it drops white space,
    lower-cases, and treats words, runs of letters and runs of marks apart, so
    that a text's ids are its words' ids.  Words of composed Latin letters
    with marks behind them go to its merges directly, all others through the
    whole tokenizer.
    """

    def __init__(self, path: str, words: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.model = self.tokenizer.model
        self.cache, self.pieces = _Known(self._word), _Known(self._piece)

    def _piece(self, piece: str) -> bytes:
        """Ids of a lower-case run of letters or of marks."""
        mapped = piece if piece.isascii() else "".join(_BYTE_CHARS[b] for b in piece.encode())
        return _packed([t.id for t in self.model.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if plain:
            letters, marks = plain.groups()
            low = letters.lower()
            if low.isalpha() and (word.isascii() or is_normalized("NFC", word)):
                return self.pieces[low] + self.pieces[marks] if marks else self.pieces[low]
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        words = _SPACES.split(text) if _NOT_SPACE_FOR_ALL.search(text) else text.split()
        out = []
        for at in range(0, len(words), 100_000):
            for known in (self.cache, self.pieces):
                if len(known) > self.words:
                    known.clear()
            out.append(b"".join(map(self.cache.__getitem__, words[at : at + 100_000])))
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Partition of the items 0.. into ``windows`` lists of nearly equal sums."""
    # A partial partition is its windows in order of size: (sum, number, items as a tree); windows left out are empty.
    number = len(sizes)
    heap = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        number += 1
        if len(a) < len(b):
            a, b = b, a
        if len(a) + len(b) <= windows:
            for x in b:
                insort(a, x)
        else:
            empty = windows - len(a)  # these meet the fullest of b, the emptiest that hold something the rest
            alone = b[len(b) - empty :] if empty else []
            rest = b[: len(b) - empty] if empty else b
            met = []
            for i, x in enumerate(reversed(rest)):
                y = a[i]
                met.append((x[0] + y[0], y[1], (x[2], y[2])))
            a = sorted([*met, *a[len(rest) :], *alone])
        spread = a[-1][0] - (a[0][0] if len(a) == windows else 0)
        heapq.heappush(heap, (-spread, number, a))
    out = []
    for _, _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                items.append(x)
        out.append(sorted(items))
    return out


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``, as few as differencing reaches: their number rises while one is exceeded."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        k += 1


def deal(rests: list[tuple], capacity: int, sequence: int) -> list[tuple]:
    """Rows of the pieces (doc_id, start, ids, doc_tokens) in windows that are numbered from ``sequence`` on."""
    out = []
    for k, window in enumerate(windows_for([len(r[2]) // 4 for r in rests], capacity)):
        offset = 0
        for i in window:
            doc, start, ids, total = rests[i]
            out.append((doc, start, len(ids) // 4, ids, total, sequence + k, offset))
            offset += len(ids) // 4
    return out


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, piece: int = 512, block: int = 2048
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary: little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are ignored.  A null or
    empty text has the one id ``end_id``.  Null and repeated doc_ids are
    packed as any other row.  An empty table gives no piece.  A sequence has
    at most ``capacity`` ids and lies within one input split or one block of
    the splits' ends; its id is the number of the split, or of the block plus
    2^29, times 2^33 plus a running number.  What the splits give is
    checkpointed, so that texts are encoded once.
    """
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

    def batch_of(rows: list[tuple], *more: str) -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), [*kinds, *(pa.int64() for _ in more)])]
        return pa.record_batch(columns, names=[*names, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        split = TaskContext.get().partitionId()
        sequence = split << 33
        rests, waiting, out, held = [], 0, [], 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                whole = total - total % capacity
                for at in range(0, whole, capacity):
                    out.append((doc, at, capacity, ids[4 * at : 4 * (at + capacity)], total, sequence, 0, split))
                    sequence += 1
                rests += ((doc, at, ids[4 * at : 4 * (at + piece)], total) for at in range(whole, total, piece))
                waiting += 1
                if waiting == block:
                    dealt = deal(rests, capacity, sequence)
                    out += ((*row, split) for row in dealt)
                    sequence = dealt[-1][5] + 1 if dealt else sequence
                    rests, waiting = [], 0
                held += len(ids)
                if held > 1 << 23 and out:
                    yield batch_of(out, "split")
                    out, held = [], 0
        # without a sequence yet; their running number in place of the offset
        out += ((doc, at, len(ids) // 4, ids, total, None, i, split) for i, (doc, at, ids, total) in enumerate(rests))
        if out:
            yield batch_of(out, "split")

    def run_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rests, last = [], None
        for row in rows_of(batches):
            if rests and row["block"] != last:
                yield batch_of(deal(rests, capacity, (1 << 29) + last << 33))
                rests = []
            last = row["block"]
            rests.append((row["doc_id"], row["start"], row["ids"], row["doc_tokens"]))
        if rests:
            yield batch_of(deal(rests, capacity, (1 << 29) + last << 33))

    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    first = given.mapInArrow(run, f"{schema}, split long").checkpoint(eager=True)
    ends = first.where("sequence_id IS NULL")
    blocks = -(-ends.where(F.col("start") % capacity == 0).count() // block)  # a document's first piece stands there
    dealt = ends.withColumn("block", F.pmod(F.xxhash64("split", "offset"), F.lit(max(1, blocks))))
    ordered = dealt.repartition("block").sortWithinPartitions("block", "split", "offset")
    together = ordered.select("block", "doc_id", "start", "ids", "doc_tokens").mapInArrow(run_ends, schema)
    return first.where("sequence_id IS NOT NULL").drop("split").unionByName(together)
