"""SentencePiece encoding by sampling, and lossless decoding.

Over a text lies the lattice of all pieces of the model.  It falls into units,
cut between two characters that stand side by side in no piece, so no piece
reaches over a unit's end and the units' segmentations are independent.
Forward filtering sums the weights of all ways to each place,
and backward sampling draws a segmentation with its exact probability.  The
number drawn at a place comes from the row's key and the place, so a row is
always segmented alike, whatever other rows are handled with it.  Both passes
run over many units at a time: place by place forward, piece by piece backward.
A long unit is run through alone, block by block, and each block's lattice is
made anew on the way back.  The sums are scaled by powers of two as they go, so
that units of any length stay within a float's range.

The model's scores are ranks; a piece of rank r weighs ``(r + 2) ** -sharpness``.
A character that no piece holds is spelled by its byte pieces, as is the
model's own sign for a blank where the text has it itself: so decoding gives
back every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
_SCALE = 2000.0
#: In place of a piece's id: no piece starts here, and a character spelled by its bytes.
_NONE, _SPELLED = -1, -2
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 to under 1, mixed from 64-bit keys (the finaliser of splitmix64)."""
    z = (keys ^ keys >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)) * 2.0**-53


class Codec:
    """Pieces of one model; segments ``units`` units at a time, of ten characters each on average at most, and units
    of over ``long`` characters in blocks of so many, which bounds the memory taken."""

    def __init__(self, path: str, sharpness: float, units: int = 40_000, long: int = 4096):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.weights: dict[str, tuple[int, float]] = {}
        self.byte_ids = np.zeros(256, np.int32)
        self.texts: list[bytes] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.texts.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.texts.append(b"")
            else:
                self.weights[piece] = (i, (2 - sp.get_score(i)) ** -sharpness * _SCALE ** len(piece))
                self.texts.append(piece.replace(BLANK, " ").encode())
        self.longest = max(map(len, self.weights))
        self.fallback = (2 + size) ** -sharpness
        self.units, self.long = units, long
        # which characters stand side by side in a piece, by numbers of those that are a first or second one; 0: none
        pairs = sorted({p[i : i + 2] for p in self.weights for i in range(len(p) - 1)})
        self.first_of, self.second_of = np.zeros(1 << 21, np.uint16), np.zeros(1 << 21, np.uint16)
        for numbers, k in ((self.first_of, 0), (self.second_of, 1)):
            some = sorted({ord(p[k]) for p in pairs})
            numbers[some] = np.arange(1, len(some) + 1)
        self.joined = np.zeros((int(self.first_of.max()) + 1, int(self.second_of.max()) + 1), bool)
        for x, y in pairs:
            self.joined[self.first_of[ord(x)], self.second_of[ord(y)]] = True
        #: For each length the pieces' beginnings in order: number of the one shorter by a character and that
        #: character in one key, the id of the piece that this is (or _NONE), and its weight.
        self.beginnings: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        number = {"": 0}
        for n in range(1, self.longest + 1):
            some = sorted({p[:n] for p in self.weights if len(p) >= n})
            keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in some])
            ids, weights = zip(*(self.weights.get(p, (_NONE, 0.0)) for p in some))
            self.beginnings.append((keys, np.array(ids, np.int32), np.array(weights)))
            number = {p: i for i, p in enumerate(some)}

    @staticmethod
    def signs(text: str) -> np.ndarray:
        """Code points as the pieces have them."""
        return np.frombuffer(text.replace(BLANK, "\x00").replace(" ", BLANK).encode("utf-32-le"), "<u4")

    def bounds(self, text: str) -> np.ndarray:
        """Where the units of a text begin, and its end."""
        cuts = [np.zeros(1, np.int64)]
        for at in range(0, len(text), 1 << 20):
            signs = self.signs(text[at : at + (1 << 20) + 1])
            apart = ~self.joined[self.first_of[signs[:-1]], self.second_of[signs[1:]]]
            cuts.append(np.flatnonzero(apart) + at + 1)
        return np.concatenate([*cuts, [len(text)]] if text else cuts)

    def matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """By the place of its last character and its length the weight and the id of each piece in the text."""
        signs = self.signs(text).astype(np.int64)
        signs = np.append(signs, np.full(self.longest, (1 << 21) - 1))  # no character
        ways = np.full((len(text), self.longest), _SPELLED, np.int32)
        found = np.zeros(ways.shape)
        start, node = np.arange(len(text)), np.zeros(len(text), np.int64)
        for n, (keys, ids, weights) in enumerate(self.beginnings):  # the places from where a piece's beginning still fits
            key = node << 21 | signs[start + n]
            node = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            fits = keys[node] == key
            start, node = start[fits], node[fits]
            whole = ids[node] != _NONE
            end, piece = start[whole] + n, node[whole]
            ways[end, n], found[end, n] = ids[piece], weights[piece]
        bare = np.flatnonzero(ways[:, 0] == _SPELLED)  # no piece for the character itself
        width = 1 + np.searchsorted([0x80, 0x800, 0x10000], np.frombuffer(text.encode("utf-32-le"), "<u4")[bare], "right")
        found[bare, 0] = self.fallback**width * _SCALE
        return found, ways

    def lattices(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lattices of units, a row for each place: by length of the piece that ends there, the cumulated weights of
        the ways into it and the pieces' ids; and each unit's row of its start.

        Every weight has a factor ``_SCALE`` a character, the same for all
        segmentations, and all in a row have the same power of two.
        """
        text = "\n" + "\n".join(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        first = np.cumsum(sizes + 1) - sizes - 1
        cumulated, ways = self.matches(text)

        order = np.argsort(-sizes, kind="stable")
        forward = np.zeros(len(text))
        forward[first] = 1.0
        for j in range(1, int(sizes.max()) + 1):  # pieces that would begin before their unit are left out
            rows = first[order[: np.count_nonzero(sizes >= j)]] + j
            n = min(j, self.longest)
            sums = np.cumsum(cumulated[rows, :n] * forward[rows[:, None] - np.arange(1, n + 1)], axis=1)
            cumulated[rows, :n], cumulated[rows, n:], forward[rows] = sums, sums[:, -1:], sums[:, -1]
            if j % self.longest == 0:  # the sums that are still read
                last = rows[:, None] - np.arange(n)
                forward[last] = np.ldexp(forward[last], -np.frexp(forward[rows])[1][:, None])
        return cumulated, ways, first

    def lattice(self, unit: str) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place of a unit the ways into it: their cumulated weights and ids by length of the last piece."""
        return list(zip(*self.lattices([unit])[:2]))

    def sample(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a sampled segmentation of each unit, and where each unit's ids end.

        The number drawn at a place comes from the unit's key and the place alone.
        """
        index: dict[str, int] = {}
        which = np.array([index.setdefault(u, len(index)) for u in units])
        cumulated, ways, first = self.lattices(list(index))
        text, start = "".join(units), first[which]
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        chosen = np.full(len(text), _NONE, np.int32)
        live, at = np.arange(len(units)), sizes
        while live.size:
            rows = start[live] + at
            sums = cumulated[rows]
            drawn = uniform(keys[live] + at.astype(np.uint64) * _GOLDEN) * sums[:, -1]
            column = (sums <= drawn[:, None]).sum(axis=1)
            at = at - column - 1
            chosen[(ends - sizes)[live] + at] = ways[rows, column]
            live, at = live[at > 0], at[at > 0]
        return self.spell(text, chosen, ends)

    def spell(self, text: str, chosen: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces chosen by place of their beginning, with bytes spelled, and where the ids of the parts up
        to ``ends`` end."""
        spelling = np.frombuffer(text.encode(), np.uint8)
        leads = spelling & 0xC0 != 0x80
        taken = chosen[np.cumsum(leads) - 1]
        ids = np.where(taken == _SPELLED, self.byte_ids[spelling], np.where(leads, taken, _NONE))
        kept = ids != _NONE
        bounds = np.append(np.flatnonzero(leads), len(spelling))[ends]
        return ids[kept], np.cumsum(kept)[bounds - 1]

    def block(self, unit: str, begin: int, end: int, forward: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Part of a unit's lattice, and the last sums behind it, from the last sums before it."""
        longest, context = self.longest, min(begin, self.longest - 1)
        cumulated, ways = (x[context:] for x in self.matches(unit[begin - context : end]))
        forward = np.concatenate([forward, np.zeros(end - begin)])
        for j in range(end - begin):
            cumulated[j] = sums = np.cumsum(cumulated[j] * forward[j : j + longest][::-1])
            forward[j + longest] = sums[-1]
            if (begin + j + 1) % longest == 0:
                forward[j + 1 : j + longest + 1] = np.ldexp(forward[j + 1 : j + longest + 1], -np.frexp(sums[-1])[1])
        return cumulated, ways, forward[end - begin :]

    def sample_long(self, unit: str, key: np.uint64) -> np.ndarray:
        """Ids of a sampled segmentation of one unit, as ``sample`` gives them, block by block."""
        forward, before = np.append(np.zeros(self.longest - 1), 1.0), []
        begins = range(0, len(unit), self.long)
        for begin in begins:
            before.append(forward)
            cumulated, ways, forward = self.block(unit, begin, min(len(unit), begin + self.long), forward)
        chosen, at = np.full(len(unit), _NONE, np.int32), len(unit)
        for begin in reversed(begins):
            end = min(len(unit), begin + self.long)
            if end < len(unit):
                cumulated, ways, _ = self.block(unit, begin, end, before[begin // self.long])
            drawn = uniform(key + np.arange(begin + 1, end + 1).astype(np.uint64) * _GOLDEN) * cumulated[:, -1]
            while at > begin:
                row = at - 1 - begin
                column = int(np.count_nonzero(cumulated[row] <= drawn[row]))
                at -= column + 1
                chosen[at] = ways[row, column]
        return self.spell(unit, chosen, np.array([len(unit)]))[0]

    def encode_rows(self, texts: Iterable[str], seeds: Iterable[int]) -> list[np.ndarray]:
        """For each text the ids of one sampled segmentation of the whole of it."""
        out: list[list[np.ndarray]] = []
        units: list[str] = []
        parts: list[tuple[int, int, int, int]] = []  # row, seed, place of the first unit in its text, units
        held = 0  # characters in the units

        def flush() -> None:
            nonlocal held
            sizes = np.fromiter(map(len, units), np.int64, len(units))
            before, counts = np.cumsum(sizes) - sizes, [n for *_, n in parts]
            begins = np.cumsum(counts) - counts
            seeds_, places = np.array([p[1] for p in parts], np.uint64), np.array([p[2] for p in parts]) - before[begins]
            places = (before + np.repeat(places, counts)).astype(np.uint64)
            ids, ends = self.sample(units, np.repeat(seeds_, counts) + places * _GOLDEN)
            for (row, *_), got in zip(parts, np.split(ids, ends[np.cumsum(counts)[:-1] - 1])):
                out[row].append(got)
            units.clear()
            parts.clear()
            held = 0

        for row, (text, seed) in enumerate(zip(texts, seeds)):
            out.append([])
            bounds, n = self.bounds(text), 0
            over = np.append(np.flatnonzero(np.diff(bounds) > self.long), len(bounds) - 1).tolist()
            while n < len(bounds) - 1:
                place = int(bounds[n])
                if n == over[0]:
                    if units:
                        flush()
                    key = np.array([seed], np.uint64) + np.array([place], np.uint64) * _GOLDEN
                    out[row].append(self.sample_long(text[place : bounds[n + 1]], key))
                    n += 1
                    del over[0]
                    continue
                room = int(np.searchsorted(bounds, place + 10 * self.units - held, "right")) - 1
                end = min(over[0], n + self.units - len(units), max(room, n + 1))
                places = bounds[n : end + 1].tolist()
                units += [text[a:b] for a, b in zip(places, places[1:])]
                parts.append((row, seed, place, end - n))
                held, n = held + places[-1] - place, end
                if len(units) == self.units or held >= 9 * self.units:
                    flush()
        if units:
            flush()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def encode(self, text: str, seed: int) -> list[int]:
        return self.encode_rows([text], [seed])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        texts = self.texts
        return b"".join([texts[i] for i in ids]).decode()


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, sharpness: float) -> Codec:
    """One codec per worker process, file and sharpness."""
    if (path, sharpness) not in _CODECS:
        _CODECS[path, sharpness] = Codec(path, sharpness)
    return _CODECS[path, sharpness]


def seed_of(key: int | None, salt: int) -> int:
    return xxhash.xxh64_intdigest(b"" if key is None else str(key).encode(), seed=salt)


def encode_and_decode(docs: DataFrame, model: str, sharpness: float = 1.0, salt: int = 0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_pieces, ids (binary: little-endian 32-bit), decoded.

    ``docs`` needs doc_id and text; other columns are ignored.  A null text
    counts as empty and has no piece.  The doc_id and ``salt`` are the seed:
    repeated rows are segmented alike, as are all rows without id of one text.
    Whole texts are read; an empty table gives an empty result.  The plan is
    one pass over the input, without exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model, sharpness)

        def result(docs: list[int | None], texts: list[str]) -> pa.RecordBatch:
            ids = own.encode_rows(texts, [seed_of(doc, salt) for doc in docs])
            columns = {
                "doc_id": pa.array(docs, pa.int64()),
                "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                "decoded": pa.array([own.decode(x.tolist()) for x in ids], pa.string()),
            }
            return pa.record_batch(columns)

        docs, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append(doc)
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > 1 << 20:
                    yield result(docs, texts)
                    docs, texts, size = [], [], 0
        if docs:
            yield result(docs, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_pieces long, ids binary, decoded string"
    )
