"""Language identification by prediction by partial matching.

Every language has a byte context tree of orders 0 to 3, counted once and then
frozen.  The probability of a byte comes from its longest known context; where
the context has not seen the byte, an escape (method C, with exclusion) leads
to the next shorter one, and at last to equal chances.  A text's exact code
length under each tree is the sum over all its bytes, and the shortest one
names the language.

A byte that a language has seen in a context has its own probability there; any
other costs the context's escape and what it costs in the next shorter one.  So
a tree is stored as the code lengths of its seen bytes and one escape length a
context, whatever the number of languages.  The contexts met most often are
also resolved into a table of all bytes, which only saves time: the lengths are
the same with and without it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.llm.common import binary, hash_below, in_training_fold

MOST_BROADCAST = 1 << 23  # characters of language names
PAD = b"\n\n\n"  # what is taken to stand before a text


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray  # byte -> symbol; all bytes that no tree has seen share the last symbol
    state: np.ndarray  # symbols of the last three bytes -> row of the longest context that any tree knows
    parent: np.ndarray  # row -> row of the next shorter context; -1 for the empty one
    escape: np.ndarray  # (row, language) -> code length of an escape, 0 where the tree lacks the context
    codes: list[np.ndarray]  # per language, row * symbols + symbol of its seen bytes, in order
    lengths: list[np.ndarray]  # their code lengths
    place: np.ndarray  # row -> place in ``table``, -1 if it is not there
    table: np.ndarray  # (place, symbol, language) -> code length

    def resolve(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """(byte, language): code length of each symbol behind the context of its row, by escapes down to equal chances."""
        size = int(self.symbols.max()) + 1
        out = np.zeros((len(rows), len(self.languages)), dtype=np.float64)
        for k, (codes, lengths) in enumerate(zip(self.codes, self.lengths)):
            at, row, sym = np.arange(len(rows)), rows.astype(np.int64), symbols.astype(np.int64)
            while len(at):
                code = row * size + sym
                pos = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[pos] == code
                out[at[hit], k] += lengths[pos[hit]]
                at, row, sym = at[~hit], row[~hit], sym[~hit]
                out[at, k] += self.escape[row, k]
                row = self.parent[row]
                out[at[row < 0], k] += 8  # equal chances
                at, sym, row = at[row >= 0], sym[row >= 0], row[row >= 0]
        return out

    def found(self, rows: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """``resolve``, from the table where it has the context."""
        place = self.place[rows]
        out = self.table[place, symbols]
        rest = np.flatnonzero(place < 0)
        if len(rest):
            out[rest] = self.resolve(rows[rest], symbols[rest])
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(text, language): bits of every whole text."""
        out = np.zeros((len(texts), len(self.languages)))
        size = int(self.symbols.max()) + 1
        at = 0
        while at < len(texts):
            end, total = at, 0
            while end < len(texts) and (end == at or total + len(texts[end]) < 1 << 19):
                total += len(texts[end])
                end += 1
            joined = np.frombuffer(PAD + PAD.join(texts[at:end]), dtype=np.uint8)
            lengths = np.array([len(t) for t in texts[at:end]])
            firsts = np.cumsum(lengths + len(PAD)) - lengths
            s = self.symbols[joined]
            for a in range(0, len(s) - 3, 1 << 18):
                wide = s[a : a + (1 << 18) + 3].astype(np.int32)
                row = self.state[(wide[:-3] * size + wide[1:-2]) * size + wide[2:-1]]
                found = self.found(row, wide[3:])
                total_to = np.concatenate([np.zeros((1, found.shape[1])), np.cumsum(found, axis=0, dtype=np.float64)])
                # positions of this part that belong to each text
                lo = np.clip(firsts - 3 - a, 0, len(found))
                hi = np.clip(firsts - 3 - a + lengths, 0, len(found))
                out[at:end] += total_to[hi] - total_to[lo]
            at = end
        return out


def _tree(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """For each order 0 to 3: (codes of context and byte, their code lengths, contexts, their escape lengths, counts)."""
    out = []
    codes_low, p_low = None, None
    for order in range(4):
        codes, inv = np.unique(grams & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
        c = np.bincount(inv, weights=counts, minlength=len(codes))
        contexts, own = np.unique(codes >> 8, return_inverse=True)
        n, d = np.bincount(own, weights=c), np.bincount(own).astype(float)
        p = c / (n + d)[own]
        # a byte seen here has been seen in the shorter context as well
        low = p_low[np.searchsorted(codes_low, codes & ((1 << (8 * order)) - 1))] if order else np.full(len(codes), 1 / 256)
        left = np.maximum(1 - np.bincount(own, weights=low), 1e-12)
        out.append((codes, -np.log2(p), contexts, -np.log2(d / (n + d) / left), n))
        codes_low, p_low = codes, p
    return out


def build(rows: list[tuple[str, int, int]], table_bytes: int = 64_000_000) -> Model | None:
    """Model from (language, four bytes as a number, count); None without rows.  ``table_bytes`` changes no result."""
    names = sorted({r[0] for r in rows})
    number = {name: i for i, name in enumerate(names)}
    return build_arrays(
        names, np.array([number[r[0]] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64),
        np.array([r[2] for r in rows], dtype=np.int64), table_bytes,
    )


def build_arrays(
    languages: list[str], language: np.ndarray, grams: np.ndarray, counts: np.ndarray, table_bytes: int = 64_000_000
) -> Model | None:
    """``build`` from columns; ``language`` holds places in ``languages``."""
    if not languages:
        return None
    trees = [_tree(grams[language == k], counts[language == k].astype(float)) for k in range(len(languages))]
    seen = np.unique(np.concatenate([np.unique((grams >> s) & 255) for s in (0, 8, 16, 24)]))
    size = len(seen) + 1
    symbols = np.full(256, len(seen), dtype=np.uint16)
    symbols[seen] = np.arange(len(seen))
    sym = symbols.astype(np.int64)

    # rows of all contexts that any tree knows: the empty one, then those of order 1, 2 and 3
    known = [np.unique(np.concatenate([t[order][2] for t in trees])) for order in range(4)]
    first = np.concatenate([[0], np.cumsum([len(c) for c in known])])
    row_of = lambda order, contexts: first[order] + np.searchsorted(known[order], contexts)
    parent, often = np.full(first[-1], -1, dtype=np.int64), np.zeros(first[-1])
    escape = np.zeros((first[-1], len(languages)), dtype=np.float32)
    for order in range(1, 4):
        parent[first[order] : first[order + 1]] = row_of(order - 1, known[order] & ((1 << (8 * (order - 1))) - 1))
    codes, lengths = [], []
    for k, tree in enumerate(trees):
        own, bits = [], []
        for order, (code, length, contexts, esc, n) in enumerate(tree):
            own.append(row_of(order, code >> 8) * size + sym[code & 255])
            bits.append(length)
            rows = row_of(order, contexts)
            escape[rows, k] = esc
            often[rows] += n
        own, bits = np.concatenate(own), np.concatenate(bits)
        order_ = np.argsort(own)
        codes.append(own[order_])
        lengths.append(bits[order_].astype(np.float32))

    state = np.zeros((size, size, size), dtype=np.int32)
    for order in (1, 2, 3):
        c, rows = known[order], np.arange(first[order], first[order + 1], dtype=np.int32)
        a, b, z = sym[(c >> 16) & 255], sym[(c >> 8) & 255], sym[c & 255]
        if order == 1:
            state[:, :, z] = rows
        elif order == 2:
            state[:, b, z] = rows
        else:
            state[a, b, z] = rows

    model = Model(
        languages, symbols, state.reshape(-1), parent, escape, codes, lengths, np.full(first[-1], -1, dtype=np.int64),
        np.empty((0, size, len(languages)), dtype=np.float32),
    )
    room = max(1, table_bytes // (4 * size * len(languages)))
    chosen = np.sort(np.lexsort((np.arange(first[-1]), -often))[:room])
    table = np.empty((len(chosen), size, len(languages)), dtype=np.float32)
    for a in range(0, len(chosen), 4096):
        some = chosen[a : a + 4096]
        whole = model.resolve(np.repeat(some, size), np.tile(np.arange(size), len(some)))
        table[a : a + len(some)] = whole.reshape(len(some), size, -1)
    model.table = table
    model.place[chosen] = np.arange(len(chosen))
    return model


def train(docs: DataFrame, per_language: int = 2000) -> Model | None:
    """Trees of the languages of ``docs`` (doc_id, text, lang).

    They are fitted on a bounded sample of the rows with text, lang and a
    doc_id of the training fold: about ``per_language`` rows of each language
    (all, if it has fewer), by the hash of the id; rows repeated under one id
    come or go together.  Contexts are counted where the texts lie; the driver
    gets the counts of the distinct four-byte strings of the sample, so its share
    grows with the sample, not with the table.  No such row, an empty table
    included, gives no model.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & in_training_fold()
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).checkpoint()  # one row a language
    held = sizes.agg(F.sum(F.length("lang") + 16)).first()[0] or 0
    sizes = F.broadcast(sizes) if held <= MOST_BROADCAST else sizes  # else by an exchange, with the same rows
    chosen = hash_below(F.col("doc_id").cast("string"), F.col("n"), per_language)
    sample = rows.join(sizes, "lang").where(chosen).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = {}
            for lang, text in zip(batch.column(0).to_pylist(), binary(batch.column(1))):
                by.setdefault(lang, []).append(PAD + text)
            for lang, texts in by.items():
                parts = []
                for text in texts:
                    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
                    parts.append((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:])
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.record_batch(
                    [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = counted.toArrow()
    names = sorted(pc.unique(table["lang"]).to_pylist())
    at = pc.index_in(table["lang"], pa.array(names, table["lang"].type)).to_numpy().astype(np.int64)
    return build_arrays(names, at, table["gram"].to_numpy(), table["n"].to_numpy())


def predict(docs: DataFrame, model: Model | None, append: bool = False) -> DataFrame:
    """lang_pred, score and bits_per_byte of every row of ``docs``.

    A row gives doc_id and these, with ``append`` all its own columns and
    these, which take the place of columns of their names.  Repeated rows come
    back repeated, an empty table gives no row.  ``lang_pred`` is
    ``und`` and score 0 where the text is null or has no letter, or where
    nothing was learned; otherwise the language of least code length (ties:
    the first by name), and score its probability if all were as likely
    before.  Texts are read whole.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "bits_per_byte") if append else docs
    given = docs if append else docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    at_text, out = given.columns.index("text"), given.columns if append else ["doc_id"]
    kind = given.select(*out).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(at_text).to_pylist()
                lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts]
                names = ["und"] * len(texts)
                score, rate = np.zeros(len(texts)), np.zeros(len(texts))
                at = [i for i, yes in enumerate(lettered) if yes and m]
                if at:
                    raw = [texts[i].encode() for i in at]
                    bits = m.code_lengths(raw)
                    best = bits.argmin(axis=1)
                    low = bits.min(axis=1, keepdims=True)
                    score[at] = 1 / np.exp2(np.maximum(low - bits, -1000)).sum(axis=1)
                    rate[at] = low[:, 0] / [len(t) for t in raw]
                    for i, k in zip(at, best):
                        names[i] = m.languages[k]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(out)], pa.array(names), pa.array(score), pa.array(rate)], names=kind.names
                )

    return given.mapInArrow(run, kind)
