"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` bytes.  Every passage is encoded as
a vector of byte-class, byte-pair and repetition features; a gated attention
network, learned from document labels alone, weighs the passages, and the
weighted passage representation gives the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repsight.llm.common import hash_below, in_training_fold

PASSAGE = 512
CLIP = 8.0
LONG = 1 << 21  # bytes of a text that are encoded at a time; a multiple of PASSAGE
PAIRS = 128


def _classes() -> np.ndarray:
    """Byte -> class: lower, upper, digit, control, non-ASCII lead, continuation, each ASCII mark, space, newline, tab."""
    own = np.zeros(256, dtype=np.int64)
    own[:32] = own[127] = 3
    own[ord("a") : ord("z") + 1], own[ord("A") : ord("Z") + 1], own[ord("0") : ord("9") + 1] = 0, 1, 2
    own[128:192], own[192:] = 5, 4
    marks = [b for b in range(32, 127) if not chr(b).isalnum()] + [9, 10]
    own[marks] = np.arange(6, 6 + len(marks))
    return own


CLASS = _classes()
CLASSES = int(CLASS.max()) + 1
FEATURES = CLASSES + PAIRS + 5
_PAIR = ((np.arange(CLASSES)[:, None] * 2654435761 + np.arange(CLASSES)[None, :] * 40503) >> 5) % PAIRS


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passage, feature) of the passages of all texts, and each passage's text; an empty text has one passage."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    parts = np.maximum(1, -(-lengths // PASSAGE))
    first = np.cumsum(parts) - parts
    n = int(parts.sum())
    owner = np.repeat(np.arange(len(texts)), parts)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if not len(b):
        out[:, -1] = 1 / PASSAGE
        return out, owner
    text_of = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(b)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = first[text_of] + place // PASSAGE
    size = np.maximum(1, np.bincount(passage, minlength=n))[:, None]
    c = CLASS[b]
    hist = np.bincount(passage * CLASSES + c, minlength=n * CLASSES).reshape(n, CLASSES) / size
    pairs = np.bincount(
        passage[1:] * PAIRS + _PAIR[c[:-1], c[1:]], weights=text_of[1:] == text_of[:-1], minlength=n * PAIRS
    ).reshape(n, PAIRS) / size
    out[:, :CLASSES], out[:, CLASSES : CLASSES + PAIRS] = np.sqrt(hist), np.sqrt(pairs)
    again, words, lines = np.zeros(n), np.zeros(n), np.zeros(n)
    # places whose last 24 bytes stood before in the same text, by a hash of the whole window
    if len(b) >= 24:
        h = _windows(b)
        end = np.arange(len(h)) + 23
        inside = text_of[end] == text_of[: len(h)]
        h, end = h[inside] ^ (text_of[end][inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), end[inside]
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again = np.bincount(passage[end[order][1:][same]], minlength=n) / size[:, 0]
    space = (b == 32) | (b == 10)
    words = np.bincount(passage[space], minlength=n) / size[:, 0]
    lines = np.bincount(passage[b == 10], minlength=n) / size[:, 0]
    extra = np.stack([again, words, np.sqrt(lines), np.log1p(lengths[owner]) / 10, size[:, 0] / PASSAGE], axis=1)
    out[:, CLASSES + PAIRS :] = extra
    return out, owner


def _windows(b: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on."""
    h = b.astype(np.uint64)
    for step in (1, 2, 4, 8):
        h = h[:-step] * np.uint64(pow(1_000_003, step, 1 << 64)) + h[step:]
    return h[:-8] * np.uint64(0x9E3779B97F4A7C15) + h[8:]


def encode_long(text: bytes) -> np.ndarray:
    """``encode`` of one text, a block of ``LONG`` bytes at a time.

    Repeated windows are found among those of one share of the hashes after
    another, so no list is as long as the text, but for one hash in ``LONG``
    bytes' worth of windows on average.
    """
    n = len(text)
    again = np.zeros(-(-n // PASSAGE))
    shares = -(-n // LONG)
    for share in range(shares):
        hashes, ends = [], []
        for a in range(0, n, LONG):
            b = np.frombuffer(text[a : a + LONG + 23], dtype=np.uint8)
            if len(b) >= 24:
                h = _windows(b)
                own = np.flatnonzero((h >> np.uint64(40)) % np.uint64(shares) == share)
                hashes.append(h[own])
                ends.append(own + a + 23)
        h, end = np.concatenate(hashes), np.concatenate(ends)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        again += np.bincount(end[order][1:][same] // PASSAGE, minlength=len(again))
    out = []
    for a in range(0, n, LONG):
        x, _ = encode([text[a : a + LONG]])
        size = min(PASSAGE, n - a)
        if a:  # the pair across the blocks' edge
            pair = CLASSES + _PAIR[CLASS[text[a - 1]], CLASS[text[a]]]
            x[0, pair] = np.sqrt(x[0, pair] ** 2 + 1 / size)
        out.append(x)
    x = np.concatenate(out)
    sizes = np.minimum(PASSAGE, n - np.arange(len(x)) * PASSAGE)
    x[:, CLASSES + PAIRS], x[:, CLASSES + PAIRS + 3] = again / sizes, np.log1p(n) / 10
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        """All values of the network for passages ``x`` of ``n`` texts; ``owner`` is in order, every text has one."""
        p, v = self.p, {}
        v["x"] = x
        v["h"] = np.maximum(x @ p["w"] + p["b"], 0)  # passage representation
        v["t"], v["g"] = np.tanh(v["h"] @ p["v"]), _sigmoid(v["h"] @ p["u"])
        e = (v["t"] * v["g"]) @ p["a"]
        start = np.searchsorted(owner, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, start)[owner])
        v["att"] = e / np.add.reduceat(e, start)[owner]
        v["z"] = np.add.reduceat(v["h"] * v["att"][:, None], start, axis=0)
        v["y"] = _sigmoid(v["z"] @ p["o"] + p["c"])
        return v

    def gradients(self, v: dict[str, np.ndarray], owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy of labels ``y`` by the parameters, from the values of ``forward``."""
        p, start = self.p, np.searchsorted(owner, np.arange(len(y)))
        dz_out = (v["y"] - y) / len(y)
        grad = {"o": v["z"].T @ dz_out, "c": dz_out.sum(keepdims=True)}
        dz = dz_out[:, None] * p["o"]
        datt = (v["h"] * dz[owner]).sum(axis=1)
        de = v["att"] * (datt - np.add.reduceat(datt * v["att"], start)[owner])
        grad["a"] = (v["t"] * v["g"]).T @ de
        dt = de[:, None] * p["a"] * v["g"] * (1 - v["t"] ** 2)
        dg = de[:, None] * p["a"] * v["t"] * v["g"] * (1 - v["g"])
        grad["v"], grad["u"] = v["h"].T @ dt, v["h"].T @ dg
        dh = (dz[owner] * v["att"][:, None] + dt @ p["v"].T + dg @ p["u"].T) * (v["h"] > 0)
        grad["w"], grad["b"] = v["x"].T @ dh, dh.sum(axis=0)
        return grad

    def prepare(self, x: np.ndarray) -> np.ndarray:
        """Features in units of their spread over the training passages, at most ``CLIP`` of them: alike in fit and score."""
        return np.clip((x - self.mean) * self.scale, -CLIP, CLIP).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x, owner = encode(texts) if len(texts) > 1 or len(texts[0]) <= LONG else (encode_long(texts[0]), None)
        owner = np.zeros(len(x), dtype=np.int64) if owner is None else owner
        return self.forward(self.prepare(x), owner, len(texts))["y"]


def fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 12) -> Model:
    """Network for passages ``x`` of documents ``owner`` with labels ``y``, by Adam on batches of documents."""
    rng = np.random.default_rng(7)
    mean, std = x.mean(axis=0), x.std(axis=0)
    f = x.shape[1]
    p = {
        "w": rng.normal(0, np.sqrt(2 / f), (f, hidden)), "b": np.zeros(hidden),
        "v": rng.normal(0, 0.3, (hidden, gate)), "u": rng.normal(0, 0.3, (hidden, gate)), "a": rng.normal(0, 0.3, gate),
        "o": rng.normal(0, 0.3, hidden), "c": np.zeros(1),
    }
    model = Model(mean, np.where(std > 1e-4, 1 / np.maximum(std, 1e-4), 0), {k: v.astype(np.float32) for k, v in p.items()})
    x, p = model.prepare(x), model.p
    m1, m2, step = {k: 0 * v for k, v in p.items()}, {k: 0 * v for k, v in p.items()}, 0
    bounds = np.searchsorted(owner, np.arange(len(y) + 1))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            docs = order[at : at + 64]
            rows = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), bounds[docs + 1] - bounds[docs])
            v = model.forward(x[rows], own, len(docs))
            grad = model.gradients(v, own, y[docs])
            step += 1
            rate = 0.004 * (1 - epoch / epochs) + 0.0002
            for k in p:
                g = grad[k] + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Model | None:
    """Model from the labelled rows of the training fold; None if no label is left.

    It is fitted on a bounded sample: about ``sample`` of the labelled doc_ids
    that ``docs`` has (all, if fewer), by their hash, with their whole texts.  A
    doc_id of several labels counts by their mean; one of several rows counts
    by its first text in order of the text's md5.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double"))
        .where(F.col("quality").isNotNull() & in_training_fold())
        .groupBy("doc_id").agg(F.avg("quality").alias("y"))
    )
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = marked.join(rows.select("doc_id"), "doc_id", "left_semi")
    chosen = known.where(hash_below(F.col("doc_id").cast("string"), F.lit(known.count()), sample))
    texts = (
        rows.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min_by("text", F.md5("text")).alias("text"), F.first("y").alias("y"))
    )
    found = sorted(texts.select("doc_id", "y", F.col("text").cast("binary")).toArrow().to_pylist(), key=lambda r: r["doc_id"])
    if not found:
        return None
    parts = [encode_long(r["text"]) if len(r["text"]) > LONG else encode([r["text"]])[0] for r in found]
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    return fit(np.concatenate(parts), owner, np.array([r["y"] for r in found], dtype=np.float32))


def score(docs: DataFrame, model: Model | None, append: bool = False) -> DataFrame:
    """quality_score (0 to 1) of every row of ``docs``, with its doc_id or, with ``append``, all its columns.

    Texts are read whole; a null text counts as empty, and an empty text has
    one empty passage.  Without a model every score is 0.5.  With ``append`` the
    score takes the place of a column of its name.  Repeated rows come back
    repeated, an empty table gives no row.
    """
    docs = docs.drop("quality_score") if append else docs
    known = docs.sparkSession.sparkContext.broadcast(model)
    given = docs if append else docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    at_text, out = given.columns.index("text"), given.columns if append else ["doc_id"]
    kind = given.select(*out).schema.add("quality_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            column, at = batch.column(at_text), 0
            while at < batch.num_rows:
                end, size, texts = at, 0, []
                while end < batch.num_rows and size < 1 << 19:
                    text = (column[end].as_py() or "").encode()
                    if texts and len(text) > LONG:
                        break  # a long text is scored by itself
                    texts.append(text)
                    size += len(text)
                    end += 1
                values = m.scores(texts) if m else np.full(len(texts), 0.5)
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(out)], pa.array(values.astype(np.float64))], names=kind.names
                )
                at = end

    return given.mapInArrow(run, kind)
