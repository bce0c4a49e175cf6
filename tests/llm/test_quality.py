"""Quality classifier: gradients, accuracy on the held-out fold, and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from repsight.llm import quality
from repsight.llm.queries import QUERIES

from .conftest import LONG

MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op9_mil_quality"](spark, MID).collect()]
    assert len(rows) == spark.read.parquet(f"{MID}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_attention_finds_the_bad_passage():
    """Only the document is labelled; the passage that tells gets the weight."""
    rng = np.random.default_rng(1)
    good = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], n)).encode()
    bad = b"$$$ ### %%% " * 43
    texts, y = [], []
    for i in range(300):
        t = good(300)
        texts.append(t[:512] + bad[:512] + t[512:] if i % 2 else t)
        y.append(1 - i % 2)
    x, owner = quality.encode(texts)
    model = quality.fit(x, owner, np.array(y, dtype=np.float32))
    scores = model.scores(texts)
    assert ((scores > 0.5) == (np.array(y) == 1)).all()
    v = model.forward(model.prepare(x), owner, len(texts))
    assert all(np.isclose(np.add.reduceat(v["att"], np.searchsorted(owner, np.arange(300))), 1, atol=1e-4))


def test_passages_cover_whole_texts():
    texts = [b"", b"a", LONG.encode(), b"x" * 512, b"x" * 513]
    x, owner = quality.encode(texts)
    assert np.bincount(owner).tolist() == [1, 1, -(-len(texts[2]) // 512), 1, 2]
    one = [quality.encode([t])[0] for t in texts]
    assert np.allclose(np.concatenate(one), x, atol=1e-6)  # a text's features do not depend on its neighbours


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in (1, 2, 3, 5, 6, -7, 8)] + [(6, None, 0), (None, 1, 0), (5, 0, 1), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    clash = odd_docs.withColumn("quality_score", F.lit("x")).withColumn("y", F.lit(1))
    model = quality.train(clash, labels)
    got = quality.score(clash, model).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.quality_score <= 1 for r in got)
    none = quality.train(odd_docs, labels.limit(0))
    assert none is None and {r.quality_score for r in quality.score(odd_docs, none).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0 and quality.train(no_docs, labels) is None


def test_repetition_counts_at_every_distance():
    rng = np.random.default_rng(3)
    passage = bytes(rng.integers(33, 127, 60, dtype=np.uint8))
    column = quality.CLASSES + quality.PAIRS
    for length in range(100, 104):
        between = bytes(rng.integers(33, 127, length, dtype=np.uint8))
        text = passage + between + passage
        x, _ = quality.encode([text, b"x", between])
        windows = [text[i : i + 24] for i in range(len(text) - 23)]
        assert len(windows) - len(set(windows)) == 37
        assert np.isclose(x[0, column], 37 / len(text)) and x[2, column] == 0


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(5)
    f, hidden, gate = 7, 5, 4
    p = {"w": rng.normal(size=(f, hidden)), "b": rng.normal(size=hidden), "v": rng.normal(size=(hidden, gate)),
         "u": rng.normal(size=(hidden, gate)), "a": rng.normal(size=gate), "o": rng.normal(size=hidden), "c": rng.normal(size=1)}
    model = quality.Model(np.zeros(f), np.ones(f), p)
    owner, y = np.repeat(np.arange(4), [1, 3, 2, 5]), np.array([1.0, 0.0, 0.3, 1.0])
    x = rng.normal(size=(len(owner), f))

    def loss():
        out = model.forward(x, owner, len(y))["y"]
        return -np.mean(y * np.log(out) + (1 - y) * np.log(1 - out))

    # the forward pass against a plain loop over documents and passages
    out = model.forward(x, owner, len(y))
    for d in range(len(y)):
        h = [np.maximum(row @ p["w"] + p["b"], 0) for row in x[owner == d]]
        e = np.array([np.exp((np.tanh(z @ p["v"]) / (1 + np.exp(-(z @ p["u"])))) @ p["a"]) for z in h])
        z = sum(w * v for w, v in zip(e / e.sum(), h))
        assert np.isclose(out["y"][d], 1 / (1 + np.exp(-(z @ p["o"] + p["c"][0]))))
    grad = model.gradients(out, owner, y)
    for name, values in p.items():
        flat = values.reshape(-1)
        for i in range(len(flat)):
            was, step = flat[i], 1e-6
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert np.isclose(grad[name].reshape(-1)[i], (up - down) / (2 * step), atol=1e-6), name


def test_fit_and_score_clip_alike():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, quality.FEATURES)).astype(np.float32)
    model = quality.fit(x, np.arange(200), (x[:, 0] > 0).astype(np.float32), epochs=1)
    far = np.full((1, quality.FEATURES), 1e6, dtype=np.float32)
    assert abs(model.prepare(far)).max() == quality.CLIP
    emoji = "\U0001f600\U0001f601 ".encode() * 300
    assert abs(model.prepare(quality.encode([emoji])[0])).max() <= quality.CLIP


def test_long_texts_are_encoded_in_blocks(monkeypatch):
    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 123, 6, dtype=np.uint8)) for _ in range(400)]
    text = b" ".join(words[i] for i in rng.integers(0, 400, 3000)) + b"\n" + "é漢 Ab9$ ".encode() * 200
    for block in (512, 4096):
        monkeypatch.setattr(quality, "LONG", block)
        for t in (text, text[: 512 * 8], text[: 512 * 8 + 3]):
            assert np.allclose(quality.encode_long(t), quality.encode([t])[0], atol=1e-5)


def test_a_very_long_text_takes_little_memory():
    import tracemalloc

    text = b"".join(b"%d words of a line of a very long text\n" % i for i in range(1_250_000))
    assert len(text) > 50_000_000
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), quality.fit(
        np.zeros((2, quality.FEATURES), dtype=np.float32), np.arange(2), np.array([0, 1], dtype=np.float32), epochs=1
    ).p)
    tracemalloc.start()
    assert 0 <= model.scores([text])[0] <= 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1 << 30


def test_appended_score_takes_the_place_of_its_name(odd_docs):
    got = quality.score(odd_docs.withColumn("quality_score", F.lit("x")), None, append=True)
    assert got.columns == [*odd_docs.columns, "quality_score"] and {r.quality_score for r in got.collect()} == {0.5}
