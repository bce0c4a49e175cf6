"""Language ID: the trees against their definition, and accuracy on the held-out fold."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from repsight.llm import language
from repsight.llm.queries import QUERIES

MID = "/root/testdata/sf0.01"


def grams(texts):
    out = {}
    for lang, text in texts:
        b = language.PAD + text.encode()
        for i in range(3, len(b)):
            g = (lang, int.from_bytes(b[i - 3 : i + 1], "big"))
            out[g] = out.get(g, 0) + 1
    return [(lang, g, n) for (lang, g), n in out.items()]


def probability(texts, lang, context, byte):
    """Method C with exclusion, straight from the counts."""
    if context is None:
        return 1 / 256
    counts = {}
    for own, text in texts:
        if own == lang:
            b = language.PAD + text.encode()
            for i in range(3, len(b)):
                if b[i - len(context) : i] == context:
                    counts[b[i]] = counts.get(b[i], 0) + 1
    shorter = context[1:] if context else None
    if not counts:
        return probability(texts, lang, shorter, byte)
    n, d = sum(counts.values()), len(counts)
    if byte in counts:
        return counts[byte] / (n + d)
    left = 1 - sum(probability(texts, lang, shorter, x) for x in counts)
    return d / (n + d) * probability(texts, lang, shorter, byte) / left


TEXTS = [("aa", "the cat the hat that"), ("aa", "a theme"), ("bb", "der die das und"), ("bb", "über das")]


def test_code_lengths_follow_the_definition():
    model = language.build(grams(TEXTS))
    rng = random.Random(4)
    texts = ["the das", "über", "xyz q", "", "th\n\n\nth", *("".join(rng.choice("the dasuüxq") for _ in range(30)) for _ in range(5))]
    got = model.code_lengths([t.encode() for t in texts])
    for text, bits in zip(texts, got):
        b = language.PAD + text.encode()
        for k, lang in enumerate(model.languages):
            want = -sum(np.log2(probability(TEXTS, lang, b[i - 3 : i], b[i])) for i in range(3, len(b)))
            assert bits[k] == pytest.approx(want, rel=1e-4, abs=1e-3)
    long = "the das " * 200_000  # longer than a part
    assert model.code_lengths([long.encode()])[0] == pytest.approx(
        model.code_lengths([("the das " * 2000).encode()])[0] * 100, rel=1e-2
    )


def test_small_table_falls_back():
    small = language.build(grams(TEXTS), table_bytes=1)
    assert small.code_lengths([b"the theme"]).argmin() == 0 and small.code_lengths(["über das".encode()]).argmin() == 1


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    right = n = 0
    for r in QUERIES["op5_ppm_language_id"](spark, MID).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        if r.held_out:
            n, right = n + 1, right + (r.lang_pred == docs[r.doc_id].lang)
    assert right / n > 0.98


def test_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumn("score", F.lit("x")).withColumn("h", F.lit(1))
    model = language.train(clash)
    assert model.languages == ["de", "en"] or model.languages == ["en"]
    got = language.predict(clash, model).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        if r.doc_id in (1, 2, 3, 8):
            assert (r.lang_pred, r.score) == ("und", 0)
        elif r.doc_id is not None:
            assert r.lang_pred in model.languages
    assert language.train(no_docs) is None and language.predict(no_docs, None).count() == 0
    assert {r.lang_pred for r in language.predict(odd_docs, None).collect()} == {"und"}


def test_the_table_changes_no_code_length_however_many_languages():
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñç"
    texts = []
    for k in range(30):
        own = rng.sample(letters, 8)
        texts += [(f"l{k:02}", " ".join("".join(rng.choice(own) for _ in range(rng.randrange(1, 7))) for _ in range(40)))] * 2
    full, least, some = (language.build(grams(texts), b) for b in (1 << 30, 1, 200_000))
    assert len(least.table) == 1 < len(some.table) < len(full.table) == len(full.parent)
    tried = [t.encode() for _, t in texts[::7]] + [b"", "zzz ñandú xyz\x00\x01".encode(), b"abc"]
    want = full.code_lengths(tried)
    for model in (least, some):
        assert np.allclose(model.code_lengths(tried), want, rtol=1e-5, atol=1e-3)
    for text, bits in zip(tried[-2:], want[-2:]):
        b = language.PAD + text
        for k in (0, 11, 29):
            exact = -sum(np.log2(probability(texts, f"l{k:02}", b[i - 3 : i], b[i])) for i in range(3, len(b)))
            assert bits[k] == pytest.approx(exact, rel=1e-4, abs=1e-3)


def test_appended_columns_take_the_place_of_their_names(odd_docs):
    clash = odd_docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1))
    got = language.predict(clash, language.train(odd_docs), append=True)
    assert got.columns == [*odd_docs.columns, "lang_pred", "score", "bits_per_byte"] and got.count() == odd_docs.count()
