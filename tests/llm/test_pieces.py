"""Piece sampling: lossless, reproducible, and with the exact probabilities of the lattice."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from repsight.llm import pieces
from repsight.llm.queries import QUERIES

from .conftest import SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_query_is_lossless(spark, small_docs):
    texts = {r.doc_id: r.text or "" for r in small_docs.collect()}
    got = QUERIES["op8_sentencepiece_sampling"](spark, SMALL).collect()
    assert len(got) == small_docs.count()
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    again = QUERIES["op8_sentencepiece_sampling"](spark, SMALL).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_hard_texts_come_back():
    own = pieces.Codec(PATH, 1.0, units=20)
    for i, t in enumerate(["", " ", "  a  b ", "\n\n x\n", "▁ a▁b", "\x00<s></s><unk><0x41>", "漢字 \U0001f600 é é",
                           "\t\r\x0b", "x" * 5000, "a " * 300, "<|endoftext|>", "﻿ß"]):
        ids = own.encode(t, i)
        assert own.decode(ids) == t and ids == own.encode(t, i)


def ways(own, unit):
    """Every segmentation of a unit and its weight, by recursion."""
    if not unit:
        return [((), 1.0)]
    out = []
    for n in range(1, len(unit) + 1):
        found = own.weights.get(unit[:n].replace(" ", pieces.BLANK))
        if found:
            out += [((found[0], *ids), w * found[1]) for ids, w in ways(own, unit[n:])]
    return out


def test_samples_follow_the_lattice():
    own = pieces.Codec(PATH, 0.3)
    unit = " the"
    every = ways(own, unit)
    total = sum(w for _, w in every)
    want = {ids: w / total for ids, w in every}
    n = 20_000
    got = Counter(tuple(own.encode(unit, s)) for s in range(n))
    assert set(got) <= set(want) and len(want) > 4
    for ids, p in want.items():
        assert abs(got[ids] / n - p) < 4 * (p / n) ** 0.5 + 1e-3
    assert np.isclose(own.lattice(unit)[-1][0][-1], total)  # the forward sum is that of all segmentations
    for hard in ("\U0001f600" * 39, "\x00" * 39, "a" * 39, "▁" * 39, "=" * 39):  # sums stay within a float's range
        last = own.lattice(hard)[-1][0][-1]
        assert 0 < last < float("inf")


def test_odd_rows(odd_docs, no_docs):
    clash = odd_docs.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    got = Counter((r.doc_id, r.decoded) for r in pieces.encode_and_decode(clash, PATH).collect())
    assert got == Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    rows = pieces.encode_and_decode(odd_docs.where("doc_id = 6"), PATH).collect()
    assert len({bytes(r.ids) for r in rows}) == 2  # repeated rows alike, another text apart
    assert all(np.frombuffer(r.ids, "<u4").size == r.n_pieces for r in rows)
    assert pieces.encode_and_decode(no_docs, PATH).count() == 0


def test_rows_do_not_depend_on_their_neighbours(small_docs):
    texts = [r.text or "" for r in small_docs.orderBy("doc_id").limit(40).collect()] + ["", "▁ \U0001f600\n"]
    whole, small = pieces.Codec(PATH, 1.0), pieces.Codec(PATH, 1.0, units=37)
    want = [whole.encode(t, i) for i, t in enumerate(texts)]
    for own in (whole, small):
        assert [x.tolist() for x in own.encode_rows(texts, range(len(texts)))] == want


def unfiltered():
    """Every piece of the model's file that stands for characters: its id and rank."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    return {sp.id_to_piece(i): (i, -sp.get_score(i)) for i in range(sp.vocab_size()) if not special(i)}


def test_samples_follow_the_lattice_of_the_whole_vocabulary():
    vocabulary, own = unfiltered(), pieces.Codec(PATH, 0.3)
    assert set(own.weights) == set(vocabulary)

    def recursion(text):
        if not text:
            return [((), 1.0)]
        return [
            ((i, *ids), w * (2 + rank) ** -0.3)
            for n in range(1, len(text) + 1)
            for i, rank in [vocabulary.get(text[:n].replace(" ", pieces.BLANK), (None, 0))] if i is not None
            for ids, w in recursion(text[n:])
        ]

    n = 10_000
    for text in ("     a", "x}_{y", " f(__a", "=" * 7):
        every = recursion(text)
        total = sum(w for _, w in every)
        want = {ids: w / total for ids, w in every}
        got = Counter(tuple(own.encode(text, s)) for s in range(n))
        assert set(got) <= set(want)
        for ids, p in want.items():
            assert abs(got[ids] / n - p) < 5 * (p / n) ** 0.5 + 2e-3


def test_pieces_cross_every_place_of_long_runs():
    own, spread = pieces.Codec(PATH, 1.0), Counter()
    for seed in range(200):
        at = 0
        for i in own.encode("=" * 200, seed):
            at += len(own.texts[i])
            spread[at] += 1
    assert max(spread[at] for at in range(39, 200, 39)) < 100  # cut there, every sample had an end of a piece
    assert len(own.bounds("=" * 200)) == 2


def test_long_units_are_segmented_alike_in_blocks():
    texts = ["=" * 3000, "abcdefgh" * 700 + "   x", "a" * 30_000, "漢字 " + "_" * 500 + "\U0001f600" * 60]
    whole = pieces.Codec(PATH, 1.0, long=1 << 20)
    want = [whole.encode(t, i) for i, t in enumerate(texts)]
    assert [whole.decode(ids) for ids in want] == texts
    for long, units in ((50, 40_000), (7, 20), (4096, 100)):
        own = pieces.Codec(PATH, 1.0, units, long)
        assert [x.tolist() for x in own.encode_rows(texts, range(len(texts)))] == want
