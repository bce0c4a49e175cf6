"""Packing: an exact round trip against the tokenizer itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repsight.llm import packing
from repsight.llm.queries import QUERIES

from .conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    own = Tokenizer.from_file(PATH)
    return np.array([*own.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(pieces, texts):
    """Pieces of one text each (by doc_id) cover its ids once; sequences are gapless and not too long."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(docs) == set(texts)
    for d, own in docs.items():
        ids, at = ids_of(texts[d]), 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(p.length for p in pieces) / (2048 * len(sequences))


def test_query_round_trip(spark, small_docs):
    pieces = QUERIES["op7_karmarkar_karp_packing"](spark, SMALL).collect()
    assert check(pieces, {r.doc_id: r.text for r in small_docs.collect()}) > 0.97


def test_odd_rows(odd_docs, no_docs):
    named = odd_docs.withColumn("doc_id", F.monotonically_increasing_id()).withColumn("ids", F.lit(1)).withColumn("offset", F.lit("x"))
    pieces = packing.pack(named, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(pieces, {r.doc_id: r.text for r in named.collect()})
    assert packing.pack(no_docs, PATH).count() == 0
    whole = packing.pack(odd_docs, PATH)  # null and repeated ids pack as any other row
    assert whole.agg(F.sum("length")).first()[0] == sum(p.length for p in pieces)


def test_encoder_equals_tokenizer():
    encode = packing.Encoder(PATH, words=50)
    texts = [
        "a\x1fb c", "Σας ΣΑΣ ǅ", "é x", "it's don't 'S x'll", "<|endoftext|> hi<|endoftext|>the <|ENDOFTEXT|>",
        "İstanbul İ", "a\xa0b　c \x85d", "漢字123 ½ ²", "ŉ ſ K Å", "́ a", " ", "", "a_b __ x-y", "Éaux ãõ ÿ ẞ ß",
        "THERTI!! A,!! thoner$$$ | x", *(" ".join(f"w{i}x{j}" for j in range(200)) for i in range(5)),
    ]
    for t in texts:
        assert encode(t) == ids_of(t)[:-1].tobytes(), t


def test_runs_are_tokenized_once():
    """A run of letters is known behind other marks, and when the cache of words was emptied."""
    encode = packing.Encoder(PATH, words=10)
    model, seen = encode.model, []

    class Counted:
        def tokenize(self, piece):
            seen.append(piece)
            return model.tokenize(piece)

    encode.model = Counted()
    texts = ["alpha, beta; gamma.", "Alpha. BETA! gamma?", "alpha: Beta, Gamma!", "ALPHA beta gamma;", "alpha, Beta; Gamma."]
    for t in texts:
        assert encode(t) == ids_of(t)[:-1].tobytes(), t
    assert sorted(seen) == sorted(set(seen))


def test_differencing():
    rng = random.Random(1)
    for n, k in ((0, 3), (1, 1), (2, 5), (7, 3), (200, 20), (300, 7), (64, 64)):
        sizes = [rng.randrange(1, 600) for _ in range(n)]
        windows = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(n)) and len(windows) <= k
    sizes = [rng.randrange(1, 513) for _ in range(800)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 100)]
    assert max(sums) - min(sums) <= 30
    for w in packing.windows_for([512] * 9 + [1], 2048):
        assert sum(512 if i < 9 else 1 for i in w) <= 2048


def test_rests_of_many_splits_are_packed_together(small_docs):
    docs = small_docs.select("doc_id", "text").unionByName(small_docs.selectExpr("doc_id + 1000000", "text").toDF("doc_id", "text"))
    counts = {}
    for splits in (1, 40):
        rows = packing.pack(docs.repartition(splits), PATH).collect()
        counts[splits] = len({r.sequence_id for r in rows})
        sizes = {}
        for r in rows:
            sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
        assert max(sizes.values()) <= 2048
        assert sorted((r.doc_id, r.start, bytes(r.ids)) for r in rows) == counts.setdefault(
            "rows", sorted((r.doc_id, r.start, bytes(r.ids)) for r in rows)
        )
    assert counts[40] <= counts[1] * 1.02 + 1
