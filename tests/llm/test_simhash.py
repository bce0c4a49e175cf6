"""SimHash near-dedup against brute force."""

import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from repsight.llm import simhash
from repsight.llm.graph import components
from repsight.llm.queries import QUERIES

from .conftest import SMALL


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [words[i : i + 4] for i in range(len(words) - 3)] if len(words) >= 4 else [words]
    hs = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(ids, fps, bits):
    f = np.array(fps, dtype=np.uint64)
    root = list(range(len(f)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= bits):
            root[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(f))]


def test_query_equals_brute_force(spark, small_docs):
    docs = small_docs.collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    comp = slow_components([r.doc_id for r in docs], fps, 4)
    want = Counter((r.doc_id, f"{f:016x}", c) for r, f, c in zip(docs, fps, comp))
    got = Counter(tuple(r) for r in QUERIES["op4_simhash_near_dedup"](spark, SMALL).select("doc_id", "fingerprint", "component_id").collect())
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    comp = slow_components([r.doc_id for r in docs], fps, 4)
    clash = odd_docs.withColumn("fp", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("component_id", F.lit(2))
    got = simhash.near_duplicates(clash).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == Counter(
        (r.doc_id, f, c) for r, f, c in zip(docs, fps, comp)
    )
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.deduplicate(no_docs).count() == 0


def test_deduplicate_keeps_one_row_per_component(odd_docs, small_docs):
    for docs in (odd_docs, small_docs):
        rows = docs.collect()
        fps = [slow_fingerprint(r.text) for r in rows]
        groups = len(set(slow_components(list(range(len(rows))), fps, 4)))
        kept = simhash.deduplicate(docs)
        assert kept.columns == docs.columns and kept.count() == groups
    ids = [r.doc_id for r in simhash.deduplicate(odd_docs).collect()]
    assert 6 in ids and None not in ids  # the rows without id are copies of rows with one


def test_dense_keys_are_cut_and_lose_nothing(spark):
    """Many distinct fingerprints within a few bits of each other, compared in tiny cells."""
    rng = random.Random(3)
    fps = {0}
    for centre in (rng.getrandbits(64) for _ in range(4)):
        for _ in range(150):
            f = centre
            for _ in range(rng.randrange(5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for cell in (8, 512):
        links = simhash.links(df, 4, 7, cell)
        roots = {r.node % (1 << 64): r.root for r in components(links).collect()}
        want = slow_components(list(range(len(fps))), fps, 4)
        got = {}
        for f, w in zip(fps, want):
            got.setdefault(w, set()).add(roots.get(f, ("single", f)))
        assert all(len(x) == 1 for x in got.values()) and len({next(iter(x)) for x in got.values()}) == len(got)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]  # 7 has other links, so it stays a node
    pairs += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(1, 0), (-5, -9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


def test_deduplicate_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g h", "x", 7), (2, "a b c d e f g h", "y", 8), (3, "other words stand here in this one", "z", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, given int")
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns and sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]
    assert simhash.deduplicate(docs.limit(0)).count() == 0
