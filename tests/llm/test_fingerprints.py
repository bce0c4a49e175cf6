"""Prefix fingerprints against brute force."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from repsight.llm import fingerprints as fp
from repsight.llm.queries import QUERIES

from .conftest import SMALL


def edited(rows):
    """(doc_id, n, sha256) as the contract says, by sorting everything."""
    order = sorted(
        rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), hashlib.md5((r.text or "").encode()).hexdigest())
    )
    out = []
    for r, following in zip(order, order[1:] + order[:1]):
        text, n = r.text or "", len(r.text or "")
        new = text[: n - n // 2] + (following.text or "")[: n // 2]
        out.append((r.doc_id, n, hashlib.sha256(new.encode()).hexdigest()))
    return Counter(out)


def test_query_equals_brute_force(spark, small_docs):
    got = QUERIES["op3_prefix_fingerprints"](spark, SMALL).collect()
    rows = small_docs.collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == edited(rows)
    texts = {r.doc_id: r.text for r in rows}
    by_text, prints = {}, {r.doc_id: r.fingerprint for r in got}
    order = sorted(prints, reverse=True)
    following = dict(zip(order, order[1:] + order[:1]))
    for r in got:  # near_* follow from the returned columns alone
        assert r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == fp.likeness(r.fingerprint, prints[following[r.doc_id]])
    for r in got:
        assert r.fingerprint == fp.Prefix(fp.codes_of(texts[r.doc_id])).fingerprint()
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert r.n_chars < 2 or 0.3 < r.near_edited <= 1
    assert all(len(x) == 1 for x in by_text.values())
    assert len({f for x in by_text.values() for f in x}) == len(by_text)
    assert sum(r.near_next < 0.1 for r in got) > 0.9 * len(got)


def test_odd_rows(odd_docs, no_docs):
    clash = odd_docs.withColumn("key", F.lit("x")).withColumn("bucket", F.lit(1)).withColumn("fingerprint", F.lit(None))
    for docs in (clash, odd_docs.limit(1), odd_docs.where("doc_id is null")):
        rows = docs.collect()
        got = fp.fingerprint_with_edits(docs).select("doc_id", "n_chars", F.sha2("edited_text", 256)).collect()
        assert Counter(tuple(r) for r in got) == edited(rows)
    assert fp.fingerprint_with_edits(no_docs).count() == 0


def test_span_equality_and_common_extension():
    rng = random.Random(2)
    for _ in range(60):
        a = "".join(rng.choice("ab\U0001f600é") for _ in range(rng.randrange(0, 60)))
        b = a[rng.randrange(0, 5) :] + "".join(rng.choice("ab") for _ in range(10))
        pa, pb = fp.Prefix(fp.codes_of(a)), fp.Prefix(fp.codes_of(b))
        for _ in range(40):
            i, j, n = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1), rng.randrange(20)
            fits = i + n <= len(a) and j + n <= len(b)
            assert pa.equal(i, pb, j, n) == (fits and a[i : i + n] == b[j : j + n])
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            assert pa.common_extension(i, pb, j) == k
        keep = rng.randrange(len(a) + 1)
        joined = fp.Prefix(fp.codes_of(b), pa, keep)
        assert joined.fingerprint() == fp.Prefix(fp.codes_of(a[:keep] + b)).fingerprint()


def test_likeness():
    make = lambda t: fp.Prefix(fp.codes_of(t)).fingerprint()
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    assert fp.likeness(make(text), make(text)) == 1 == fp.likeness(make(""), make(""))
    assert fp.likeness(make(text), make(other)) == 0 == fp.likeness(make(""), make("a"))
    assert fp.likeness(make(text), make(text[:1500] + "X" + text[1501:])) > 0.9  # a letter changed
    assert fp.likeness(make(text), make(text[:1500] + "XYZ " + text[1500:])) > 0.9  # letters put in
    for a, b in ((text, text[:1000]), ("abc", "abd"), (text[:7], text)):
        assert 0 <= fp.likeness(make(a), make(b)) == fp.likeness(make(b), make(a)) <= 1


def test_likeness_of_long_texts_with_many_edits_and_repeats():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(6000)]
    many = list(words)
    for k in sorted(rng.sample(range(len(words)), 50), reverse=True):
        many[k : k + 1] = rng.choice([["edited"], ["put", "in", many[k]], []])
    lines = ["the same line again and again, to the very end of the text\n"] * 300
    for text, other in (
        (" ".join(words), " ".join(many)),
        ("".join(lines), "word " + "".join(lines)),
        ("".join(lines), "".join(lines[:150]) + "word " + "".join(lines[150:])),
        ("abc" * 3000, "x" + "abc" * 3000),
        ("a" * 5000, "a" * 2000 + "b" + "a" * 3000),
    ):
        a, b = fp.Prefix(fp.codes_of(text)), fp.Prefix(fp.codes_of(other))
        assert 0.97 < a.alike(b) <= 1 and 0.97 < b.alike(a) <= 1
        assert fp.likeness(a.fingerprint(), b.fingerprint()) > 0.75
    short, long = fp.Prefix(fp.codes_of("abc" * 500)), fp.Prefix(fp.codes_of("x" + "abc" * 1000))
    assert fp.likeness(short.fingerprint(), long.fingerprint()) > 0.4 and short.alike(long) > 0.45


def test_cuts_are_the_least_hashes_around_them():
    rng = random.Random(5)
    for n in (8, 9, 40, 63, 64, 65, 200, 700, 1500, 2500):
        whole = fp.Prefix(fp.codes_of("".join(rng.choice("ab") for _ in range(n))))
        spans = [whole.span(i, i + fp.WINDOW)[0] for i in range(n + 1 - fp.WINDOW)]
        mixed = [(h * 0x9E3779B97F4A7C15 % (1 << 64)) >> 32 for h in spans]
        want = {}
        for i, h in enumerate(mixed):
            for k in range(fp._level(n), fp.LEVEL + 1):
                if h == min(mixed[max(0, i - (1 << k) + 1) : i + (1 << k)]):
                    want[i + fp.WINDOW] = k
                else:
                    break
        at, levels = whole.cuts()
        assert dict(zip(at.tolist(), levels.tolist())) == want


def test_alike_is_exact_on_what_stays():
    make = lambda t: fp.Prefix(fp.codes_of(t))
    rng = random.Random(6)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    assert make(text).alike(make(text)) == 1 == make("").alike(make(""))
    assert make("").alike(make("a")) == 0
    assert make(text).alike(make(text[:2500] + "X" + text[2501:])) == 4999 / 5000
    assert make(text).alike(make(text[:2500] + "XYZ" + text[2500:])) == 5000 / 5003
    assert make(text).alike(make(text[2500:] + text[:2500])) > 0.97  # halves changed about
