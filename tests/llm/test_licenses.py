"""License scan against a plain version in Python."""

import re
from collections import Counter

from pyspark.sql import functions as F

from repsight.llm import licenses
from repsight.llm.queries import QUERIES

from .conftest import LONG, SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = [(n, label, prio, keyword, re.compile(regex), score) for n, label, prio, keyword, regex, score in licenses.rules()]


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = []
    for phrase, label in licenses.BASE.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    norm = " " + " ".join(words) + " "
    found = []
    for n, label, prio, keyword, regex, score in RULES:
        if keyword in norm:
            for m in regex.finditer(norm):
                start = norm[: m.start()].count(" ") - 1
                found.append((start, start + len(m[0].split()), prio, n, label, score))
    kept = [
        d for d in found
        if not any(
            e is not d and e[0] <= d[0] and d[1] <= e[1] and e[2] <= d[2] and (e[:2] != d[:2] or (e[2], e[3]) < (d[2], d[3]))
            for e in found
        )
    ]
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(d[4] for d in kept)})
    score = max([1.0 if places else 0.0, *(d[5] for d in kept)])
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(labels), score, sorted(kept)


def result(df):
    return Counter(
        (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score,
         tuple(sorted((d.start, d.end, d.priority, d.rule, d.label, d.score) for d in r.detections)))
        for r in df.collect()
    )


def expected(rows):
    return Counter((r.doc_id, *plain(r.text)[:7], tuple(plain(r.text)[7])) for r in rows)


def test_query_equals_plain_version(spark, small_docs):
    got = QUERIES["op1_license_scan"](spark, SMALL)
    want = Counter((r.doc_id, *plain(r.text)[:7]) for r in small_docs.collect())
    assert Counter(tuple(r) for r in got.collect()) == want
    assert any(k[2] for k in want)


def test_rules_and_suppression(spark):
    texts = [
        "Released under the MIT License under the MIT license. under the MIT license",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: GPL-3.0-or-later AND CC-BY-NC-SA-4.0", "cc by nc cc by nc sa cc-by", "CC BY-NC 4.0",
        "This work is licensed under the GNU General Public License, version 3.", "a mitten license, omit licensed",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "available under the terms of the GNU Lesser General Public License v2.1, Creative Commons Attribution-ShareAlike 4.0 International License",
        "ſpdx licenſe K under the mİt license", "mit license " * 500, LONG + " under the MIT license " + LONG,
        "é under the mit licenseé", "all rights reserved " * 3,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert result(licenses.scan(df)) == expected(df.collect())
    first = licenses.scan(df.where("doc_id = 0")).first()
    assert (first.n_base, first.first_word, first.last_word, first.labels) == (3, 1, 9, "mit")


def test_odd_rows(odd_docs, no_docs):
    clash = odd_docs.withColumn("norm", F.lit("x")).withColumn("detections", F.lit(1)).withColumn("score", F.lit(None))
    assert result(licenses.scan(clash)) == expected(odd_docs.collect())
    assert licenses.scan(no_docs).count() == 0


def test_rules_are_hundreds_and_gated():
    rules = licenses.rules()
    assert len(rules) > 200 and len({r[4] for r in rules}) > 200
    for _, _, _, keyword, _, _ in rules:
        assert re.fullmatch(r"[a-z0-9 ]+", keyword)


def test_plan_is_native(spark):
    plan = QUERIES["op1_license_scan"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def alternatives(tokens):
    """Strings that a parsed regex matches: every branch, every option with and without."""
    out = [""]
    for op, value in tokens:
        name = str(op)
        if name == "LITERAL":
            found = [chr(value)]
        elif name == "BRANCH":
            found = [x for branch in value[1] for x in alternatives(branch)]
        elif name == "SUBPATTERN":
            found = alternatives(value[-1])
        elif name == "MAX_REPEAT":
            least, most, inner = value
            found = ([""] if least == 0 else []) + (alternatives(inner) if most else [])
        elif name == "IN":
            found = [chr(v) if str(k) == "LITERAL" else "x" for k, v in value]
        elif name == "ASSERT":
            found = [""]
        else:
            raise AssertionError(name)
        out = [a + b for a in out for b in found]
    return out


def test_prefilters_change_no_result(spark):
    from re import _parser

    texts = []
    for label, keyword, regex in licenses.NAMES + licenses.SENTENCES:
        for text in alternatives(_parser.parse(regex)):
            assert re.fullmatch(regex, text) and keyword in text, (label, text)
            assert any(stem in f" {text} " for stem in licenses.STEMS), (label, text)
            texts.append((text, label))
    for regex, label in licenses.IDENTIFIERS:
        texts += [("spdx license identifier " + x, label) for x in alternatives(_parser.parse(regex))]
    for alone in ("x11 license", "expat license", "psf license", "agpl version 3", "open data commons database license",
                  "do what the fuck you want to public license"):
        assert alone in {t for t, _ in texts}
    some = [x for x in texts if "  " not in x[0]][::17] + [
        ("Released under the Expat License.", "mit"), ("the X11 license", "mit"), ("PSF License", "python-2"),
        ("AGPL version 3", "agpl-3"), ("Do What The Fuck You Want To Public License", "wtfpl"),
        ("you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
        ("Open Data Commons Database License", "odbl-1"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(some)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    everywhere = [(n, label, prio, re.compile(regex)) for n, label, prio, _, regex, _ in licenses.rules()]
    for i, (text, label) in enumerate(some):
        norm = " " + " ".join(WORD.findall(text.lower())) + " "
        assert bool(got[i].detections) == any(regex.search(norm) for *_, regex in everywhere)
        assert got[i].labels, text
    for i in range(len(some) - 7, len(some)):
        assert some[i][1] in got[i].labels.split(",")


def test_labels_of_versions_and_expressions(spark):
    """Labels set by hand."""
    want = {
        "GNU Lesser General Public License version 2": "lgpl-2", "GNU Lesser General Public License v2 or later": "lgpl-2",
        "GNU Lesser General Public License, version 2.0": "lgpl-2", "GNU Lesser General Public License, version 2.1": "lgpl-2.1",
        "GNU Lesser General Public License, version 3": "lgpl-3", "the GNU Lesser General Public License": "lgpl",
        "GNU Library General Public License version 2.1": "lgpl-2.1", "GNU Library General Public License, version 2": "lgpl-2",
        "GNU Affero General Public License version 1": "agpl-1", "GNU Affero General Public License v3.0": "agpl-3",
        "GNU Affero General Public License": "agpl", "LGPL v2": "lgpl-2", "GNU LGPLv2.1": "lgpl-2.1",
        "GNU General Public License, version 2": "gpl-2", "GNU General Public License v3": "gpl-3",
        "European Union Public License 1.1": "eupl-1.1", "European Union Public Licence v1.2": "eupl-1.2",
        "European Union Public Licence": "eupl", "Common Development and Distribution License": "cddl",
        "Common Development and Distribution License 1.1": "cddl-1", "Boost Software License": "boost",
        "Boost Software License 1.0": "boost-1", "SIL Open Font License": "ofl", "SIL Open Font License, Version 1.1": "ofl-1.1",
        "Server Side Public License v1": "sspl-1", "Business Source License": "bsl", "Eclipse Public License": "epl",
        "SPDX-License-Identifier: Apache-2.0 OR MIT": "apache-2,mit",
        "SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR (MIT AND BSD-3-Clause)": "bsd-3,gpl-2,mit",
        "SPDX-License-Identifier: LGPL-2.1-only OR MPL-2.0 OR ISC": "isc,lgpl-2.1,mpl-2",
        "SPDX-License-Identifier: MIT\nthis and isc or that": "mit",
    }
    df = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    assert {t: got[i] for i, t in enumerate(want)} == want
