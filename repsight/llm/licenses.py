"""License detection by ordered signature rules, with DataFrame functions only.

A text becomes its lower-case words, joined by one blank, with a blank at
either end.  Every rule is a hand-written signature over such words, gated by
a keyword that each of its matches contains: its regex runs only where the text
contains the keyword, and no rule at all where a text contains none of the stems
that every match contains one of.

Rules have a priority: 0 for identifiers and grants that name the license,
1 for license texts' own sentences, 2 for a bare name.  Overlaps are resolved
by containment: a detection is suppressed if it lies within another one of
the same or a higher priority; of equal intervals the earlier rule stays.
What remains can overlap only partly, or hold a better one inside.

Base places, where the words of a fixed phrase stand in a row, are counted
beside the rules and are never suppressed.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repsight.llm.common import fold_sql

# Phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# (label, keyword, the license's name as a regex over normalised words), from the most to the least specific of a family
NAMES = [
    ("agpl-3", "affero", r"(gnu )?affero general public license( gpl| agpl)?( v| version)? ?3( 0)?"),
    ("agpl-3", "agpl", r"agpl( v| version)? ?3( 0)?"),
    ("agpl-1", "affero", r"(gnu )?affero general public license( gpl| agpl)?( v| version)? ?1( 0)?"),
    ("agpl-1", "agpl", r"agpl( v| version)? ?1( 0)?"),
    ("agpl", "affero", r"(gnu )?affero general public license( gpl| agpl)?( v| version)? ?2( 0)?"),
    ("agpl", "affero", r"(gnu )?affero (general public )?license"),
    ("lgpl-3", "lesser", r"(gnu )?lesser general public license( lgpl)?( v| version)? ?3( 0)?"),
    ("lgpl-2.1", "lesser", r"(gnu )?lesser general public license( lgpl)?( v| version)? ?2 1"),
    ("lgpl-2", "lesser", r"(gnu )?lesser general public license( lgpl)?( v| version)? ?2( 0)?"),
    ("lgpl", "lesser", r"(gnu )?lesser general public license( lgpl)?( v| version)? ?1( 0)?"),
    ("lgpl-3", "library general", r"(gnu )?library general public license( lgpl)?( v| version)? ?3( 0)?"),
    ("lgpl-2.1", "library general", r"(gnu )?library general public license( lgpl)?( v| version)? ?2 1"),
    ("lgpl-2", "library general", r"(gnu )?library general public license( lgpl)?( v| version)? ?2( 0)?"),
    ("lgpl", "library general", r"(gnu )?library general public license( lgpl)?( v| version)? ?1( 0)?"),
    ("lgpl", "library general", r"(gnu )?library general public license"),
    ("lgpl", "lesser", r"(gnu )?lesser general public license"),
    ("gpl-3", "general public", r"(gnu )?general public license( gpl)?( v| version)? ?3( 0)?"),
    ("gpl-2", "general public", r"(gnu )?general public license( gpl)?( v| version)? ?2( 0)?"),
    ("gpl-1", "general public", r"(gnu )?general public license( gpl)?( v| version)? ?1( 0)?"),
    ("gpl", "general public", r"gnu general public license"),
    ("gpl-3", "gpl", r"(gnu )?gpl ?v?3( 0)?"),
    ("gpl-2", "gpl", r"(gnu )?gpl ?v?2( 0)?"),
    ("lgpl-3", "lgpl", r"(gnu )?lgpl ?v?3( 0)?"),
    ("lgpl-2.1", "lgpl", r"(gnu )?lgpl ?v?2 1"),
    ("lgpl-2", "lgpl", r"(gnu )?lgpl ?v?2( 0)?"),
    ("agpl-3", "agpl", r"(gnu )?agpl ?v?3( 0)?"),
    ("gfdl", "free documentation", r"(gnu )?free documentation license( gfdl)?( (v|version) ?1 [123])?"),
    ("apache-2", "apache", r"apache (software )?license( v| version)? ?2( 0)?"),
    ("apache-1.1", "apache", r"apache (software )?license( v| version)? ?1 1"),
    ("apache", "apache", r"apache (software )?license"),
    ("mit", "mit", r"mit( x11)? license"),
    ("mit", "x11", r"x11 license"),
    ("mit", "expat", r"expat license"),
    ("mit-0", "mit", r"mit no attribution license|mit 0 license"),
    ("bsd-4", "bsd", r"(original|4 clause|four clause) bsd license|bsd 4 clause( original)?( license)?"),
    ("bsd-3", "bsd", r"(new|revised|modified|3 clause|three clause) bsd license|bsd 3 clause( new| revised)?( license)?"),
    ("bsd-2", "bsd", r"(simplified|freebsd|2 clause|two clause) bsd license|bsd 2 clause( simplified)?( license)?"),
    ("0bsd", "bsd", r"zero clause bsd license|0bsd( license)?|bsd zero clause license"),
    ("bsd", "bsd", r"bsd( style)? license"),
    ("isc", "isc", r"isc license"),
    ("mpl-2", "mozilla", r"mozilla public license( mpl)?( v| version)? ?2( 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license( mpl)?( v| version)? ?1 1"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-2", "eclipse", r"eclipse public license( epl)?( v| version)? ?2( 0)?"),
    ("epl-1", "eclipse", r"eclipse public license( epl)?( v| version)? ?1( 0)?"),
    ("epl", "eclipse", r"eclipse public license"),
    ("cddl-1", "common development", r"common development and distribution license( cddl)?( v| version)? ?1( [01])?"),
    ("cddl", "common development", r"common development and distribution license"),
    ("eupl-1.2", "european union", r"european union public licen[cs]e( eupl)?( v| version)? ?1 2"),
    ("eupl-1.1", "european union", r"european union public licen[cs]e( eupl)?( v| version)? ?1 1"),
    ("eupl-1", "european union", r"european union public licen[cs]e( eupl)?( v| version)? ?1( 0)?"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("artistic-2", "artistic", r"artistic license( v| version)? ?2( 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("zlib", "zlib", r"zlib( libpng)? license"),
    ("boost-1", "boost", r"boost software license( v| version)? ?1( 0)?"),
    ("boost", "boost", r"boost software license"),
    ("unlicense", "unlicense", r"(the )?unlicense( license)?"),
    ("wtfpl", "wtfpl", r"wtfpl( (v|version) ?2)?"),
    ("wtfpl", "do what the", r"do what the fuck you want to public license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("python-2", "python", r"python software foundation license( v| version)? ?2( 0)?"),
    ("python", "python", r"python software foundation license"),
    ("python-2", "psf", r"psf license"),
    ("ofl-1.1", "open font", r"(sil )?open font license( ofl)?( v| version)? ?1 1"),
    ("ofl-1", "open font", r"(sil )?open font license( ofl)?( v| version)? ?1( 0)?"),
    ("ofl", "open font", r"(sil )?open font license"),
    ("odbl-1", "database license", r"open (data commons )?(open )?database license( odbl)?( v?1( 0)?)?"),
    ("odc-by-1", "data commons", r"open data commons attribution license( v| version)? ?1( 0)?"),
    ("odc-by", "data commons", r"open data commons attribution license"),
    ("ms-pl", "microsoft", r"microsoft public license( ms pl)?"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license( ms rl)?"),
    ("afl-3", "academic free", r"academic free license( v| version)? ?3( 0)?"),
    ("afl", "academic free", r"academic free license"),
    ("osl-3", "open software", r"open software license( v| version)? ?3( 0)?"),
    ("osl", "open software", r"open software license"),
    ("ecl-2", "educational community", r"educational community license( v| version)? ?2( 0)?"),
    ("ecl", "educational community", r"educational community license"),
    ("ncsa", "ncsa", r"(university of illinois )?ncsa open source license"),
    ("bsl-1.1", "business source", r"business source license( v| version)? ?1 1"),
    ("bsl", "business source", r"business source license"),
    ("sspl-1", "server side", r"server side public license( v| version)? ?1( 0)?"),
    ("sspl", "server side", r"server side public license"),
    ("openrail", "openrail", r"(creativeml |bigscience |bigcode )?openrail( m| s)?( license)?"),
    ("llama", "llama", r"llama [234]?( [123])? ?community license( agreement)?"),
    ("cc0-1", "cc0", r"cc0( 1 0)?( universal)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd( [1234] [05])?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa( [1234] [05])?"),
    ("cc-by-nc", "cc by", r"cc by nc( [1234] [05])?"),
    ("cc-by-nd", "cc by", r"cc by nd( [1234] [05])?"),
    ("cc-by-sa", "cc by", r"cc by sa( [1234] [05])?"),
    ("cc-by", "cc by", r"cc by( [1234] [05])?"),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(ative)?s( works)?( [1234] [05])?( international| unported)?( license)?"),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike( [1234] [05])?( international| unported)?( license)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial( [1234] [05])?( international| unported)?( license)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(ative)?s( works)?( [1234] [05])?( international| unported)?( license)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike( [1234] [05])?( international| unported)?( license)?"),
    ("cc-by", "creative commons", r"creative commons attribution( [1234] [05])?( international| unported)?( license)?"),
    ("cc0-1", "creative commons", r"creative commons (cc0|zero)( 1 0)?( universal)?( license)?( public domain dedication)?"),
    ("cc", "creative commons", r"creative commons license"),
]

# (identifier as it stands after normalising, label)
IDENTIFIERS = [
    ("mit", "mit"), ("mit 0", "mit-0"), ("agpl 1 0( only| or later)?", "agpl-1"), ("eupl 1 1", "eupl-1.1"), ("apache 2 0", "apache-2"), ("apache 1 1", "apache-1.1"),
    ("bsd 2 clause", "bsd-2"), ("bsd 3 clause", "bsd-3"), ("bsd 4 clause", "bsd-4"), ("0bsd", "0bsd"), ("isc", "isc"),
    ("gpl 1 0( only| or later)?", "gpl-1"), ("gpl 2 0( only| or later)?", "gpl-2"), ("gpl 3 0( only| or later)?", "gpl-3"),
    ("lgpl 2 0( only| or later)?", "lgpl-2"), ("lgpl 2 1( only| or later)?", "lgpl-2.1"),
    ("lgpl 3 0( only| or later)?", "lgpl-3"), ("agpl 3 0( only| or later)?", "agpl-3"), ("mpl 1 1", "mpl-1.1"),
    ("mpl 2 0", "mpl-2"), ("epl 1 0", "epl-1"), ("epl 2 0", "epl-2"), ("cddl 1 [01]", "cddl-1"), ("eupl 1 2", "eupl-1.2"),
    ("artistic 2 0", "artistic-2"), ("zlib", "zlib"), ("bsl 1 0", "boost-1"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
    ("postgresql", "postgresql"), ("psf 2 0|python 2 0", "python-2"), ("ofl 1 1", "ofl-1.1"), ("odbl 1 0", "odbl-1"),
    ("ms pl", "ms-pl"), ("ms rl", "ms-rl"), ("afl 3 0", "afl-3"), ("osl 3 0", "osl-3"), ("ecl 2 0", "ecl-2"),
    ("ncsa", "ncsa"), ("busl 1 1", "bsl-1.1"), ("sspl 1 0", "sspl-1"), ("cc0 1 0", "cc0-1"), ("cc by [1234] [05]", "cc-by"),
    ("cc by nc [1234] [05]", "cc-by-nc"), ("cc by nc nd [1234] [05]", "cc-by-nc-nd"),
    ("cc by nc sa [1234] [05]", "cc-by-nc-sa"), ("cc by nd [1234] [05]", "cc-by-nd"), ("cc by sa [1234] [05]", "cc-by-sa"),
]

# (label, keyword, a sentence of the license's own text or notice)
SENTENCES = [
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "substantial portions", r"shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "neither the name", r"neither the name of (\S+ ){1,12}nor the names of (its|the) contributors may be used to endorse"),
    ("bsd-4", "advertising materials", r"all advertising materials mentioning features or use of this software must display"),
    ("apache-2", "apache org", r"www apache org licenses license 2 0"),
    ("apache-2", "except in compliance", r"you may not use this file except in compliance with the license"),
    ("gpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("agpl", "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "gnu org", r"www gnu org licenses gpl( [123] 0)?"),
    ("lgpl", "gnu org", r"www gnu org licenses lgpl( [23] [01])?"),
    ("agpl", "gnu org", r"www gnu org licenses agpl( 3 0)?"),
    ("mpl-2", "mozilla org", r"mozilla org mpl 2 0"),
    ("boost-1", "boost org", r"www boost org license 1 0"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", r"(released|placed|dedicated) (in|into|to) the public domain"),
    ("public-domain", "public domain", r"(is|are) in the public domain"),
    ("zlib", "as is", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by( [1234] [05])?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa( [1234] [05])?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc( [1234] [05])?"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd( [1234] [05])?"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa( [1234] [05])?"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd( [1234] [05])?"),
    ("cc0-1", "creativecommons", r"creativecommons org publicdomain zero( 1 0)?"),
    ("proprietary", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(proprietary and confidential|confidential and proprietary)"),
]

_GRANT = (
    r"(licensed|released|distributed|available|published|shared|provided|covered)( to you)? under (the )?"
    r"(terms (and conditions )?of (the )?)?"
)
#: Stems of all keywords; a text without any of them has no detection.
STEMS = (
    "licen", "gpl", "cc by", "cc0", "spdx", "commons", "public domain", "openrail", "wtfpl", "bsd", "hereby granted",
    "redistribut", "substantial portions", "permission to use", "neither the name", "advertising materials",
    "apache org", "gnu org", "mozilla org", "boost org", "provided as is", "rights reserved", "proprietary",
    "except in compliance",
)


def _spelled(regex: str) -> list[str]:
    """The identifiers that a regex of ``IDENTIFIERS`` stands for."""
    out = [""]
    for token in re.findall(r"\[(\d+)\]|\(([^)]*)\)\?|([^[(]+)", regex):
        choices = list(token[0]) or (["", *token[1].split("|")] if token[1] else token[2].split("|"))
        out = [a + b for a in out for b in choices]
    return out


#: What stands before the operator of an expression; each alternative has a fixed length, as lookbehinds need.
_AFTER = "|".join(
    f"(?<= {x} )" for x in [*(x for r, _ in IDENTIFIERS for x in _spelled(r)), "exception", "exception 2 0", "exception 3 1"]
)


def rules() -> list[tuple[int, str, int, str, str, float]]:
    """(number, label, priority, keyword, regex, score) in order of the rules."""
    found = []

    def add(label: str, priority: int, keyword: str, regex: str, score: float) -> None:
        found.append((len(found), label, priority, keyword, f"(?<= )(?:{regex})(?= )", score))

    for regex, label in IDENTIFIERS:
        add(label, 0, "spdx license identifier", f"spdx license identifier (?:{regex})", 1.0)
    for regex, label in IDENTIFIERS:  # the further ones of an expression, each behind another identifier or an exception
        add(label, 0, "spdx license identifier", f"(?=(?:or|and) )(?:{_AFTER})(?:or|and) (?:{regex})", 1.0)
    for label, keyword, name in NAMES:
        add(label, 0, keyword, f"{_GRANT}(?:{name})", 0.95)
    for label, keyword, sentence in SENTENCES:
        add(label, 1, keyword, sentence, 0.9)
    for label, keyword, name in NAMES:
        add(label, 2, keyword, name, 0.6)
    return found


def normalised(text: Column) -> Column:
    """Lower-case words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, one blank between and at both ends; null: no word.

    All letters are lower-cased, which is quicker than A-Z alone: it moves no
    word's limits, and no other letter becomes one that a phrase has.
    """
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _literal(values: list[tuple[int, str, int, str, str, float]]) -> Column:
    names = ("rule", "label", "priority", "keyword", "regex", "score")
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r))) for r in values))


_DETECTION = "array<struct<start:int,end:int,priority:int,rule:int,label:string,score:double>>"
_NONE = f"cast(array() AS {_DETECTION})"


def _words(part: str) -> str:
    return f"length({part}) - length(replace({part}, ' ', ''))"


# Places of one rule in ``norm``: the words between and in its matches are counted up along the text.
_PLACES = fold_sql(
    "arrays_zip(split(norm, r.regex, -1), regexp_extract_all(norm, r.regex, 0))", _DETECTION,
    f"named_struct('at', acc.st.at + {_words("x['0']")} + coalesce({_words("x['1']")}, 0))",
    f"""CASE WHEN x['1'] IS NULL THEN {_NONE} ELSE array(named_struct(
      'start', acc.st.at + {_words("x['0']")} - 1, 'end', acc.st.at + {_words("x['0']")} + {_words("x['1']")},
      'priority', r.priority, 'rule', r.rule, 'label', r.label, 'score', r.score)) END""",
    "named_struct('at', 0)",
)

# Along the detections by start, longest first, then priority and rule: every one that could hold another comes before it.
_KEPT = fold_sql(
    """array_sort(detections, (a, b) -> CASE
    WHEN a.start != b.start THEN a.start - b.start WHEN a.end != b.end THEN b.end - a.end
    WHEN a.priority != b.priority THEN a.priority - b.priority ELSE a.rule - b.rule END)""",
    _DETECTION,
    """named_struct('e0', CASE WHEN x.priority = 0 THEN greatest(acc.st.e0, x.end) ELSE acc.st.e0 END,
    'e1', CASE WHEN x.priority <= 1 THEN greatest(acc.st.e1, x.end) ELSE acc.st.e1 END, 'e2', greatest(acc.st.e2, x.end))""",
    f"CASE WHEN x.end <= CASE x.priority WHEN 0 THEN acc.st.e0 WHEN 1 THEN acc.st.e1 ELSE acc.st.e2 END THEN {_NONE} ELSE array(x) END",
    "named_struct('e0', -1, 'e1', -1, 'e2', -1)",
)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored).

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    and detections: the detections that stay, as (start, end, priority, rule,
    label, score) in words from 0, end exclusive.  A null text counts as
    empty; a text without a match has empty labels, score 0 and null places.
    Repeated rows come back repeated, an empty table gives no row.  The plan is
    one projection over the input, without exchange; a text's work is linear in
    its length and grows with the number n of its detections as n^1.5.
    """
    norm = docs.select(F.col("doc_id").cast("long"), normalised(F.col("text").cast("string")).alias("norm"))
    blank = F.col("norm") == "  "
    gate = reduce(or_, (F.col("norm").contains(stem) for stem in STEMS))
    n_words = F.when(blank, 0).otherwise(_blanks(F.col("norm")) - 1)
    # the words before the first and after the last place; places of one phrase share at most their blanks
    has = {p: F.col("norm").contains(f" {p} ") for p in BASE}
    counts = {p: F.when(has[p], F.regexp_count("norm", F.lit(f"(?<= ){p}(?= )"))).otherwise(0) for p in BASE}
    first = [F.when(has[p], _blanks(F.substring_index("norm", f" {p} ", 1))) for p in BASE]
    last = [
        F.when(has[p], _blanks(F.col("norm")) - _blanks(F.substring_index("norm", f" {p} ", -1)) - 1 - len(p.split()))
        for p in BASE
    ]
    base = F.array_compact(F.array(*(F.when(has[p], F.lit(label)) for p, label in BASE.items())))
    tried = F.when(gate, F.filter(_literal(rules()), lambda r: F.contains(F.col("norm"), r["keyword"])))
    found = norm.select(
        "doc_id", "norm", n_words.cast("long").alias("n_words"), sum(counts.values()).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        base.alias("base"), tried.alias("tried"),
    )
    found = found.withColumn(
        "detections", F.expr(f"CASE WHEN size(tried) > 0 THEN flatten(transform(tried, r -> {_PLACES})) END")
    ).drop("norm", "tried")
    found = found.withColumn("detections", F.expr(f"CASE WHEN size(detections) > 0 THEN {_KEPT} ELSE array() END"))
    labels = F.array_sort(F.array_union("base", F.transform("detections", lambda d: d["label"])))
    best = F.greatest(
        F.when(F.col("n_base") > 0, 1.0).otherwise(0.0),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["score"])), F.lit(0.0)),
    )
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        best.alias("score"), "detections",
    )
