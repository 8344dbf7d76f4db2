import re

import pytest

from creditloom.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RULES = licenses.rules()


def by_hand(text):
    """Every rule over every text, every detection against every other."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    base, labels = [], set()
    for phrase, label in licenses.BASE.items():
        own = phrase.split()
        places = [i for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        base += places
        labels |= {label} if places else set()
    line, found = " " + " ".join(words) + " ", []
    for k, r in enumerate(RULES):
        for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", line):
            first = line[: m.start()].count(" ") - 1
            found.append((first, first + m.group().count(" "), r, k))
    kept = [
        (a, b, r)
        for a, b, r, k in found
        if not any(
            c <= a and b <= d and s.priority >= r.priority and (s.priority > r.priority or d - c > b - a or j < k)
            for c, d, s, j in found
            if (c, d, j) != (a, b, k)
        )
    ]
    score = max([0.0, *(r.weight for *_, r in kept), *([0.9] if base else [])])
    both = labels | {r.label for *_, r in kept}
    return (
        len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(sorted(both)), score,
    )


TEXTS = [
    "Under the MIT License, under the mit-license! UNDER THE MIT LICENSE", "cc by nc cc by nc; CC-BY-NC-SA 4.0",
    "Licensed under the Apache License, Version 2.0.", "apache license version 21", "apache license version 2",
    "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-2.0-or-later\n" * 3,
    "under the mit licensee", "xunder the mit license", "All rights reserved. Licensed under CC BY-NC 4.0 all rights reserved",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of", "éapache license version 2",
    "licensed under the BSD 3-Clause license; Mozilla Public License v. 2.0; LGPL-2.1; public domain", "GNU GPL v3 or later",
    "the gnu lesser general public license version 2.1 or any later version", "K mit license", "cc0 1.0 creative commons zero",
    "spdx license identifier mit " * 200, "proprietary and confidential", "Creative Commons Attribution-ShareAlike 4.0 International",
]
NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_there_are_hundreds_of_rules():
    assert 300 < len(RULES) < 1000
    assert all(re.compile(r.pattern) for r in RULES)


@pytest.mark.parametrize("which", ["texts", "odd", "table"])
def test_equals_plain_version(spark, odd_documents, which):
    if which == "texts":
        docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    elif which == "odd":
        docs = odd_documents
    else:
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = licenses.scan(docs)
    assert "Python" not in found._jdf.queryExecution().toString()
    rows = docs.select("doc_id", "text").collect()
    gated = [(r.doc_id, *by_hand(r.text)) for r in rows]
    assert sorted(tuple(r[n] for n in ["doc_id", *NAMES]) for r in found.collect()) == sorted(gated)


def test_keywords_gate_nothing_that_a_rule_would_find():
    examples = {"licen[cs]e": "license", "general public": "general public"}
    for r in RULES:
        plain = r.pattern
        for a, b in examples.items():
            plain = plain.replace(a, b)
        head = r.keyword.split()[0]
        assert head in plain.replace("(?:", " ").replace(")", " ") or head[:5] in plain, r


def test_empty_table(no_documents):
    assert licenses.scan(no_documents).count() == 0
