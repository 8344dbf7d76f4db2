"""License scans: ordered signature rules over the words of a text, in SQL functions only.

A text's words are joined by single spaces, so that a rule is a regular expression over words. Rules are tried where
their keyword occurs. Detections are intervals of words; one that lies within another of no lower priority is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that are always reported, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

IDENTIFIER, TEXT, NAME = 3, 2, 1  # priorities


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float


#: Versioned licenses: label, full name, short name, keyword of the full name, versions.
VERSIONED = (
    ("gpl", "gnu general public licen[cs]e", "(?:gnu )?gpl", "general public", "1 2 3"),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "(?:gnu )?lgpl", "general public", "2 2.1 3"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "(?:gnu )?agpl", "general public", "1 3"),
    ("gfdl", "gnu free documentation licen[cs]e", "(?:gnu )?g?fdl", "free documentation", "1.1 1.2 1.3"),
    ("apache", "apache (?:software )?licen[cs]e", "apache", "apache", "1 1.1 2"),
    ("mpl", "mozilla public licen[cs]e", "mpl", "mozilla", "1 1.1 2"),
    ("epl", "eclipse public licen[cs]e", "epl", "eclipse", "1 2"),
    ("cpl", "common public licen[cs]e", "cpl", "common public", "1"),
    ("cddl", "common development and distribution licen[cs]e", "cddl", "common development", "1 1.1"),
    ("eupl", "european union public licen[cs]e", "eupl", "european union", "1 1.1 1.2"),
    ("artistic", "artistic licen[cs]e", "artistic", "artistic", "1 2"),
    ("afl", "academic free licen[cs]e", "afl", "academic free", "1.1 1.2 2 2.1 3"),
    ("osl", "open software licen[cs]e", "osl", "open software", "1 1.1 2 2.1 3"),
    ("ofl", "sil open font licen[cs]e", "(?:sil )?ofl", "open font", "1 1.1"),
    ("ecl", "educational community licen[cs]e", "ecl", "educational community", "1 2"),
    ("lppl", "latex project public licen[cs]e", "lppl", "latex project", "1 1.1 1.2 1.3"),
    ("zpl", "zope public licen[cs]e", "zpl", "zope", "1.1 2 2.1"),
    ("apsl", "apple public source licen[cs]e", "apsl", "apple public", "1 1.1 1.2 2"),
    ("npl", "netscape public licen[cs]e", "npl", "netscape", "1 1.1"),
    ("bsl", "boost software licen[cs]e", "bsl", "boost software", "1"),
    ("cecill", "cecill (?:free software )?licen[cs]e", "cecill", "cecill", "1 1.1 2 2.1"),
    ("odbl", "open (?:data commons open )?database licen[cs]e", "odbl", "database licen", "1"),
    ("upl", "universal permissive licen[cs]e", "upl", "universal permissive", "1"),
    ("cc0", "creative commons (?:cc ?0|zero)", "cc ?0", "commons", "1"),
    *(
        (
            "cc-by" + "".join("-" + p for p in parts.split()),
            "creative commons attribution"
            + "".join({"nc": " non ?commercial", "nd": " no ?deriv(?:ative)?s?(?: works)?", "sa": " share ?alike"}[p] for p in parts.split())
            + "(?! non ?commercial| no ?deriv| share ?alike)(?: international| generic| unported)?(?: public)?(?: licen[cs]e)?",
            f"cc by{''.join(' ' + p for p in parts.split())}(?! nc| nd| sa)",
            "commons",
            "1 2 2.5 3 4",
        )
        for parts in ("", "sa", "nd", "nc", "nc sa", "nc nd")
    ),
)

#: Licenses without versions: label, name.
PLAIN = (
    ("mit", "mit"), ("mit-0", "mit (?:no attribution|0)"), ("x11", "x11"), ("isc", "isc"), ("zlib", "zlib"), ("libpng", "libpng"),
    ("bsd-2-clause", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)"),
    ("bsd-3-clause", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd-4-clause", "(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)"), ("0bsd", "(?:0bsd|zero clause bsd)"), ("bsd", "bsd"),
    ("unlicense", "(?:the )?unlicense"), ("wtfpl", "wtfpl"), ("beerware", "beer ?ware"), ("ncsa", "(?:uiuc )?ncsa"),
    ("postgresql", "postgresql"), ("php", "php"), ("python", "(?:python software foundation|psf)"), ("ruby", "ruby"),
    ("openssl", "openssl"), ("curl", "curl"), ("vim", "vim"), ("tcl", "tcl"), ("fair", "fair"), ("ms-pl", "(?:microsoft public|ms pl)"),
    ("ms-rl", "(?:microsoft reciprocal|ms rl)"), ("sleepycat", "sleepycat"), ("ntp", "ntp"), ("w3c", "w3c"), ("hpnd", "hpnd"),
    ("json", "json"), ("unicode", "unicode"), ("icu", "icu"), ("intel", "intel"), ("ibm-pl", "ibm public"), ("jasper", "jasper"),
)

#: Sentences of license texts: label, words, keyword.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors", "neither the name"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising materials"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event", "express or implied"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization", "hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "you want to"),
    ("gpl", "(?:free software )?you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute it"),
    ("public-domain", "(?:is |are )?(?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("proprietary", "all rights reserved", "rights reserved"),
    ("proprietary", "(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("proprietary", "unauthori[sz]ed (?:copying|use|distribution) (?:[^ ]+ ){0,8}(?:is )?strictly prohibited", "strictly prohibited"),
)


def _version(v: str) -> str:
    """As words: 2 or 2 0 for version 2, 2 1 for version 2.1; not the start of a longer number."""
    return r" ".join(v.split(".")) + ("(?: 0)?" if "." not in v else "") + r"(?! \d)"


def rules() -> list[Rule]:
    """All rules in order: for each license its identifier, full names, short names and bare name."""
    out: list[Rule] = []
    said = "(?: as published by the free software foundation)?(?: either)?"
    under = "(?:licen[cs]ed|released|distributed|available|covered|provided|published)(?: under| by)(?: the)?(?: terms of)?(?: the)? "
    # what the bare name's rule may begin with, so that a name with its version holds that rule's interval
    named = "(?:(?:under|licen[cs]e) (?:the )?)?"
    said_by = f"(?:{under}|(?:under|licen[cs]e) )?(?:the )?"
    for label, full, short, keyword, versions in VERSIONED:
        for v in versions.split():
            number = f"{label}-{v}"
            at = _version(v)
            short_key = "cc" if label.startswith("cc") else label.removeprefix("g") if label == "gfdl" else label
            out += [
                Rule(number, f"spdx licen[cs]e identifier {short} {at}(?: only)?", "spdx", IDENTIFIER, 1.0),
                Rule(f"{number}-or-later", f"spdx licen[cs]e identifier {short} {at} or later", "spdx", IDENTIFIER, 1.0),
                Rule(number, f"{said_by}{full}{said}(?: version| v)? {at}", keyword, TEXT, 0.95),
                Rule(f"{number}-or-later", f"{said_by}{full}{said}(?: version| v)? {at}(?: of the licen[cs]e)?(?: or)?(?: at your option)?(?: any)? later(?: version)?", keyword, TEXT, 0.95),
                Rule(number, f"{named}{short}(?: licen[cs]e)?(?: version| v)? ?v?{at}", short_key, NAME, 0.7),
            ]
        out += [
            Rule(label, f"(?:{under})?(?:the )?{full}", keyword, NAME, 0.8),
            Rule(label, f"(?:under|licen[cs]e) (?:the )?{short}(?: licen[cs]e)?", short_key, NAME, 0.6),
        ]
    for label, name in PLAIN:
        out += [
            Rule(label, f"spdx licen[cs]e identifier {name}", "spdx", IDENTIFIER, 1.0),
            Rule(label, f"{under}{name}(?: style)? licen[cs]e", "licen", TEXT, 0.95),
            Rule(label, f"under (?:the )?(?:terms of the )?{name}(?: style)? licen[cs]e", "licen", TEXT, 0.9),
            Rule(label, f"{name} licen[cs]ed?", "licen", NAME, 0.6),
        ]
    out += [Rule(label, words, keyword, TEXT, 0.9 if label != "proprietary" else 0.5) for label, words, keyword in SENTENCES]
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _whole(pattern: str) -> str:
    return f"(?<= )(?:{pattern})(?= )"


def _words(text: str) -> str:
    """Words of a piece of text that begins and ends with a space."""
    return f"(octet_length({text}) - octet_length(replace({text}, ' ', '')) - 1)"


def normal(text: Column) -> Column:
    """The words, A-Z in lower case, each between two spaces; the empty text where there are none."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    words = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score): one row per row of ``docs``.

    Base: places of the phrases of ``BASE``, which are always labelled. Further labels come from detections that are not
    suppressed; the score is the greatest weight among them, 0.9 or more where there is a base place, 0 where nothing is
    found. Null and empty texts have no words and no labels. Everything happens within a row: no shuffle, no Python.
    """
    table = rules()
    keywords = sorted({r.keyword for r in table})
    listed = "array(" + ", ".join(
        f"named_struct('label', {_quoted(r.label)}, 'pattern', {_quoted(_whole(r.pattern))}, 'keyword', {keywords.index(r.keyword)}, "
        f"'priority', {r.priority}, 'place', {i}, 'weight', {r.weight}D)"
        for i, r in enumerate(table)
    ) + ")"
    keys = "array(" + ", ".join(map(_quoted, keywords)) + ")"

    now = docs.select(F.col("doc_id"), normal(F.col("text")).alias("p"))
    cut = [F.expr(f"if(contains(p, {_quoted(f' {b} ')}), split(p, {_quoted(_whole(b))}), array(p))").alias(f"b{i}") for i, b in enumerate(BASE)]
    now = now.select("doc_id", "p", F.expr(f"if(p = '', 0, {_words('p')})").alias("n"), *cut)
    size = [f"size(b{i}) - 1" for i in range(len(BASE))]
    first = [f"if({s} > 0, {_words(f'b{i}[0]')}, null)" for i, s in enumerate(size)]
    last = [f"if({s} > 0, n - {_words(f'b{i}[{s}]')} - {len(b.split())}, null)" for (i, s), b in zip(enumerate(size), BASE)]
    base = ", ".join(f"if({s} > 0, {_quoted(label)}, null)" for s, label in zip(size, BASE.values()))
    now = now.select(
        "doc_id", "p",
        F.col("n").cast("long").alias("n_words"),
        F.expr(f"cast({' + '.join(size)} as long)").alias("n_base"),
        F.expr(f"cast(least({', '.join(first)}) as long)").alias("first_word"),
        F.expr(f"cast(greatest({', '.join(last)}) as long)").alias("last_word"),
        F.expr(f"array_compact(array({base}))").alias("base"),
        F.expr(f"filter(sequence(0, {len(keywords) - 1}), k -> contains(p, element_at({keys}, k + 1)))").alias("keys"),
    )
    tried = F.expr(
        f"if(size(keys) = 0, null, filter(transform(filter({listed}, r -> array_contains(keys, r.keyword)), r -> named_struct("
        "'rule', r, 'hits', regexp_extract_all(p, r.pattern, 0), 'parts', split(p, r.pattern))), d -> size(d.hits) > 0))"
    )
    now = now.withColumn("tried", tried)
    hit = f"({_words('h')} + 2)"  # words of a hit, which has no space around it
    start = f"(s.at + {_words('d.parts[s.i]')})"
    found = F.expr(
        "if(tried is null or size(tried) = 0, null, flatten(transform(tried, d -> aggregate(d.hits, "
        "named_struct('at', 0, 'i', 0, 'out', cast(array() as array<struct<first:int,last:int,priority:int,place:int,label:string,weight:double>>)), "
        f"(s, h) -> named_struct('at', {start} + {hit}, 'i', s.i + 1, 'out', concat(s.out, array(named_struct("
        f"'first', {start}, 'last', -({start} + {hit} - 1), 'priority', -d.rule.priority, 'place', d.rule.place, "
        "'label', d.rule.label, 'weight', d.rule.weight)))), s -> s.out))))"
    )
    # in order of start, longest first, then by priority and rule: what holds an interval comes before it
    kept = F.expr(
        "if(found is null, null, aggregate(sort_array(found), "
        "named_struct('r1', -1, 'r2', -1, 'r3', -1, 'out', cast(array() as array<struct<label:string,weight:double>>)), "
        "(s, d) -> named_struct("
        "'r1', greatest(s.r1, -d.last), "
        "'r2', if(d.priority <= -2, greatest(s.r2, -d.last), s.r2), "
        "'r3', if(d.priority <= -3, greatest(s.r3, -d.last), s.r3), "
        "'out', if(case d.priority when -1 then s.r1 when -2 then s.r2 else s.r3 end >= -d.last, s.out, "
        "concat(s.out, array(named_struct('label', d.label, 'weight', d.weight))))), s -> s.out))"
    )
    now = now.withColumn("found", found).withColumn("kept", kept)
    return now.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.expr("array_join(array_sort(array_distinct(base)), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(concat(base, coalesce(kept.label, cast(array() as array<string>))))), ',')").alias("labels"),
        F.expr("greatest(if(n_base > 0, 0.9D, 0D), coalesce(array_max(kept.weight), 0D))").alias("score"),
    )
