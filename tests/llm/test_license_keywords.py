import random
import re
from re import _constants as kinds
from re import _parser as parser

import pytest

from creditloom.llm import licenses

SHORT = [("released under the GPL", "gpl"), ("distributed under the LGPL", "lgpl"), ("available under CC BY SA", "cc-by-sa"), ("under the CDDL", "cddl")]


def example(items, rng):
    """A text that the parsed pattern matches."""
    out = ""
    for kind, value in items:
        if kind is kinds.LITERAL:
            out += chr(value)
        elif kind is kinds.NOT_LITERAL:
            out += "w"
        elif kind is kinds.IN:
            out += chr(rng.choice([v for k, v in value if k is kinds.LITERAL]))
        elif kind is kinds.BRANCH:
            out += example(rng.choice(value[1]), rng)
        elif kind is kinds.SUBPATTERN:
            out += example(value[3], rng)
        elif kind is kinds.MAX_REPEAT:
            low, high, inner = value
            out += "".join(example(inner, rng) for _ in range(rng.randint(low, min(high, low + 2))))
        else:
            assert kind is kinds.ASSERT_NOT, kind
    return out


def test_every_rule_passes_its_own_keyword():
    rng = random.Random(1)
    for r in licenses.rules():
        for _ in range(40):
            text = example(parser.parse(r.pattern), rng)
            assert re.fullmatch(r.pattern, text) and r.keyword in f" {text} ", (r, text)


@pytest.mark.parametrize("text, label", SHORT)
def test_short_names_without_the_word_license(spark, text, label):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = licenses.scan(docs).first()
    assert (row.labels, row.score) == (label, 0.6)


@pytest.mark.parametrize(
    "text, label",
    [
        ("licensed under Apache 2.0", "apache-2"), ("It is under the MPL 1.1 now", "mpl-1.1"), ("License: EPL v2", "epl-2"),
        ("this is under the Eclipse Public License version 2", "epl-2"), ("under the gpl version 3 or so", "gpl-3"),
    ],
)
def test_name_with_version_stands_for_the_bare_name(spark, text, label):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert licenses.scan(docs).first().labels == label


def test_bare_name_beside_a_version(spark):
    """Two places: only the one that holds a version hides the name in it."""
    docs = spark.createDataFrame([(1, "under the MPL 1.1. Parts are under the MPL")], "doc_id long, text string")
    assert licenses.scan(docs).first().labels == "mpl,mpl-1.1"
