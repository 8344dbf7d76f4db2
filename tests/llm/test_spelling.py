import random
import re
import zlib
from collections import Counter

import pytest

from creditloom.llm import spelling
from creditloom.llm.queries import op12_spelling_variants

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_of(rows, shortest=6, least=5, modulus=199):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if modulus and h % modulus == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(x != y for x, y in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def neighbours(words):
    """By deleting letters: words that share a result may be near."""
    shared = {}
    for w in words:
        for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            shared.setdefault(x, set()).add(w)
    out = {w: set() for w in words}
    for group in shared.values():
        for u in group:
            out[u].update(v for v in group if v not in out[u] and near(u, v))
    return out


def by_hand(n, ratio=5):
    form, rows = {}, {}
    for w, others in neighbours(n).items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        rows[w] = len(others)
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], rows[w], n[form[w]] if form[w] else None))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = by_hand(counts_of([(r.doc_id, r.text) for r in docs.collect()]))
    assert sum(w[4] > 0 for w in want) > 1000 and sum(w[1] is not None for w in want) > 50
    assert found(op12_spelling_variants(spark, folder)) == want


@pytest.mark.parametrize("crowded", [1, 7, 5000])
def test_crowded_states(spark, crowded):
    """Words over few letters, so that most are near many others; halves are split down to one letter."""
    rng = random.Random(crowded)
    texts = [
        (i, " ".join("".join(rng.choice("abé") for _ in range(rng.choice([2, 3, 3, 4, 5, 9]))) for _ in range(60))) for i in range(40)
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    n = counts_of(texts, 2, 1, 7)
    want = by_hand(n, 2)
    assert any(w[4] > 8 for w in want) and any(w[2] != w[1] and w[1] for w in want)
    assert found(spelling.variants(docs, 2, 1, 2, 7, crowded=crowded, per_bin=100)) == want


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    want = by_hand(counts_of(rows, 2, 1))
    assert found(spelling.variants(odd_documents, 2, 1)) == want
    assert found(spelling.variants(no_documents)) == set()
    nameless = spark.createDataFrame([(None, "abcdefg " * 5 + "ABCDEFGH " * 30), (None, None)], "doc_id long, text string")
    assert found(spelling.variants(nameless)) == by_hand(counts_of([(None, "abcdefg " * 5 + "ABCDEFGH " * 30)]))


def test_acceptor_is_minimal_and_pairs_come_once():
    machine = spelling.Acceptors()
    start = machine.build(sorted(["aax", "aay", "bax", "bay", "cax"]))
    assert len(machine.arcs) == 6  # the start, after a or b, after c, after aa, after ca, the end
    assert machine.arcs[start]["a"] == machine.arcs[start]["b"] != machine.arcs[start]["c"]
    assert sorted(machine.common(machine.arcs[start]["a"], machine.arcs[start]["c"])) == ["ax"]
    words = ["aaaa", "aaaaa", "aaba", "aabaa"]
    pairs = []
    for a, b in ((0, 2), (2, 5)):
        groups = {}
        for w in words:
            groups.setdefault((w[:a], w[len(w) - max(0, 4 - b) :]), []).append(w)
        pairs += [tuple(sorted(p)) for own in groups.values() for p in spelling.near_pairs(own, 4, a, b)]
    assert sorted(pairs) == sorted((u, v) for u in words for v in words if u < v and near(u, v) and min(len(u), len(v)) == 4)
