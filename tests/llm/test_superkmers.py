import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from creditloom.llm import superkmers
from creditloom.llm.queries import op13_substring_dedup


def by_hand(rows, least):
    """Windows of all rows counted one by one."""
    texts = [(doc, (text or "").encode().split()) for doc, text in rows]
    times = Counter(tuple(w[i : i + least]) for _, w in texts for i in range(len(w) - least + 1))
    out = []
    for doc, words in texts:
        gone = set()
        for i in range(len(words) - least + 1):
            if times[tuple(words[i : i + least])] > 1:
                gone.update(range(i, i + least))
        out.append((doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out, key=repr)


def found(docs, **more):
    rows = superkmers.deduplicated(docs, **more).collect()
    for r in rows:
        assert sum(s.n_words for s in r.removed) == r.n_removed
        assert all(a.first_word + a.n_words < b.first_word for a, b in zip(r.removed, r.removed[1:]))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr)


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], 35)
    assert sum(0 < w[2] < w[1] for w in want) > 50
    got = sorted(tuple(r) for r in op13_substring_dedup(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == sorted((d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in want)


@pytest.mark.parametrize("crowded", [0, 5, 10**6])
def test_crossing_repeats(spark, crowded):
    """Few distinct words: repeats overlap, cross, touch and recur within one text; crowded minimisers change nothing."""
    rng = random.Random(crowded)
    phrases = [[rng.choice("abc") for _ in range(rng.randint(3, 14))] for _ in range(8)]
    rows = [(d, " ".join(w for _ in range(rng.randint(0, 7)) for w in rng.choice(phrases))) for d in range(80)]
    rows += [(90, "a " * 30), (91, "a b " * 20), (91, "c " + "a b " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, least=9, run=4, crowded=crowded, per_bin=50) == by_hand(rows, 9)


def test_odd_documents(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert found(odd_documents) == by_hand(rows, 35)
    assert found(no_documents) == []


def test_copies_nulls_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (1, text + " x"), (1, "y " + text), (2, None), (3, text[:90]), (3, text[:90]), (4, "alone " * 34)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs) == by_hand(rows, 35)


def test_minimisers_are_leftmost_minima():
    rng = random.Random(1)
    words = superkmers.Spelled(" ".join(rng.choice("ab") for _ in range(200)).encode())
    values, places = superkmers.minimisers(words, 12, 3)
    runs = words.runs(3).tolist()
    for i, (v, p) in enumerate(zip(values.tolist(), places.tolist())):
        own = runs[i : i + 10]
        assert (v, p) == (min(own), i + own.index(min(own)))
    assert len(values) == 189 and np.all(np.diff(places) >= 0)
