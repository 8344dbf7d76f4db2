import random

import pytest

from creditloom.llm import suffix


def by_hand(rows, least):
    """Windows of every document that another document holds; removed where one with a smaller id does."""
    windows = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - least + 1):
            windows.setdefault(tuple(words[i : i + least]), set()).add(doc)
    out = set()
    for doc, text in rows:
        words = (text or "").encode().split()
        kinds = {True: [], False: []}
        for i in range(len(words) - least + 1):
            holders = windows[tuple(words[i : i + least])]
            if len(holders) > 1:
                kinds[min(holders) < doc].append(i)
        for removed, places in kinds.items():
            start = None
            for i in places:
                if start is None or i > last + least:
                    if start is not None:
                        out.add((doc, start, last - start + least, removed))
                    start = i
                last = i
            if start is not None:
                out.add((doc, start, last - start + least, removed))
    return out


def found(docs, **more):
    rows = [tuple(r) for r in suffix.repeats(docs, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert len(want) > 100
    assert found(docs) == want


@pytest.mark.parametrize("seed", range(3))
def test_crossing_repeats(spark, seed):
    """Few distinct words, so that repeats overlap, cross and touch."""
    rng = random.Random(seed)
    phrases = [[rng.choice("abc") for _ in range(rng.randint(3, 14))] for _ in range(8)]
    rows = []
    for doc in range(60):
        words = [w for _ in range(rng.randint(0, 6)) for w in rng.choice(phrases)]
        rows.append((doc, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, least=9, seed=4) == by_hand(rows, 9)


def test_odd_documents(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    assert found(odd_documents) == by_hand(list(dict.fromkeys(rows)), 50)


def test_empty_and_odd_ids(spark, no_documents):
    assert suffix.repeats(no_documents).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (1, text), (2, text), (2, text), (3, text), (3, text + " more"), (4, text + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r for r in found(docs) if r[0] not in (3,)}
    assert {(1, 0, 60, False), (2, 0, 60, True), (4, 0, 60, True)} <= got
    assert not [r for r in found(docs) if r[0] is None]


def test_documents_without_their_repeats(spark):
    shared = " ".join(f"s{i}" for i in range(55))
    rows = [
        (1, f"one  start\n{shared}\nend one", 9), (2, f"two begin\n{shared}  stop two", 9), (3, shared, 9), (4, "clean  text ", 12),
        (5, None, None), (6, "", 0), (None, shared, 7),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffix.deduplicated(docs).collect()}
    assert got == {
        1: (rows[0][1], 9), 2: ("two begin\nstop two", 18), 4: ("clean  text ", 12), 5: (None, None), 6: ("", 0), None: (shared, 7),
    }
