import itertools
import random

import pytest
import xxhash

from creditloom.llm import graph, simhash


def by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    if not words:
        return 0
    n = max(1, len(words) - 2)
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def grouped(prints):
    """Smallest index that links reach, over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 2:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [by_hand(t) for _, t in rows]
    want = {rows[i][0]: (f"{prints[i]:016x}", rows[g][0]) for i, g in enumerate(grouped(prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == want


def test_odd_documents(odd_documents):
    rows = odd_documents.select("doc_id", "text").collect()
    prints = [by_hand(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    want = sorted((ids[i], f"{prints[i]:016x}", ids[g]) for i, g in enumerate(grouped(prints)))
    got = simhash.near_duplicates(odd_documents).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_empty_table_and_null_ids(spark, no_documents):
    assert simhash.near_duplicates(no_documents).count() == 0
    docs = spark.createDataFrame([(None, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {(None, None), (1, 1)}


@pytest.mark.parametrize("pairwise", [48, 2])
@pytest.mark.parametrize("seed", range(3))
def test_links_connect_all_within_two_bits(spark, monkeypatch, pairwise, seed):
    """Crowded neighbourhoods, with pairs formed in buckets and with finer variants only."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(seed)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    place = {s: i for i, s in enumerate(signed)}
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in simhash.links(table).collect():
        i, j = place[r.u], place[r.v]
        assert bin(prints[i] ^ prints[j]).count("1") <= 2
        a, b = sorted((find(i), find(j)))
        root[b] = a
    assert [find(i) for i in range(len(prints))] == grouped(prints)


def planned(monkeypatch, run):
    """The plans of the tables that SimHash and its components store, and of the result."""
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    with monkeypatch.context() as patch:
        for module in (simhash, graph):
            patch.setattr(module, "stored", lambda df, purpose, real=module.stored: real(kept(df), purpose))
        kept(run())
    return plans


def test_tables_that_grow_are_not_broadcast(spark, monkeypatch):
    """Of a small table too: Spark takes the 64 variants of a fingerprint for one row, so they look small long after."""
    rows = [(i, f"a b c d {i // 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans = planned(monkeypatch, lambda: simhash.near_duplicates(docs))
    assert sum("SortMergeJoin" in p for p in plans) > 2
    assert not any("Broadcast" in p for p in plans)
