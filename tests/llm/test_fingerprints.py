import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from creditloom.llm import fingerprints


def by_hand(rows):
    """Likeness from the paragraphs themselves."""
    order = sorted({(r[0] is not None, r[0] or 0, r[2]): r[1] or "" for r in rows}.items())
    follower = {k: order[(i + 1) % len(order)][1] for i, (k, _) in enumerate(order)}
    parts = lambda t: {x for x in re.split(r"[\r\n]+", t) if x}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    out = []
    for doc, text, h in rows:
        text, after = text or "", follower[(doc is not None, doc or 0, h)]
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        a = parts(text)
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), like(a, parts(new)), like(a, parts(after))))
    return out


def check(docs):
    found = fingerprints.compare_edits(docs)
    assert "Python" not in found._jdf.queryExecution().toString()
    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    got = found.collect()
    values = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got]
    assert sorted(values, key=repr) == sorted(by_hand([tuple(r) for r in rows]), key=repr)
    return got, {r.doc_id: r.text or "" for r in rows}


def test_odd_documents(odd_documents):
    got, texts = check(odd_documents)
    prints = {}
    for r in got:
        prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_whole_table(spark):
    got, _ = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert sum(r.near_edited > r.near_next for r in got) > 0.8 * len(got)


def test_one_row_none_and_shared_ids(spark, no_documents):
    assert fingerprints.compare_edits(no_documents).count() == 0
    check(spark.createDataFrame([(4, "one\ntwo\nthree")], "doc_id long, text string"))
    check(spark.createDataFrame([(4, "one\ntwo"), (4, "three\nfour"), (None, "five."), (4, "one\ntwo"), (9, None)], "doc_id long, text string"))


def test_order_over_many_ranges(spark):
    ids = sorted(random.Random(3).sample(range(10**9), 500))
    keys = spark.createDataFrame([(i, i % 7) for i in ids], "id long, h long")
    got = {r.id: r.next_id for r in fingerprints.followers(keys, "test", per_block=20).collect()}
    assert got == dict(zip(ids, ids[1:] + ids[:1]))


@pytest.mark.parametrize("size", [8, 64])
def test_peeling_recovers_the_difference_or_fails(spark, size):
    rng = random.Random(size)
    rows = []
    for n in range(0, 60, 3):
        common = [rng.getrandbits(62) for _ in range(rng.randint(0, 40))]
        a, b = ([rng.getrandbits(62) for _ in range(rng.randint(0, n))] for _ in "ab")
        rows.append((common + a, b + common, sorted(a), sorted(b)))
    table = spark.createDataFrame(rows, "a array<long>, b array<long>, x array<long>, y array<long>")
    sketches = table.select("x", "y", F.expr(fingerprints.sketch("a", str(size))).alias("s"), F.expr(fingerprints.sketch("b", str(size))).alias("t"))
    got = sketches.select("x", "y", F.expr(fingerprints.difference("s", "t", str(size))).alias("d")).collect()
    solved = [r for r in got if r.d is not None]
    assert all(sorted(r.d.a) == r.x and sorted(r.d.b) == r.y for r in solved)
    assert all(r.d is not None for r in got if len(r.x) + len(r.y) <= size)


def test_rows_whose_first_sketches_fail_get_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "WIDE", 0)
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
