import re

import xxhash
from pyspark.sql import functions as F

from creditloom.llm import fingerprints, queries


def units(text):
    out = set()
    for p in re.split(fingerprints.SENTENCES, text):
        now = "".join(w + ("\n" if xxhash.xxh64_intdigest(w.encode(), 42) % fingerprints.RUN == 0 else "") + " " for w in p.split(" "))[:-1]
        out |= {x for x in re.split("\n ?", now) if x}
    return out


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_query_equals_plain_version(spark):
    """Likeness by sentences and runs of words; hardly a text shares nothing with its edited form."""
    folder = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    want = {}
    for i, (doc, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 4
        want[doc] = (like(units(text), units(text[: len(text) - k] + after[:k])), like(units(text), units(after)))
    found = queries.op7_document_fingerprints(spark, folder)
    assert "Python" not in found._jdf.queryExecution().toString()
    got = {r.doc_id: (r.near_edited, r.near_next) for r in found.collect()}
    assert got == want
    assert sum(e > n for e, n in got.values()) > 0.95 * len(got)


def test_single_line_shares_units_with_its_edit(spark):
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, "x" * len(text))], "doc_id long, text string")
    got = {r.doc_id: r.near_edited for r in fingerprints.compare_edits(docs, units=fingerprints.fine).collect()}
    assert 0.5 < got[1] < 1


def test_large_sketches_in_parts(spark):
    table = spark.range(1).select(F.expr("transform(sequence(1, 3000), x -> xxhash64(x))").alias("a"), F.expr("transform(sequence(1001, 3500), x -> xxhash64(x))").alias("b"))
    row = table.select(F.expr(fingerprints._differing("a", "b")).alias("d"), F.expr("array_except(a, b)").alias("x"), F.expr("array_except(b, a)").alias("y")).first()
    assert sorted(row.d.a) == sorted(row.x) and sorted(row.d.b) == sorted(row.y)
