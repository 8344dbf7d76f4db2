import corpus_pipeline
from creditloom.llm import packing, quality
from creditloom.llm.common import stored

from test_packing import PATH
from test_simhash import by_hand as print_of
from test_simhash import grouped, planned
from test_suffix_within import by_hand as repeats_of
from creditloom.llm.suffix import without


def test_stages_and_rows_equal_plain_versions(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    net = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = sorted(r for r in docs.collect() if quality.probability(net, (r.text or "").encode()) >= 0.3)
    assert 500 < len(rows) < docs.count()

    kept = [r for i, r in zip(grouped([print_of(r.text) for r in rows]), rows) if rows[i].doc_id == r.doc_id]
    assert len(kept) < len(rows)
    spans = {}
    for doc, first, n, removed in repeats_of([(r.doc_id, r.text) for r in kept], 50):
        if removed:
            spans.setdefault(doc, []).append((first, n))
    final = {}
    for r in kept:
        text = without(r.text.encode(), spans[r.doc_id]).decode() if r.doc_id in spans else r.text
        if text or r.doc_id not in spans:
            final[r.doc_id] = text

    now = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stored(stage(spark, now, folder), "test")
        if i < 3:
            assert now.columns == names
        if i == 2:
            assert {r.doc_id: r.text for r in now.collect()} == final
    lengths = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in now.collect())
    plain = spark.createDataFrame(list(final.items()), "doc_id long, text string")
    assert lengths == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pieces(plain, PATH).collect())
    got = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == lengths


def test_odd_documents(spark, odd_documents, no_documents):
    folder = "/root/testdata/sf0.001"
    now = odd_documents
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, now = now, stored(stage(spark, now, folder), "test")
        if i < 3:
            assert now.columns == odd_documents.columns
            left = [r.doc_id for r in now.collect()]
            assert len(left) == len(set(left)) or i == 0
            assert set(left) <= {r.doc_id for r in before.collect()}
        else:
            assert {r.doc_id for r in now.collect()} == {r.doc_id for r in before.collect()}
    now = no_documents
    for _, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, folder), "test")
        assert now.count() == 0


def test_near_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text, "a"), (3, text, "b"), (5, text, "a"), (7, "other words entirely here", "a"), (None, text, "a"), (None, text, "a"), (8, None, "a"), (9, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == [(False, 3), (False, 7), (False, 8), (True, 0), (True, 0)]


def test_near_stage_broadcasts_no_variants(spark, monkeypatch):
    """What the second stage stores on its way is joined by sorting, however small Spark takes it to be."""
    rows = [(i, f"a b c d {i // 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    *plans, _ = planned(monkeypatch, lambda: corpus_pipeline.near_dedup(spark, docs, ""))
    assert any("Generate" in p and "SortMergeJoin" in p for p in plans)
    assert not any("Broadcast" in p for p in plans)
