import zlib

import numpy as np

from creditloom.llm import quality, queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op10_quality_classifier(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, poor = [p for p, y in held if y == 1], [p for p, y in held if y == 0]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert np.mean(good) > 0.97 and np.mean(poor) < 0.25  # few poor texts to learn from in this table


def test_held_out_labels_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", (1 - labels.quality)).where(quality.crc_of_id() % 5 == 0)
    both = labels.where(quality.crc_of_id() % 5 != 0).unionByName(turned)
    one, two = quality.fit(docs, labels), quality.fit(docs, both)
    assert np.array_equal(one.filters, two.filters) and np.array_equal(one.weights, two.weights)


def test_every_byte_counts():
    net = quality.Network.fresh()
    base = b"word " * 5000
    for at in (0, 7, 12_000, len(base) - 1):
        changed = bytearray(base)
        changed[at] = 255
        boosted = quality.Network(net.filters.copy(), net.bias, net.weights, net.constant)
        boosted.filters[:, 255] = 50
        assert quality.logit(boosted, bytes(changed)) != quality.logit(boosted, base)


def test_blocks_do_not_matter(monkeypatch):
    net, text = quality.Network.fresh(), bytes(np.random.default_rng(1).integers(32, 127, 40_000, np.uint8))
    whole = quality.logit(net, text)
    monkeypatch.setattr(quality, "BLOCK", 128)
    assert abs(quality.logit(net, text) - whole) < 1e-6


def test_gradient_is_that_of_the_loss():
    net = quality.Network.fresh()
    texts, labels = [b"abc " * 300, b"", b"!!xyz" * 90], np.array([1, 0, 0], np.float32)
    costs = np.array([0.5, 1, 2])
    grad = quality._gradient(net, texts, labels, costs)

    def loss():
        p = [quality.probability(net, t) for t in texts]
        return -sum(c * np.log(q if y else 1 - q) for c, q, y in zip(costs, p, labels))

    for name, at in (("weights", (3,)), ("constant", (0,)), ("bias", (5,)), ("filters", (2, ord("c"), 4))):
        value, kept = getattr(net, name), getattr(net, name)[at]
        value[at] = kept + 1e-2
        up = loss()
        value[at] = kept - 1e-2
        slope = (up - loss()) / 2e-2
        value[at] = kept
        assert abs(slope - getattr(grad, name)[at]) < 2e-2 * max(1, abs(slope))


def test_odd_inputs(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    net = quality.fit(odd_documents, none)
    assert quality.scores(odd_documents, net).count() == odd_documents.count()
    assert quality.scores(no_documents, net).count() == 0
    odd = spark.createDataFrame([(5, 1), (5, 0), (6, None), (7, 1), (7, 1), (None, 0), (99, 0)], "doc_id long, quality int")
    net = quality.fit(odd_documents, odd)
    kept = quality.accepted(odd_documents, net)
    assert kept.columns == odd_documents.columns and kept.count() >= 0
