"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import crc_of_id, prepare, raw, slices

WIDTH = 8  # bytes that a filter sees
STRIDE = 4
FILTERS = 16
STEP = 64  # positions from one chunk to the next; a chunk has twice as many, so neighbours overlap by half
BLOCK = 1 << 16  # positions convolved at once, a multiple of STEP
#: Labelled texts that the network learns from, at most; those with the smallest hash of their id are taken.
SAMPLE = 4000
THRESHOLD = 0.3


@dataclass
class Network:
    """Filters over bytes, and the weights that join their pooled answers into one logit.

    ``filters[j, b, f]`` is what byte ``b`` at place ``j`` adds to filter ``f``, that is a convolution over one-hot
    bytes.
    """

    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    constant: np.ndarray

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return Network(
            rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
            rng.normal(0, 0.3, FILTERS).astype(np.float32), np.zeros(1, np.float32),
        )


def _bytes(data: bytes) -> np.ndarray:
    """The text and zero bytes up to a whole number of half chunks, so that every byte is seen."""
    short = -max(len(data), 1) % (STEP * STRIDE)
    return np.frombuffer(data + bytes(short + WIDTH + (not data)), np.uint8)


def _answers(net: Network, codes: np.ndarray) -> np.ndarray:
    """Filter answers at every position."""
    n = (len(codes) - WIDTH) // STRIDE
    out = np.take(net.filters[0], codes[: STRIDE * n : STRIDE], axis=0)
    for j in range(1, WIDTH):
        out += np.take(net.filters[j], codes[j : j + STRIDE * n : STRIDE], axis=0)
    return out


def _half_chunks(net: Network, data: bytes) -> np.ndarray:
    """Largest answer of every filter within every half chunk of the whole document."""
    codes, found = _bytes(data), []
    positions = (len(codes) - WIDTH) // STRIDE
    for at in range(0, positions, BLOCK):
        upto = min(positions, at + BLOCK)
        part = _answers(net, codes[STRIDE * at : STRIDE * upto + WIDTH])
        found.append(part.reshape(-1, STEP, FILTERS).max(axis=1))
    return np.concatenate(found)


def _chunks(halves: np.ndarray) -> np.ndarray:
    return np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves


def logit(net: Network, data: bytes) -> float:
    """Chunks are pooled by their maximum, rectified, averaged over the document and weighed."""
    pooled = np.maximum(_chunks(_half_chunks(net, data)) + net.bias, 0)
    return float(pooled.mean(axis=0, dtype=np.float64) @ net.weights + net.constant[0])


def probability(net: Network, data: bytes) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit(net, data), -40, 40))))


def _gradient(net: Network, texts: list[bytes], labels: np.ndarray, costs: np.ndarray) -> Network:
    """Gradient of the weighted log loss: only the position that won its chunk passes it on to a filter."""
    grad = Network(*(np.zeros_like(getattr(net, f.name)) for f in fields(net)))
    for data, label, cost in zip(texts, labels, costs):
        codes = _bytes(data)
        answers = _answers(net, codes).reshape(-1, STEP, FILTERS)
        best = answers.argmax(axis=1)
        halves = np.take_along_axis(answers, best[:, None], axis=1)[:, 0]
        places = best + STEP * np.arange(len(best))[:, None]
        if len(halves) > 1:
            right = halves[1:] > halves[:-1]
            pooled, places = np.where(right, halves[1:], halves[:-1]), np.where(right, places[1:], places[:-1])
        else:
            pooled = halves
        raised = pooled + net.bias
        active = np.maximum(raised, 0)
        mean = active.mean(axis=0)
        z = float(mean @ net.weights + net.constant[0])
        error = np.float32(cost * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label))
        grad.weights += error * mean
        grad.constant += error
        down = (error / len(pooled)) * net.weights * (raised > 0)
        grad.bias += down.sum(axis=0)
        which = np.broadcast_to(np.arange(FILTERS), places.shape)
        for j in range(WIDTH):
            np.add.at(grad.filters[j], (codes[STRIDE * places + j], which), down)
    return grad


def train(texts: list[bytes], labels: list[int], shares: dict[int, float] | None = None, steps: int = 1200) -> Network:
    """Adam over the sample; ``shares`` are the classes' shares among all labels, where the sample is not in proportion."""
    net = Network.fresh()
    y = np.array(labels, np.float32)
    if len(set(labels)) < 2:  # nothing to tell apart: the constant alone says which class there is
        for f in fields(net):
            getattr(net, f.name)[...] = 0
        net.constant[0] = 0 if not labels else 6 * (2 * labels[0] - 1)
        return net
    own = np.array([float((y == c).mean()) for c in (0, 1)])
    cost = np.array([(shares or {}).get(c, own[c]) for c in (0, 1)]) / own
    rng, order = np.random.default_rng(11), np.zeros(0, int)
    first = [np.zeros_like(getattr(net, f.name)) for f in fields(net)]
    second = [np.zeros_like(x) for x in first]
    for step in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(y))
        some, order = order[:32], order[32:]
        grad = _gradient(net, [texts[i] for i in some], y[some], cost[y[some].astype(int)] / len(some))
        rate = 0.01 * (1 - step / (steps + 1))
        for k, f in enumerate(fields(net)):
            g, value = getattr(grad, f.name), getattr(net, f.name)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            value -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fold: int = 5) -> Network:
    """Network for the quality labels of ``labels`` (doc_id, quality), learned from a bounded sample of their texts.

    Only rows whose id has a remainder other than 0 are used. Up to ``sample`` / 2 ids of each class are taken, those
    with the smallest hash; the loss weighs the classes by their shares among all labels. Ids with conflicting or null
    labels are left out. The sampled ids (at most ``sample``) are broadcast, so the documents are not shuffled.
    """
    usable = (
        labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality"))
        .where((crc_of_id() % fold != 0) & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most").drop("most")
    )
    totals = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    shares = {c: n / sum(totals.values()) for c, n in totals.items()}
    parts = [
        usable.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for c in (0, 1)
    ]
    chosen = parts[0].union(parts[1]).withColumnRenamed("doc_id", "chosen")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = sorted(one_each(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"))).collect(), key=lambda r: r.doc_id)
    return train([r.text.encode() for r in rows], [r.quality for r in rows], shares)


def one_each(rows: DataFrame) -> DataFrame:
    """(doc_id, text, quality): repeated ids count once, with the greatest of their texts."""
    return rows.groupBy("doc_id", "quality").agg(F.max("text").alias("text")).select("doc_id", "text", "quality")


def _scored(batches: Iterator[pa.RecordBatch], net: Network) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        scores = [probability(net, x) for x in raw(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score): probability of label 1 for every row; null texts count as empty."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scored, net=net), "doc_id long, score double")


def _kept(batches: Iterator[pa.RecordBatch], net: Network, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keep = [probability(net, x) >= threshold for x in raw(batch, "text")]
        yield batch.filter(pa.array(keep, pa.bool_()))


def accepted(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns; nothing is shuffled."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(partial(_kept, net=net, threshold=threshold), docs.schema)
