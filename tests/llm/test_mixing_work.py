"""The language model's work: few steps, and the same numbers as plain Python, byte by byte and word by word."""

from collections import Counter
from math import exp, log, log10

import numpy as np
import pyarrow as pa

from creditloom.llm import mixing
from creditloom.llm.suffix import MULTIPLIER

from test_mixing import model

WIDE, LONG = 2**32, 2**64


def rows_and_gate(codes, at, code):
    before = [int(code.classes[codes[at - k]]) for k in range(1, 6)]
    three = before[0] | before[1] << 6 | before[2] << 12
    five = three | before[3] << 18 | before[4] << 24
    begin = max((k + 1 for k in range(at) if codes[k] <= 32 or codes[k] >= mixing.START), default=0)
    hint = next(c for c in codes[at - 1 :: -1] if c >= 128)
    word = sum((codes[k] + 1) * pow(MULTIPLIER, k - begin, LONG) for k in range(begin, at)) % LONG
    word = ((word ^ word >> 29) + hint * 0x9E3779B97F4A7C15) % LONG
    word = (word ^ word >> 32) * 0xBF58476D1CE4E5B9 % LONG >> 46
    hinted = (three + hint * 0xC2B2AE35) * 0x9E3779B1 % WIDE >> 16
    return [hinted, five * 0x85EBCA6B % WIDE >> 16, word], min(at - begin, mixing.GATES - 1)


def by_hand(mixer, text):
    """log10 probability of a text, bit by bit."""
    codes, code, half = [mixing.START] * mixing.LEAD + [*text.lower(), mixing.END], mixer.code, mixing.BUCKETS // 2
    weights = [[*mixing.WEIGHTS] for _ in range(mixing.GATES)]
    hits, tries = [4 / (1 + exp(-(k - half) / 2)) for k in range(mixing.BUCKETS)], [4.0] * mixing.BUCKETS
    total = 0.0
    for step in range(mixing.LEAD, len(codes), mixing.CHUNK):
        learned, met = [[0.0] * 3 for _ in weights], []
        for at in range(step, min(step + mixing.CHUNK, len(codes))):
            rows, gate = rows_and_gate(codes, at, code)
            cls = int(code.classes[codes[at]])
            for k in range(code.first[cls], code.first[cls] + code.length[cls]):
                x = [int(t[r * mixing.CLASSES + code.nodes[k]]) / mixing.QUANTUM for t, r in zip(mixer.tables, rows)]
                z = max(-8.0, min(8.0, sum(w * i for w, i in zip(weights[gate], x))))
                p, y, bucket = 1 / (1 + exp(-z)), int(code.bits[k]), int(2 * z + half + 0.5)
                q = max(1e-5, min(1 - 1e-5, 0.6 * p + 0.4 * hits[bucket] / tries[bucket]))
                total += log(q if y else 1 - q) / log(10)
                learned[gate] = [g + (y - p) * i for g, i in zip(learned[gate], x)]
                met.append((bucket, y))
            if cls == mixing.RARE:
                total += code.rare[codes[at]]
        weights = [[w + mixing.RATE * g for w, g in zip(ws, gs)] for ws, gs in zip(weights, learned)]
        for bucket, y in met:
            hits[bucket] += y
            tries[bucket] += 1
    return total


def test_scores_equal_a_plain_mixer():
    mixer = model([b"some text to count bytes in, with a few letters"])
    texts = [b"", b"Two words", "Ein Ärger 日本\n x".encode(), b"the cat sat on\tthe mat. " * 60, b"\x00\x7f ~^{}" * 5]
    assert np.allclose(mixer.scores(texts), [by_hand(mixer, t) for t in texts], rtol=1e-4)


def test_parts_of_like_length_are_mixed_side_by_side(monkeypatch):
    """Long and short texts in turn: a step is taken for all parts of a group, so mixed groups take many more."""
    steps = []
    mixer = model([b"abc"])
    monkeypatch.setattr(mixing, "LANES", 8)
    monkeypatch.setattr(
        mixing.Mixer, "_mixed", lambda self, parts: steps.append(max(map(len, parts)) // mixing.CHUNK + 1) or np.array([float(-len(p)) for p in parts])
    )
    texts = [b"x" * (20_000 if i % 8 == 3 else 10 + i) for i in range(64)]
    assert mixer.scores(texts) == [-len(t) - 1.0 for t in texts]
    assert sum(steps) <= 40 + 7


def counted(texts):
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 3], pa.string())], ["text"]) for i in range(0, len(texts), 3)]
    told = [row for batch in mixing._counted(iter(batches)) for row in batch.to_pylist()]
    words, numbers = Counter(), Counter()
    for row in told:
        if row["token"] is None:
            numbers[row["byte"]] += row["n"]
        else:
            words[row["token"]] += row["n"]
    return told, words, numbers


def test_tokens_are_counted_as_in_plain_python(monkeypatch):
    texts = ["", None, " ", "A b\tb\x0bc\x0cd\re\n\nA ", "\x1cx\x1d y\x85z w", "\x00 \x00a", "É é İ 日", "b b B"] * 5
    raw = [(t or "").encode().lower() for t in texts]
    want = Counter(w for t in raw for w in [*t.split(), mixing.END_TOKEN])
    seen = Counter(b for t in raw for b in [*t, mixing.END])
    told, words, numbers = counted(texts)
    assert (words, numbers) == (want, seen) and len(told) == len(want) + len(seen)
    monkeypatch.setattr(mixing, "TOKENS_HELD", 4)
    told, words, numbers = counted(texts)
    assert (words, numbers) == (want, seen) and len(told) > len(want) + len(seen)
    monkeypatch.setattr(mixing, "TOKENS_HELD", 1000)
    monkeypatch.setattr(mixing, "TABLES_HELD", 2)
    assert counted(texts)[1:] == (want, seen)
    assert counted([])[0] == []


def test_counts_come_back_from_blocks():
    code = mixing.make_code(np.ones(256, np.int64))
    rng = np.random.default_rng(3)
    blocks = [np.zeros(mixing.BLOCK_ROWS * mixing.CLASSES, np.uint32) for _ in range(3)]
    for block in blocks[1:]:
        block[rng.integers(0, len(block), 5000)] = rng.integers(1, 600, 5000)
        block[:5] = [254, 255, 256, 0, 2**32 - 1]
    table = pa.table({"block": [7] * 3, "task": [1, 2, 3], "counts": [mixing._packed(b) for b in blocks]})
    total = sum(b.astype(np.uint64) for b in blocks)
    once = mixing._summed(table, None)
    assert (mixing._total(once) == total).all()
    assert mixing._summed(once, code).column("counts")[0].as_py() == mixing.predictors(total, code).tobytes()
