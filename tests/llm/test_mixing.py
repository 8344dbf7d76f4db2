import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from creditloom.llm import mixing


def plain(rows):
    """Held out, tokens, known tokens, training tokens and base score."""
    cut = [(i, (t or "").encode().lower().split()) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in cut]
    counts = Counter(w for (_, ws), h in zip(cut, held) if not h for w in [*ws, None])
    n, v = counts.total(), len(counts)
    return [
        (i, h, len(ws) + 1, sum(w in counts for w in [*ws, None]), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None]))
        for (i, ws), h in zip(cut, held)
    ]


def check(docs):
    got = mixing.score(docs).collect()
    want = plain([tuple(r) for r in docs.select("doc_id", "text").collect()])
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    for a, b in zip(mine, sorted(want, key=repr), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    return got


@pytest.mark.parametrize("heavy", [500_000, 20])
def test_base_scores(spark, odd_documents, monkeypatch, heavy):
    monkeypatch.setattr(mixing, "HEAVY", heavy)
    got = check(odd_documents)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.score, r.base_score))
    assert all(len(x) == 1 for x in by_id.values())


def test_held_out_scores_beat_the_base(spark):
    """In 20 MB of text; in a tenth of that the words' own counts are still as good."""
    got = check(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_table_and_no_training_rows(spark, no_documents):
    assert mixing.score(no_documents).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    check(spark.createDataFrame([(held, "some words"), (held, None)], "doc_id long, text string"))


def model(texts):
    histogram = np.zeros(256, np.int64)
    for t in texts:
        histogram += np.bincount(np.frombuffer(t.lower(), np.uint8), minlength=256)
    code = mixing.make_code(histogram)
    rng = np.random.default_rng(5)
    return mixing.Mixer(code, [rng.integers(-60, 60, n * mixing.CLASSES).astype(np.int8) for n in mixing.ROWS])


def test_probabilities_of_all_next_bytes_add_up_to_one():
    """The last byte of a part may be any of the 255 that the code knows; together they have the probability of the rest."""
    mixer = model([b"some text to count bytes in, with a few letters"])
    for head in (b"", b"the cat sat", b"x y " * 300):
        parts = [head + bytes([b]) for b in range(256) if b != mixing.START]
        ends = np.concatenate([mixer._mixed(parts[i : i + 20]) for i in range(0, len(parts), 20)])
        before = 0.0
        if head:
            # the head alone: all its continuations in one more byte
            before = mixer._mixed([head])[0]
        assert abs(np.log10(np.sum(10.0 ** (ends - before))) ) < 1e-4


def test_neighbours_and_grouping_do_not_matter(monkeypatch):
    mixer = model([b"abc"])
    texts = [b"", b"One text " * 500, b"\xc3\xa9t\xc3\xa9 " * 99, b"z" * 3000, b"a b"]
    alone = [mixer.scores([t])[0] for t in texts]
    assert np.allclose(mixer.scores(texts), alone, rtol=1e-9)
    monkeypatch.setattr(mixing, "LANES", 2)
    assert np.allclose(mixer.scores(texts), alone, rtol=1e-9)
    monkeypatch.setattr(mixing, "SEGMENT", 1000)
    cut = mixer.scores(texts)
    assert cut[0] == alone[0] and np.allclose(cut, alone, rtol=0.2)


def test_learning_helps_within_a_text():
    mixer = model([b"abc"])
    once, often = mixer.scores([b"the same words again "])[0], mixer.scores([b"the same words again " * 400])[0]
    assert often > 400 * once * 0.9
