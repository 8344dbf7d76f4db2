import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from creditloom.llm import packing
from creditloom.llm.words import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def expected(rows, tokenizer, capacity):
    out = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            out.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check(docs, tokenizer, capacity):
    found = packing.pack(docs, PATH, capacity).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    key = repr
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=key) == sorted(
        expected(rows, tokenizer, capacity), key=key
    )
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in found)
    assert len(places) <= 11 * total / capacity / 9 + 1
    return found


def test_odd_documents(odd_documents, tokenizer):
    check(odd_documents, tokenizer, 64)


def test_empty_table(no_documents):
    assert packing.pack(no_documents, PATH).count() == 0


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = check(docs, tokenizer, 2048)
    assert len({r.sequence_id for r in found}) <= -(-sum(r.length for r in found) // 2048) + 1


def test_ranks_are_dense_over_many_blocks(spark, odd_documents):
    pieces = packing.pieces(odd_documents, PATH, 16)
    own = {}
    for r in packing.ranked(pieces, per_block=3).collect():
        own.setdefault(r.length, []).append(r["rank"])
    assert max(map(len, own.values())) > 100
    assert all(sorted(x) == list(range(len(x))) for x in own.values())


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_over_single_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 400))]
    if seed % 3 == 0:
        lengths += [rng.randint(1, capacity)] * 300
    plan = packing.best_fit(Counter(lengths), capacity)
    used = {}
    for length, count in Counter(lengths).items():
        own = sorted((s.first, s.count) for s in plan if s.length == length)
        at = 0
        for first, n in own:
            assert first == at
            at += n
        assert at == count
    for s in plan:
        for k in range(s.count):
            used.setdefault(s.sequence + k // s.each, []).append((s.offset + k % s.each * s.length, s.length))
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == plain_best_fit(lengths, capacity)


def test_memory_of_words_may_start_afresh(monkeypatch, tokenizer):
    from creditloom.llm import words

    monkeypatch.setattr(words, "REMEMBERED", 5)
    encoder = WordEncoder(PATH)
    texts = ["the cat, sat on 3 mats's end. ab12cd!! don't", "a b c d e f g h i j k l m n o p q r s t", "the cat Σας ΣΑΣ"]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_batch(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
