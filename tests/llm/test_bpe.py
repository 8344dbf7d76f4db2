import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from creditloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def encoding():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(docs):
    other = encoding()
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(other.encode_ordinary(r.text or ""), "<u4").tobytes()
        want.append(
            (r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        )
    got = [tuple(r) for r in bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect()]
    assert sorted(got) == sorted(want)


def test_odd_documents(odd_documents):
    check(odd_documents)


def test_whole_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_empty_table(no_documents):
    assert bpe.round_trip(no_documents, PATH, public_tokenizers.PATTERN).count() == 0


def test_memory_of_tokens_may_start_afresh(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    pairs, other = bpe.BytePairs(PATH, public_tokenizers.PATTERN), encoding()
    for text in ("the quick brown fox jumps over the lazy dog again and again", "zażółć gęślą jaźń 123") * 2:
        assert np.frombuffer(pairs.encode(text), "<u4").tolist() == other.encode_ordinary(text)
