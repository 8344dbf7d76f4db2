"""Byte-level BPE through a sentencepiece model written from the rank file."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import prepare, slices
from creditloom.llm.words import letters

#: Entries of the memory of pre-tokens before it starts afresh.
REMEMBERED = 400_000


def _field(number: int, kind: int, value: bytes) -> bytes:
    return bytes([number << 3 | kind]) + value


def _size(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _nested(number: int, body: bytes) -> bytes:
    return _field(number, 2, _size(len(body)) + body)


def model_proto(ranked: list[bytes]) -> bytes:
    """Serialised sentencepiece BPE model whose piece ``i`` is the vocabulary's rank ``i``, the unknown piece last.

    Pieces are written with one letter per byte and scored by negative rank, so that the merge of the lowest rank comes
    first. The normaliser is the identity: no added prefix, no removed or escaped white space.
    """
    show = letters()
    pieces = b"".join(
        _nested(1, _nested(1, "".join(show[b] for b in word).encode()) + _field(2, 5, struct.pack("<f", -rank)))
        for rank, word in enumerate(ranked)
    )
    unknown = _nested(1, _nested(1, "<unk>".encode()) + _field(2, 5, struct.pack("<f", 0)) + _field(3, 0, b"\x02"))
    trainer = _field(3, 0, b"\x02") + b"".join(  # BPE; ids of unknown, start, end and padding
        bytes([number << 3 & 127 | 128, number >> 4]) + value
        for number, value in ((40, _size(len(ranked))), (41, b"\xff" * 9 + b"\x01"), (42, b"\xff" * 9 + b"\x01"), (43, b"\xff" * 9 + b"\x01"))
    )
    normaliser = _nested(1, b"identity") + b"".join(_field(n, 0, b"\x00") for n in (3, 4, 5))
    return pieces + unknown + _nested(2, trainer) + _nested(3, normaliser)


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary of a rank file in order of rank; ranks must be 0, 1, 2, ... without a gap."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(word) for word, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


class BytePairs:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, path: str, pattern: str):
        from sentencepiece import SentencePieceProcessor

        self.vocabulary = read_ranks(path)
        self.processor = SentencePieceProcessor(model_proto=model_proto(self.vocabulary))
        self.pattern = regex.compile(pattern)
        self.shown = dict(enumerate(letters()))
        self.known: dict[str, bytes] = {}

    def _learn(self, new: list[str]) -> None:
        mapped = [x.encode().decode("latin-1").translate(self.shown) for x in new]
        found = self.processor.encode(mapped, num_threads=1)
        self.known.update((x, np.array(ids, "<u4").tobytes()) for x, ids in zip(new, found))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        tokens = self.pattern.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, tokens))
        except KeyError:
            out: list[bytes] = []
            for at in range(0, len(tokens), REMEMBERED):
                part = tokens[at : at + REMEMBERED]
                new = [x for x in dict.fromkeys(part) if x not in self.known]
                if len(self.known) + len(new) > 2 * REMEMBERED:
                    self.known.clear()
                    new = list(dict.fromkeys(part))
                self._learn(new)
                out += map(self.known.__getitem__, part)
            return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def byte_pairs(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    coder = byte_pairs(path, pattern)
    for batch in slices(batches):
        ids = [coder.encode(x or "") for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): every whole text's ids as little-endian unsigned 32-bit numbers; null texts count as empty."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_encoded, path=path, pattern=pattern), "doc_id long, ids binary")


def _decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    coder = byte_pairs(path, pattern)
    for batch in slices(batches):
        texts = [coder.decode(x or b"") for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"]
        )


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, bytes): the bytes that the ids stand for."""
    prepare(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(
        partial(_decoded, path=path, pattern=pattern), "doc_id long, ids binary, bytes binary"
    )


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    both = decode(encode(docs, path, pattern), path, pattern)
    return both.select(
        "doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )
