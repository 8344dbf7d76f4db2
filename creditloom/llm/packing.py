"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import prepare, ranked_blocks, slices, stored
from creditloom.llm.words import WordEncoder

CAPACITY = 2048
#: Pieces of one length that one task ranks.
PER_BLOCK = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _cut(batches: Iterator[pa.RecordBatch], vocabulary: str, end: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder, stop = _encoder(vocabulary), end.to_bytes(4, "little")
    for batch in slices(batches):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        rows: list[tuple] = []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_batch(texts)):
            ids += stop
            n = len(ids) // 4
            for piece, at in enumerate(range(0, n, capacity)):
                part = ids[4 * at : 4 * (at + capacity)]
                rows.append((doc, piece, at, len(part) // 4, zlib.crc32(part)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """One row per piece: every text's ids and the end id, cut at ``capacity``. Null texts count as empty."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_cut, vocabulary=vocabulary, end=end, capacity=capacity), PIECES)


@dataclass(frozen=True)
class Slots:
    """Places for pieces of one length: ranks from ``first`` on, ``each`` in a sequence, from ``offset`` on there."""

    length: int
    first: int
    count: int
    sequence: int
    each: int
    offset: int


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best-fit decreasing over counts.

    Lengths are placed from the longest down, always into the open sequences with the least room that fits. Sequences
    that were filled alike are one group (room, first sequence, number of them), so the work depends on the number of
    lengths and never on the number of pieces: a length splits at most one group, and every placement more than halves
    the room of its group, which bounds the plan by about ``44 * capacity`` rows.
    """
    plan: list[Slots] = []
    groups: list[tuple[int, int, int]] = []  # room, first sequence, sequences; ordered
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def place(room: int, sequence: int, many: int) -> int:
            """Fills the sequences of a group in turn; returns how many pieces found room."""
            each = room // length
            whole = min(many, (left - rank) // each)
            if whole:
                plan.append(Slots(length, rank, whole * each, sequence, each, capacity - room))
                if room - each * length:
                    insort(groups, (room - each * length, sequence, whole))
            placed, rest = whole * each, left - rank - whole * each
            if whole < many:
                if rest:
                    plan.append(Slots(length, rank + placed, rest, sequence + whole, rest, capacity - room))
                    insort(groups, (room - rest * length, sequence + whole, 1))
                    placed, whole = placed + rest, whole + 1
                if whole < many:
                    insort(groups, (room, sequence + whole, many - whole))
            return placed

        while rank < left:
            at = bisect_left(groups, (length, -1, -1))
            if at < len(groups):
                rank += place(*groups.pop(at))
            else:
                many = -(-(left - rank) // (capacity // length))
                opened += many
                rank += place(capacity, opened - many, many)
    return plan


def ranked(found: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """Adds ``rank``, 0, 1, ... among the pieces of the same length.

    Pieces are spread over blocks by a hash of their identity, ranked within (length, block), and moved by the number of
    pieces in earlier blocks of that length: a common length is never ranked in one task.
    """
    blocks = ranked_blocks(found.count(), per_block)
    keyed = found.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)))
    sizes = keyed.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    own = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    return (
        keyed.withColumn("own", F.row_number().over(own) - 1)
        .join(offsets, ["length", "block"])
        .withColumn("rank", F.col("own") + F.col("earlier"))
        .drop("block", "own", "earlier")
    )


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = 0, purpose: str = "packing"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece with its place in a sequence.

    The histogram of lengths (at most ``capacity`` rows) is planned on the driver; the plan, bounded likewise, goes to
    all tasks, and a piece finds its slot by its length and its rank within that length. Repeated rows are packed as
    often as they occur; an empty text is one piece with the end id; an empty table gives no rows.
    """
    spark = docs.sparkSession
    found = stored(pieces(docs, vocabulary, capacity, end), purpose)
    histogram = {r.length: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = [(s.length, s.first, s.first + s.count, s.sequence, s.each, s.offset) for s in best_fit(histogram, capacity)]
    slots = spark.createDataFrame(plan, "slot long, low long, high long, sequence long, each long, base long")
    placed = ranked(found).join(
        F.broadcast(slots), (F.col("length") == F.col("slot")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    )
    turn = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.expr("sequence + (rank - low) div each").alias("sequence_id"),
        (F.col("base") + turn % F.col("each") * F.col("length")).alias("offset"),
    )
