"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import prepare, raw, slices, sorted_join, stored
from creditloom.llm.graph import components

#: Buckets up to this many fingerprints are compared pair by pair, larger ones by finer variants.
PAIRWISE = 48
SEED = 42


def simhash(data: bytes, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint of a text: the majority of each bit over the hashes of its word shingles.

    A-Z are lower-cased; words are what ASCII white space separates. With fewer words than a shingle takes, the whole
    sequence is the one shingle; without words the fingerprint is zero.
    """
    tokens = data.lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = np.array([simhash(x) for x in raw(batch, "text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long; null texts count as empty."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def _half(at: str) -> str:
    return f"if({at} < 32, shiftrightunsigned(fp, 32), fp & 4294967295L)"


def links(prints: DataFrame, purpose: str = "simhash") -> DataFrame:
    """(u, v): links between distinct fingerprints (column fp), which connect all that differ in at most two bits.

    Cut into two halves, one half differs by at most one bit. Every fingerprint is indexed under its 64 one-wildcard
    variants of a half; equal variants meet in a join that verifies the distance and accepts each pair under one variant
    only. In a bucket of over ``PAIRWISE`` fingerprints the pairs are not formed: its rows are indexed again under two
    wildcards, where at most four fingerprints can meet, all within two bits of each other; these are linked to the
    smallest. So no pair is lost, and the work per fingerprint is bounded however large the group of near copies.
    """
    distinct = prints.select("fp").where("fp is not null").distinct()
    variants = distinct.select("fp", F.explode(F.expr("sequence(0, 63)")).alias("t")).select(
        "fp", F.expr(f"shiftleft(cast(t as long), 32) | ({_half('t')} & ~shiftleft(1L, t % 32))").alias("key")
    )
    buckets = variants.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    live = stored(sorted_join(variants).join(buckets, "key"), purpose)

    few = live.where(F.col("n") <= PAIRWISE)
    other = few.select("key", F.col("fp").alias("fp2"))
    high, low = "shiftrightunsigned(fp ^ fp2, 32)", "((fp ^ fp2) & 4294967295L)"
    first = (
        f"if(bit_count({high}) <= 1, if({high} = 0, 0, bit_count({high} - 1)), "
        f"32 + if({low} = 0, 0, bit_count({low} - 1)))"
    )
    met = sorted_join(few).join(other, "key").where(
        f"fp < fp2 and bit_count(fp ^ fp2) <= 2 and shiftrightunsigned(key, 32) = {first}"
    )
    pairs = met.select(F.col("fp").alias("u"), F.col("fp2").alias("v"))

    crowd = live.where(F.col("n") > PAIRWISE).select("fp", F.expr("cast(shiftrightunsigned(key, 32) as int)").alias("t"))
    # the wildcard of the shared half and one in the other half
    mixed = crowd.select(
        "fp", F.expr("if(t < 32, t + 32, t - 32)").alias("p"), F.explode(F.expr("sequence(0, 31)")).alias("i")
    ).select("fp", "p", F.expr("if(p < 32, i + 32, i)").alias("q"))
    # where the shared half is equal: two wildcards in the other half
    same = crowd.where("t % 32 = 0").select(
        "fp", F.expr("if(t < 32, 0, 32)").alias("base"), F.explode(F.expr("sequence(0, 1023)")).alias("i")
    ).where("i div 32 < i % 32").select("fp", F.expr("cast(base + i div 32 as int)").alias("p"), F.expr("base + i % 32").alias("q"))
    fine = mixed.union(same).select(
        "fp", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")
    ).select("fp", "p", "q", F.expr("fp & ~shiftleft(1L, p) & ~shiftleft(1L, q)").alias("masked"))
    stars = (
        fine.groupBy("p", "q", "masked").agg(F.sort_array(F.collect_set("fp")).alias("all")).where("size(all) > 1")
        .select(F.expr("all[0]").alias("u"), F.explode(F.expr("slice(all, 2, size(all) - 1)")).alias("v"))
    )
    return pairs.union(stars)


def near_duplicates(docs: DataFrame, purpose: str = "simhash") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, itself included. Rows without doc_id have a fingerprint
    but are in no component. Rows that repeat a doc_id each have their own fingerprint. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs), purpose)
    classes = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), purpose)
    found = links(classes, purpose)
    by_rep = (
        found.join(sorted_join(classes.select(F.col("fp").alias("u"), F.col("rep").alias("a"))), "u")
        .join(sorted_join(classes.select(F.col("fp").alias("v"), F.col("rep").alias("b"))), "v")
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    reached = components(by_rep, purpose)
    known = sorted_join(classes).join(reached, classes.rep == reached.node, "left").select(
        F.col("fp").alias("print"), F.coalesce("component", "rep").alias("component_id")
    )
    return sorted_join(prints).join(known, (prints.fp == known.print) & prints.doc_id.isNotNull(), "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
