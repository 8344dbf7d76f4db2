"""Repeated passages: windows of words around minimiser positions, grouped by digest and joined to passages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import discard, prepare, raw, slices, stored

LEAST = 50  # words of a passage
SEED = 16  # words that a suffix is first compared by
MULTIPLIER = 0x9E3779B97F4A7C15  # odd
LETTERS = np.random.default_rng(2024).integers(0, 2**64, 256, np.uint64)
SPACE = 32


class _Powers:
    """Powers of a number modulo 2^64, as many as have been asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            out = np.full(max(n, 2 * len(self.table)), self.base, np.uint64)
            out[0] = 1
            self.table = np.multiply.accumulate(out)
        return self.table[:n]


POWERS, INVERSE = _Powers(MULTIPLIER), _Powers(pow(MULTIPLIER, -1, 2**64))


class Words:
    """The words of a text (cut at ASCII white space) and digests of any run of them."""

    def __init__(self, data: bytes):
        text = b" ".join(data.split())
        codes = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero(codes == SPACE)
        self.n = len(gaps) + 1 if len(codes) else 0
        self.starts = np.concatenate([[0], gaps + 1])
        self.ends = np.concatenate([gaps, [len(codes)]])
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(LETTERS[codes] * POWERS.upto(len(codes)), out=self.sums[1:])

    def runs(self, length: int, first: np.ndarray | None = None) -> np.ndarray:
        """Digests of the runs of ``length`` words that start at ``first``, by default at every word that has one.

        A polynomial over random numbers for bytes, taken from running sums and divided by the power of its place.
        """
        if first is None:
            first = np.arange(self.n - length + 1)
        a, b = self.starts[first], self.ends[first + length - 1]
        return _mixed((self.sums[b] - self.sums[a]) * INVERSE.upto(len(self.sums))[a])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the digest over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(words: Words, least: int = LEAST, seed: int = SEED) -> np.ndarray:
    """For every window of ``least`` words the smallest digest of the runs of ``seed`` words in it.

    The places of these minima depend on the words alone, so a passage of ``least`` words or more that occurs again has
    the same ones there: their suffixes are the only ones retained.
    """
    return _sliding_min(words.runs(seed), least - seed + 1)


def _seeds(batches: Iterator[pa.RecordBatch], least: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        own, found, twice = [], [], []
        for doc, data in zip(batch.column("doc").to_pylist(), raw(batch, "text")):
            words = Words(data)
            if words.n >= least:
                found.append(np.unique(minimisers(words, least, seed)))
                runs, times = np.unique(words.runs(seed), return_counts=True)
                twice.append(times[np.searchsorted(runs, found[-1])] > 1)
                own.append(np.full(len(found[-1]), doc, np.int64))
        if found:
            columns = [pa.array(np.concatenate(x)) for x in (own, [f.view(np.int64) for f in found], twice)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "seed", "twice"])


def _windows(batches: Iterator[pa.RecordBatch], least: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        own, place, digest = [], [], []
        for doc, data, seeds in zip(batch.column("doc").to_pylist(), raw(batch, "text"), batch.column("seeds")):
            words = Words(data)
            live = seeds.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.flatnonzero(np.isin(minimisers(words, least, seed), live))
            own.append(np.full(len(at), doc, np.int64))
            place.append(at.astype(np.int32))
            digest.append(words.runs(least, at).view(np.int64))
        columns = [pa.array(np.concatenate(x)) for x in (own, place, digest)]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "place", "digest"])


def _spans(places: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Windows that follow each other without a gap in the words they cover, joined: (first word, words)."""
    if not len(places):
        return []
    breaks = np.flatnonzero(np.diff(places) > least) + 1
    groups = np.split(places, breaks)
    return [(int(g[0]), int(g[-1] - g[0]) + least) for g in groups]


def _joined(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows: list[tuple[int, int, int, bool]] = []
        for doc, later, first in zip(batch.column("doc").to_pylist(), batch.column("later"), batch.column("first")):
            for places, removed in ((later, True), (first, False)):
                own = np.sort(places.values.to_numpy(zero_copy_only=False))
                rows += [(doc, at, n, removed) for at, n in _spans(own, least)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "first_word", "n_words", "removed"])


def repeats(
    docs: DataFrame, least: int = LEAST, seed: int = SEED, purpose: str = "suffix", within: bool = False
) -> DataFrame:
    """(doc_id, first_word, n_words, removed): passages of ``least`` words or more that other documents hold too.

    A window of ``least`` words counts as repeated if a document with another id holds the same words; ``removed`` tells
    whether one with a smaller id does. Windows of one kind that touch are one passage. So for every repeated word
    sequence one document, that with the smallest id, keeps it.

    ``within`` counts repeats inside one document too: the first place in the document with the smallest id keeps the
    window, with what overlaps it there; each other place, in that document or another, is removed.

    1. Seeds, the ``seed`` words at minimiser positions (about one in eighteen), are grouped by digest; those that stand
       at one place only are dropped.
    2. Of the windows of ``least`` words whose minimiser is left, equal ones are grouped by digest. Equal windows have the
       same minimiser, so no repeat is missed.
    3. Neighbouring windows of a document are joined to maximal passages.

    Of identical texts only the smallest and the largest id are worked on; the other copies share the latter's result.
    Digests have 64 bits. Null texts and texts of fewer than ``least`` words have no passages. Rows without doc_id, and
    rows of a doc_id that stands for different texts, are left out: nothing is reported for them. Repeated rows count as
    one document.
    """
    prepare(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    text_keys = rows.select("id", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    ids = text_keys.groupBy("id").agg(*(f(k).alias(n) for k in ("k1", "k2") for f, n in ((F.min, k), (F.max, k + "_"))))
    ids = stored(ids.where("k1 = k1_ and k2 = k2_").select("id", "k1", "k2"), purpose)
    copies = ids.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    units = stored(
        ids.join(copies, ["k1", "k2"]).select("id", F.expr("if(id = least, least, most)").alias("unit")), purpose
    )

    texts = rows.withColumnRenamed("id", "doc")
    seeds = stored(texts.mapInArrow(partial(_seeds, least=least, seed=seed), "doc long, seed long, twice boolean"), purpose)
    shared = (
        seeds.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("twice").alias("twice"))
        .where("a <> b or twice" if within else "a <> b").select("seed")
    )
    own = units.where("id = unit").select(F.col("unit").alias("doc"))
    live = stored(
        seeds.join(shared, "seed").join(own, "doc").groupBy("doc").agg(F.collect_set("seed").alias("seeds")), purpose
    )
    discard(seeds)

    found = texts.join(live, "doc").mapInArrow(
        partial(_windows, least=least, seed=seed), "doc long, place int, digest long"
    )
    windows = stored(found, purpose)
    discard(live)
    # stored, so that a common window's many places can be dealt to several tasks of the join
    place = "place" if within else "0"
    places = F.expr(f"struct(doc, {place} as place)")
    again = stored(
        windows.groupBy("digest").agg(F.min(places).alias("holder"), F.max(places).alias("last"))
        .where(f"holder.doc <> last.doc or last.place - holder.place >= {least}").select("digest", "holder"), purpose
    )
    removed = f"(doc > holder.doc or {place} - holder.place >= {least})"
    met = windows.join(again, "digest").groupBy("doc").agg(
        F.collect_set(F.expr(f"if({removed}, place, null)")).alias("later"),
        F.collect_set(F.expr(f"if({removed}, null, place)")).alias("first"),
    )
    passages = stored(
        met.mapInArrow(partial(_joined, least=least), "doc long, first_word long, n_words long, removed boolean"), purpose
    )
    discard(windows, again)
    return units.join(passages, units.unit == passages.doc).select(
        F.col("id").alias("doc_id"), "first_word", "n_words", "removed"
    )


WORD = re.compile(rb"[^\x09-\x0d\x20]+")


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given runs of words and the white space after each."""
    starts = [m.start() for m in WORD.finditer(data)] + [len(data)]
    kept, at = [], 0
    for first, n in sorted(spans):
        kept.append(data[at : starts[first]])
        at = starts[first + n]
    kept.append(data[at:])
    return b"".join(kept).rstrip()


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], own_spans: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        spans = batch.column(own_spans).to_pylist()
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        new = [without(t, [(s["first_word"], s["n_words"]) for s in own]) if own and t else t for t, own in zip(texts, spans)]
        keep = pa.array([not own or bool(t) for t, own in zip(new, spans)], pa.bool_())
        columns = {n: batch.column(n) for n in names}
        columns["text"] = pa.array(new, pa.binary()).cast(columns["text"].type)
        if "n_chars" in columns:
            sizes = [len(t.decode()) if own and t else n for t, own, n in zip(new, spans, columns["n_chars"].to_pylist())]
            columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names).filter(keep)


def deduplicated(docs: DataFrame, least: int = LEAST, purpose: str = "suffix", within: bool = False) -> DataFrame:
    """``docs`` with all its columns, without the passages that a document with a smaller id holds too; with ``within``
    also without those that stand earlier in the same document.

    ``n_chars``, where there is such a column, follows the text. Documents of which nothing is left go; documents without
    repeated passages stay as they are.
    """
    own_id, own_spans = (n + "_" * max(map(len, docs.columns)) for n in ("id", "spans"))  # longer than any column's name
    spans = (
        repeats(docs, least, purpose=purpose, within=within).where("removed").groupBy(F.col("doc_id").alias(own_id))
        .agg(F.collect_list(F.struct("first_word", "n_words")).alias(own_spans))
    )
    joined = docs.join(spans, docs.doc_id == spans[own_id], "left").drop(own_id)
    return joined.mapInArrow(partial(_cut, names=docs.columns, own_spans=own_spans), docs.schema)
