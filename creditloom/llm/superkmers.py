"""Words inside windows that occur more than once, by super-k-mers dealt to buckets by minimiser."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import discard, prepare, ranked_blocks, raw, slices, stored
from creditloom.llm.suffix import Words

LEAST = 35  # words of a window
RUN = 10  # words of a minimiser
#: Places of a minimiser beyond which its windows travel one by one, each to the bucket of its own digest.
CROWDED = 20_000
#: Packed strings that are sorted together.
PER_BIN = 5_000


class Spelled(Words):
    """The words of a text with the text itself, words joined by one space."""

    def __init__(self, data: bytes):
        self.text = b" ".join(data.split())
        super().__init__(self.text)

    def packed(self, first: int, end: int) -> bytes:
        return self.text[self.starts[first] : self.ends[end - 1]]


def minimisers(words: Words, least: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``least`` words the smallest digest among its runs of ``run`` words and the leftmost place of
    it, found for windows twice as wide in each step."""
    values = words.runs(run)
    places = np.arange(len(values))
    width, covered = least - run + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        smaller = values[step:] < values[:-step]
        values = np.where(smaller, values[step:], values[:-step])
        places = np.where(smaller, places[step:], places[:-step])
        covered += step
    return values, places


def _superkmers(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end (exclusive) of the runs of windows that share the place of their minimiser."""
    first = np.flatnonzero(np.diff(places, prepend=-1))
    return first, np.append(first[1:], len(places))


def _seeds(batches: Iterator[pa.RecordBatch], least: int, run: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows, found, twice = [], [], []
        for row, data in enumerate(raw(batch, "text")):
            words = Words(data)
            if words.n >= least:
                values, places = minimisers(words, least, run)
                own, times = np.unique(values[_superkmers(places)[0]], return_counts=True)
                found.append(own.view(np.int64))
                twice.append(times > 1)
                rows.append(np.full(len(own), row))
        if rows:
            at = np.concatenate(rows)
            keys = [pa.array(batch.column(k).to_numpy()[at]) for k in ("k1", "k2")]
            columns = [*keys, pa.array(np.concatenate(found)), pa.array(np.concatenate(twice))]
            yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "seed", "twice"])


def _strings(batches: Iterator[pa.RecordBatch], least: int, run: int) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
    for batch in slices(batches, 64):
        keys = zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist())
        for (k1, k2), data, alone, crowded in zip(keys, raw(batch, "text"), batch.column("alone"), batch.column("crowded")):
            words = Spelled(data)
            values, places = minimisers(words, least, run)
            first, end = _superkmers(places)
            live = np.isin(values[first], alone.values.to_numpy(zero_copy_only=False).view(np.uint64))
            spans = [(values[a], a, b) for a, b in zip(first[live].tolist(), end[live].tolist())]
            each = np.flatnonzero(np.isin(values, crowded.values.to_numpy(zero_copy_only=False).view(np.uint64)))
            spans += [(d, a, a + 1) for d, a in zip(words.runs(least, each), each.tolist())]
            if spans:
                key = np.array([s[0] for s in spans], np.uint64).view(np.int64)
                strings = [words.packed(a, b + least - 1) for _, a, b in spans]
                rest = [[k1] * len(spans), [k2] * len(spans), [s[1] for s in spans]]
                columns = [pa.array(c, k) for c, k in zip((key, strings, *rest), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "packed", "k1", "k2", "first"])


def _repeated(rows: pa.Table, least: int) -> pa.Table:
    """For each packed string the windows in it that occur more than once, as bits of a number."""
    numbers: dict[bytes, int] = {}
    split = [x.split(b" ") for x in rows.column("packed").to_pylist()]
    words = np.fromiter((numbers.setdefault(w, len(numbers)) for own in split for w in own), np.int32)
    sizes = np.array([len(own) for own in split])
    counts = sizes - least + 1
    row = np.repeat(np.arange(len(split)), counts)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = np.lib.stride_tricks.sliding_window_view(words, least)[(np.cumsum(sizes) - sizes)[row] + offset]
    as_bytes = np.ascontiguousarray(windows).view(np.dtype((np.void, 4 * least)))[:, 0]
    _, same, times = np.unique(as_bytes, return_inverse=True, return_counts=True)
    again = (times[same] > 1) | (rows.column("n").to_numpy()[row] > 1)
    # a string that occurs more than once repeats its windows wherever else they stand
    often = np.zeros(len(times), bool)
    often[same[again]] = True
    bits = np.where(often[same], np.int64(1) << offset, 0)
    mask = np.add.reduceat(bits, np.cumsum(counts) - counts)
    found = pa.table({"key": rows.column("key"), "digest": rows.column("digest"), "windows": pa.array(mask)})
    return found.filter(pa.array(mask != 0))


def _covered(marks: list[dict], n: int, least: int) -> np.ndarray:
    """Which of ``n`` words a repeated window covers."""
    starts = np.zeros(n + 1, np.int64)
    for mark in marks:
        bits, at = mark["windows"], mark["first"]
        while bits:
            low = (bits & -bits).bit_length() - 1
            starts[at + low] += 1
            starts[min(at + low + least, n)] -= 1
            bits &= bits - 1
    return np.cumsum(starts[:n]) > 0


def _kept(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        sizes, gone, kept, spans = [], [], [], []
        for data, copied, marks in zip(raw(batch, "text"), batch.column("copied").to_pylist(), batch.column("marks").to_pylist()):
            words = data.split()
            removed = np.full(len(words), True) if copied and len(words) >= least else _covered(marks or [], len(words), least)
            edges = np.flatnonzero(np.diff(removed, prepend=False, append=False)).tolist()
            sizes.append(len(words))
            gone.append(int(removed.sum()))
            kept.append(b" ".join(w for w, r in zip(words, removed.tolist()) if not r) if edges else b" ".join(words))
            spans.append([{"first_word": a, "n_words": b - a} for a, b in zip(edges[::2], edges[1::2])])
        span = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))
        columns = [
            batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
            pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "removed"])


def deduplicated(
    docs: DataFrame, least: int = LEAST, run: int = RUN, crowded: int = CROWDED, per_bin: int = PER_BIN, purpose: str = "superkmers"
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed): one row per row of ``docs``; ``kept`` is the text without each word
    that a window of ``least`` words covers whose words also start anywhere else, in another row or further on in the
    same one; ``removed`` lists the runs of words taken out. Words are what ASCII white space separates.

    1. Every window has a minimiser, the smallest digest of ``run`` words in it (leftmost on a tie). Windows that are
       equal have the same; so a minimiser that stands at a single place in a single text holds nothing repeated.
    2. Of the others, consecutive windows that share a minimiser at one place travel as one packed string of words to the
       bucket of that minimiser. Equal strings are combined before and in the shuffle, so that a passage of many
       documents costs one row per task. Where a minimiser has more than ``crowded`` places, each of its windows travels
       alone to the bucket of its own digest instead: no bucket grows beyond that, and none is left out.
    3. Buckets are gathered into bins of about ``per_bin`` strings; there all windows are sorted by their words and
       counted exactly. The answer, a bit for each window, goes back to the string's places by join.

    Texts that are equal as a whole are read once; all words of such copies with a window go. Digests only deal out work,
    but for the 128 bits that tell texts, and packed strings on the way back, apart. Null texts count as empty, null or
    repeated ids are rows like others, repeated rows are copies of each other, and an empty table gives no rows.
    """
    if least - run + 1 > 62 or run > least:
        raise ValueError("a window must hold 1 to 62 runs")
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    units = stored(rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("reader")), purpose)

    seeds = stored(
        rows.drop("doc_id").mapInArrow(partial(_seeds, least=least, run=run), "k1 long, k2 long, seed long, twice boolean"), purpose
    )
    shared = seeds.groupBy("seed").agg(
        *(f(k).alias(f"{f.__name__}_{k}") for k in ("k1", "k2") for f in (F.min, F.max)),
        F.max("twice").alias("twice"), F.count("*").alias("places"),
    ).where("min_k1 <> max_k1 or min_k2 <> max_k2 or twice").select("seed", (F.col("places") > crowded).alias("many"))
    live = (
        seeds.select("k1", "k2", "seed").join(shared, "seed").groupBy("k1", "k2")
        .agg(F.collect_set(F.expr("if(many, null, seed)")).alias("alone"), F.collect_set(F.expr("if(many, seed, null)")).alias("crowded"))
        .join(units.select("k1", "k2", "reader"), ["k1", "k2"])
    )
    live = stored(live, purpose)
    discard(seeds)
    one = live.select("alone", "crowded", "reader", F.col("k1").alias("u1"), F.col("k2").alias("u2"))
    strings = (
        rows.join(one, (rows.k1 == one.u1) & (rows.k2 == one.u2) & rows.doc_id.eqNullSafe(one.reader))
        .select("k1", "k2", "text", "alone", "crowded")
        .mapInArrow(partial(_strings, least=least, run=run), "key long, packed binary, k1 long, k2 long, first int")
        .withColumn("digest", F.xxhash64("packed"))
    )
    strings = stored(strings, purpose)
    discard(live)

    bins = ranked_blocks(strings.count(), per_bin)
    answers = (
        strings.groupBy("key", "packed").agg(F.count("*").alias("n"))
        .select(F.expr(f"pmod(xxhash64(key), {bins})").alias("bin"), "key", "packed", F.xxhash64("packed").alias("digest"), "n")
        .groupBy("bin").applyInArrow(lambda t: _repeated(t, least), "key long, digest long, windows long")
    )
    answers = stored(answers, purpose)
    marks = strings.select("key", "digest", "k1", "k2", "first").join(answers, ["key", "digest"]).select(
        "k1", "k2", F.struct("first", "windows").alias("mark"), F.lit(False).alias("copied")
    )
    copies = units.where("n > 1").select(
        "k1", "k2", F.lit(None).cast("struct<first:int,windows:bigint>").alias("mark"), F.lit(True).alias("copied")
    )
    marked = stored(
        marks.union(copies).groupBy("k1", "k2").agg(F.collect_list("mark").alias("marks"), F.max("copied").alias("copied")), purpose
    )
    discard(strings, answers, units)
    kinds = "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first_word:bigint,n_words:bigint>>"
    return rows.join(marked, ["k1", "k2"], "left").select("doc_id", "text", "copied", "marks").mapInArrow(
        partial(_kept, least=least), kinds
    )
