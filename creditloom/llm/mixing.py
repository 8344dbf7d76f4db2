"""Language-model scores by online logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import ceil, log, log10, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import crc_of_id, prepare, raw, slices, stored
from creditloom.llm.suffix import INVERSE, POWERS

END, START = 0xFF, 0xFE  # bytes that UTF-8 never has: the end of a text, and what stands before it
CLASSES = 64  # the most frequent bytes have a class each, the others share the last one
RARE = CLASSES - 1
ROWS = (1 << 16, 1 << 16, 1 << 18)  # rows of each predictor's table: 3 bytes, 5 bytes, the word so far; the first and last with a hint at the language
LEAD = 8  # start bytes before each text
SEGMENT = 1 << 16  # longer texts are scored in parts of this many bytes
TOGETHER = 1 << 18  # bytes worked on at once
LANES = 32  # parts of texts mixed side by side
BLOCK_ROWS = 1 << 12  # table rows whose counts are summed in one group
CHUNK = 512  # bytes predicted between two steps of learning
GATES = 6  # letters of the word so far
WEIGHTS = (0.35, 0.25, 0.4)  # before anything is learned from a text
RATE = 0.002
BUCKETS = 33
PRIOR, DOUBT = 0.03, 0.5  # added to counts; how much evidence makes a predictor half trusted
QUANTUM = 12.0  # log odds are kept as whole numbers of 1/12
#: Most tokens that are looked up in memory; those with at least 1/HEAVY of all occurrences, so there can be no more.
HEAVY = 500_000
TOKENS_HELD = 200_000  # distinct tokens that a task counts before it hands them on; before they are summed, twice as many
TABLES_HELD = 500  # tables of tokens that are summed at the latest
LN10 = log(10)
END_TOKEN = b"\n"  # no word has white space
FOLD, HELD_OUT = 7, 2


# --- bytes, classes and the binary code over classes


@dataclass
class Code:
    """Classes of bytes, and for each class its way through a binary tree: which nodes, and left or right."""

    classes: np.ndarray  # of every byte
    nodes: np.ndarray  # ways one after the other
    bits: np.ndarray
    first: np.ndarray  # of every class, in nodes
    length: np.ndarray
    rare: np.ndarray  # log10 of the shares of the bytes in the last class


def make_code(histogram: np.ndarray) -> Code:
    """Huffman's code for the classes of the most frequent bytes; every byte can be written, seen or not."""
    count = histogram.astype(np.int64) + 1
    order = np.lexsort((np.arange(256), -count))
    order = order[order != START]
    classes = np.full(256, RARE, np.uint8)
    classes[order[:RARE]] = np.arange(RARE)
    own = np.bincount(classes, weights=count, minlength=CLASSES).astype(np.int64)
    heap: list[tuple[int, int, object]] = [(int(c), k, k) for k, c in enumerate(own)]
    heapq.heapify(heap)
    inner = CLASSES
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], inner, (a[2], b[2])))
        inner += 1
    ways: dict[int, list[tuple[int, int]]] = {}
    names = iter(range(CLASSES))

    def walk(tree: object, way: list[tuple[int, int]]) -> None:
        if isinstance(tree, int):
            ways[tree] = way
            return
        node = next(names)
        for bit in (0, 1):
            walk(tree[bit], [*way, (node, bit)])

    walk(heap[0][2], [])
    flat = [step for k in range(CLASSES) for step in ways[k]]
    length = np.array([len(ways[k]) for k in range(CLASSES)])
    rare = np.full(256, -np.inf)
    last = (classes == RARE) & (np.arange(256) != START)
    rare[last] = np.log10(count[last] / count[last].sum())
    return Code(
        classes, np.array([n for n, _ in flat], np.int32), np.array([b for _, b in flat], np.uint8),
        np.concatenate([[0], np.cumsum(length)[:-1]]), length, rare,
    )


def parts_of(texts: list[bytes]) -> list[tuple[int, bytes]]:
    """Texts with A-Z in lower case and the end byte behind, in parts of bounded length, each with its text's number."""
    out = []
    for i, text in enumerate(texts):
        whole = text.lower() + bytes([END])
        out += [(i, whole[at : at + SEGMENT]) for at in range(0, len(whole), SEGMENT)]
    return out


def together(parts: list[tuple[int, bytes]], most: int) -> Iterator[list[tuple[int, bytes]]]:
    """Neighbouring parts, up to ``most`` of them and ``TOGETHER`` bytes."""
    group, size = [], 0
    for part in parts:
        if group and (len(group) == most or size + len(part[1]) > TOGETHER):
            yield group
            group, size = [], 0
        group.append(part)
        size += len(part[1])
    if group:
        yield group


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Parts one after the other, each with start bytes before it; where each begins and ends."""
    lead = bytes([START]) * LEAD
    codes = np.frombuffer(b"".join(lead + p for p in parts), np.uint8)
    sizes = np.array([len(p) + LEAD for p in parts])
    stops = np.cumsum(sizes)
    return codes, np.stack([stops - sizes + LEAD, stops], axis=1)


def context_rows(codes: np.ndarray, code: Code, start: np.ndarray) -> list[np.ndarray]:
    """For every byte the row of each predictor's table that its context selects. ``start`` is where its word begins."""
    cls = np.frombuffer(codes.tobytes().translate(code.classes.tobytes()), np.uint8)
    before = np.zeros(len(codes) + 1, np.uint32)  # classes of the three bytes up to each
    before[1:] = cls
    before[2:] |= cls[:-1] * np.uint32(1 << 6)
    before[3:] |= cls[:-2] * np.uint32(1 << 12)
    three = before[:-1]
    five = three.copy()
    five[3:] |= (three[:-3] & np.uint32(0xFFF)) << np.uint32(18)
    # digest of the bytes since the last white space or start; the last byte beyond ASCII hints at the language
    sums = np.zeros(len(codes) + 1, np.uint64)
    word = codes.astype(np.uint64)
    word += np.uint64(1)
    word *= POWERS.upto(len(codes))
    np.cumsum(word, out=sums[1:])
    np.subtract(sums[:-1], sums.take(start), out=word)
    word *= INVERSE.upto(len(codes) + 1).take(start)
    far = np.flatnonzero(codes[:-1] >= 128)
    hint = np.repeat(np.append(codes[:1], codes[far]), np.diff(far + 1, prepend=0, append=len(codes))).astype(np.uint32)
    hint[0] = 0
    word ^= word >> np.uint64(29)
    word += hint * np.uint64(0x9E3779B97F4A7C15)
    word ^= word >> np.uint64(32)
    word *= np.uint64(0xBF58476D1CE4E5B9)
    word >>= np.uint64(46)
    hinted = hint * np.uint32(0xC2B2AE35)
    hinted += three
    hinted *= np.uint32(0x9E3779B1)
    five *= np.uint32(0x85EBCA6B)
    return [(hinted >> np.uint32(16)).astype(np.int32), (five >> np.uint32(16)).astype(np.int32), word.astype(np.int32)]


def word_starts(codes: np.ndarray) -> np.ndarray:
    """For every byte where the word begins that it would go on with."""
    after = np.flatnonzero((codes[:-1] <= 32) | (codes[:-1] >= START)) + 1
    return np.repeat(np.append(0, after), np.diff(after, prepend=0, append=len(codes)))


# --- learning: counts of tokens, of bytes, and of classes by context


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and number of every token of the texts, ends included and last, and the distinct tokens that have these numbers."""
    texts = batch.column("text").cast(pa.binary()).fill_null(b"").view(pa.string())
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    rows = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    distinct, numbers = coded.dictionary.view(pa.binary()), coded.indices.to_numpy()
    nothing = distinct.index(b"").as_py()  # stands before and behind white space at a text's edges
    if nothing >= 0:
        rows, numbers = rows[numbers != nothing], numbers[numbers != nothing]
    ends = np.arange(len(words))
    return (
        np.concatenate([rows, ends]), np.concatenate([numbers.astype(np.int64), np.full(len(ends), len(distinct))]),
        pa.concat_arrays([distinct, pa.array([END_TOKEN], pa.binary())]),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and bytes with their numbers, summed over the task's texts as far as memory allows."""
    tokens: list[pa.Table] = []
    held = 0
    histogram = np.zeros(256, np.int64)

    def merged() -> pa.Table:
        own = pa.concat_tables(tokens).group_by("token", use_threads=False).aggregate([("n", "sum")])
        return own.select(["token", "n_sum"]).rename_columns(["token", "n"])

    def told(own: pa.Table) -> Iterator[pa.RecordBatch]:
        seen = np.flatnonzero(histogram)
        bytes_seen = [pa.nulls(len(seen), pa.binary()), pa.array(seen, pa.int32()), pa.array(histogram[seen], pa.int64())]
        yield pa.RecordBatch.from_arrays(bytes_seen, ["token", "byte", "n"])
        for batch in own.to_batches():
            number = pa.array(np.full(batch.num_rows, -1), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), number, batch.column(1)], ["token", "byte", "n"])

    for batch in slices(batches):
        _, numbers, distinct = _tokens(batch)
        n = np.bincount(numbers, minlength=len(distinct))
        tokens.append(pa.table({"token": distinct, "n": pa.array(n, pa.int64())}).filter(pa.array(n > 0)))
        for text in raw(batch, "text"):
            histogram += np.bincount(np.frombuffer(text.lower(), np.uint8), minlength=256)
            histogram[END] += 1
        held += tokens[-1].num_rows
        if held > 2 * TOKENS_HELD or len(tokens) > TABLES_HELD:
            tokens = [merged()]
            held = tokens[0].num_rows
            if held > TOKENS_HELD:
                yield from told(tokens.pop())
                held, histogram[:] = 0, 0
    if tokens:
        yield from told(merged())


def _learned(batches: Iterator[pa.RecordBatch], code: Code) -> Iterator[pa.RecordBatch]:
    """Counts of this task's texts, in blocks."""
    flat = np.zeros(sum(ROWS) * CLASSES, np.uint32)
    tables = np.split(flat, np.cumsum(ROWS)[:-1] * CLASSES)
    seen, task = False, 0
    for batch in slices(batches):
        for group in together(parts_of(raw(batch, "text")), 10**6):
            codes, spans = joined([p for _, p in group])
            seen, task = True, zlib.crc32(codes[:4096].tobytes(), task)
            scored = np.concatenate([np.arange(a, b) for a, b in spans])
            cls = code.classes[codes[scored]].astype(np.intp)
            ones = np.ones(len(scored), np.uint32)
            for counts, rows in zip(tables, context_rows(codes, code, word_starts(codes))):
                np.add.at(counts, rows[scored] * CLASSES + cls, ones)
    size = BLOCK_ROWS * CLASSES
    for k in range(len(flat) // size if seen else 0):
        part = flat[k * size : (k + 1) * size]
        if part.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([task], pa.int64()), pa.array([_packed(part)], pa.binary())],
                ["block", "task", "counts"],
            )


def _packed(counts: np.ndarray) -> bytes:
    """A bit for each of a block's counts that isn't zero, then these as one byte each; those over 254 follow whole."""
    own = counts[counts > 0]
    small = np.minimum(own, 255).astype(np.uint8)
    return np.packbits(counts > 0).tobytes() + small.tobytes() + own[small == 255].astype("<u8").tobytes()


def _total(table: pa.Table) -> np.ndarray:
    size = BLOCK_ROWS * CLASSES
    total = np.zeros(size, np.uint64)
    for data in table.column("counts"):
        own = data.as_py()
        at = np.flatnonzero(np.unpackbits(np.frombuffer(own, np.uint8, size // 8)).view(bool))
        small = np.frombuffer(own, np.uint8, len(at), size // 8)
        counts = small.astype(np.uint64)
        counts[small == 255] = np.frombuffer(own[size // 8 + len(at) :], "<u8")
        total[at] += counts
    return total


def _summed(table: pa.Table, code: Code | None) -> pa.Table:
    """The sum of a block's counts; with a code, the predictors made of it."""
    total = _total(table)
    data = _packed(total) if code is None else predictors(total, code).tobytes()
    return pa.table(
        {
            "block": table.column("block")[:1].cast(pa.int32()), "task": pa.array([0], pa.int64()),
            "counts": pa.array([data], pa.binary()),
        }
    )


def predictors(counts: np.ndarray, code: Code) -> np.ndarray:
    """Log odds of the right branch at every node of every row, shrunk towards 0 where little was seen, as small integers."""
    own = counts.reshape(-1, CLASSES).astype(np.float64)
    steps = np.repeat(np.arange(CLASSES), code.length)
    sides = []
    for bit in (0, 1):
        to = np.zeros((CLASSES, CLASSES))
        take = code.bits == bit
        to[steps[take], code.nodes[take]] = 1
        sides.append(own @ to)
    seen = sides[0] + sides[1]
    odds = np.log((sides[1] + PRIOR) / (sides[0] + PRIOR)) * (seen / (seen + DOUBT))
    return np.clip(np.rint(odds * QUANTUM), -127, 127).astype(np.int8).ravel()


# --- mixing


@dataclass
class Mixer:
    code: Code
    tables: list[np.ndarray]

    def scores(self, texts: list[bytes]) -> list[float]:
        """log10 probability of each text with its end. Parts of like length are mixed side by side, so that few steps have
        parts that ended before."""
        out = np.zeros(len(texts))
        for group in together(sorted(parts_of(texts), key=lambda p: len(p[1])), LANES):
            np.add.at(out, [i for i, _ in group], self._mixed([p for _, p in group]))
        return out.tolist()

    def _mixed(self, parts: list[bytes]) -> np.ndarray:
        """log10 probability of each part.

        Bit by bit along the code's ways: the predictors' log odds are weighed by the gate's weights and added up; a
        refinement table, also learned as the text goes on, corrects the result. Every part starts with the same weights
        and learns from its own past only, in steps of ``CHUNK`` bytes. Parts are done side by side but do not touch.
        """
        codes, spans = joined(parts)
        code, many, sizes = self.code, len(parts), spans[:, 1] - spans[:, 0]
        start = word_starts(codes)
        own = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        place = own + np.repeat(np.cumsum(sizes) - sizes + LEAD * np.arange(1, many + 1), sizes).astype(np.int32)
        # bytes in order of step, then of part, then of gate: those that use and change the same weights are one run
        run = own // np.int32(CHUNK) * np.int32(many * GATES) + np.repeat(np.arange(many, dtype=np.int32) * GATES, sizes)
        run += np.minimum(place - start.take(place), np.int32(GATES - 1))
        order = np.argsort(run.astype(np.min_scalar_type(run.max())), kind="stable")
        run, scored = run.take(order), place.take(order)
        first = np.concatenate([[0], np.flatnonzero(run[1:] != run[:-1]) + 1, [len(run)]])
        slots = run[first[:-1]]
        steps = np.searchsorted(slots, np.arange(-(-sizes.max() // CHUNK) + 1) * (many * GATES))
        slots %= many * GATES

        cls = code.classes.take(codes.take(scored))
        length = code.length.take(cls)
        bit_at = np.concatenate([[0], np.cumsum(length)])
        to_way = code.first.take(cls) - bit_at[:-1]  # added to a bit's number: its place in the code's ways
        ways = (code.nodes * 2 + code.bits).astype(np.uint8)
        tables = [t.reshape(-1, CLASSES) for t in self.tables]
        rows = [r.take(scored) for r in context_rows(codes, code, start)]

        half = BUCKETS // 2
        weights = [np.full(many * GATES, w, np.float32) for w in WEIGHTS]
        hits = np.tile(4 / (1 + np.exp(-(np.arange(BUCKETS) - half) / 2)), many)
        tries = np.full(many * BUCKETS, 4.0)
        total = np.zeros(many)
        for a, b in zip(steps, steps[1:]):
            runs, slot = first[a : b + 1], slots[a:b]
            edges = bit_at[runs]
            starts, n = edges[:-1] - edges[0], np.diff(edges)
            chunk = slice(runs[0], runs[-1])
            # each byte's rows are fetched whole, once; its bits are then found at the same places for all predictors
            pair = np.stack([to_way[chunk], np.arange(runs[-1] - runs[0]) * CLASSES], axis=1)
            pair = np.repeat(pair.view(np.complex128).ravel(), length[chunk]).view(np.int64).reshape(-1, 2)  # spread as one
            way = ways.take(pair[:, 0] + np.arange(edges[0], edges[-1]), mode="clip")
            y, at = way & 1, pair[:, 1] + (way >> 1)
            near = (t.take(r[chunk], axis=0) for t, r in zip(tables, rows))
            x = [t.take(at, mode="clip") * np.float32(1 / QUANTUM) for t in near]
            z = x[0] * np.repeat(weights[0][slot], n)
            for w, i in zip(weights[1:], x[1:]):
                z += i * np.repeat(w[slot], n)
            np.clip(z, -8, 8, out=z)
            p = np.negative(z)
            np.exp(p, out=p)
            p += 1
            np.divide(1, p, out=p)
            z *= 2
            z += np.float32(half + 0.5)
            bucket = z.astype(np.int32) + np.repeat((slot // GATES * BUCKETS).astype(np.int32), n)
            q = (0.4 * hits / tries).astype(np.float32).take(bucket)
            q += np.float32(0.6) * p
            np.clip(q, 1e-5, 1 - 1e-5, out=q)
            q -= 1 - y  # so its amount is the probability of the branch taken
            sure = np.log(np.abs(q, out=q), out=q)
            total += np.bincount(slot // GATES, weights=np.add.reduceat(sure, starts, dtype=np.float64), minlength=many) / LN10
            error = y - p
            for w, i in zip(weights, x):
                i *= error
                w[slot] += RATE * np.add.reduceat(i, starts)
            met = np.bincount(2 * bucket + y, minlength=2 * len(hits)).reshape(-1, 2)
            hits += met[:, 1]
            tries += met[:, 0] + met[:, 1]
        rare = np.flatnonzero(cls == RARE)
        lane = np.searchsorted(spans[:, 1], scored[rare], side="right")
        return total + np.bincount(lane, weights=code.rare[codes[scored[rare]]], minlength=many)


# --- the whole table


def _scored(batches: Iterator[pa.RecordBatch], mixer, heavy, scale: float) -> Iterator[pa.RecordBatch]:
    """Scores, and the tokens that are not looked up in memory; rows are numbered within the task."""
    model, known = mixer.value, heavy.value
    first = TaskContext.get().partitionId() << 40
    for batch in slices(batches):
        texts = raw(batch, "text")
        rows, numbers, distinct = _tokens(batch)
        count = np.array([known.get(word, 0) for word in distinct.to_numpy(zero_copy_only=False).tolist()])
        value = np.where(count > 0, np.log10((count + 1) / scale), 0.0)
        n_tokens = np.bincount(rows, minlength=len(texts))
        n_known = np.bincount(rows[count[numbers] > 0], minlength=len(texts))
        base = np.bincount(rows, weights=value[numbers], minlength=len(texts))
        unmet = count[numbers] == 0
        pairs, n = np.unique(rows[unmet] * len(distinct) + numbers[unmet], return_counts=True)
        offsets = np.searchsorted(pairs, np.arange(len(texts) + 1) * len(distinct))
        rest = pa.StructArray.from_arrays([distinct.take(pa.array(pairs % len(distinct))), pa.array(n, pa.int64())], ["token", "n"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(first, first + len(texts)), pa.int64()), batch.column("doc_id"), batch.column("held_out"),
                pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                pa.array(model.scores(texts), pa.float64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest),
            ],
            ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "bytes", "rest"],
        )
        first += len(texts)


def _model(training: DataFrame, histogram: np.ndarray, tasks: int) -> Mixer:
    """Predictors from all training texts. Tables have a fixed size; every task's counts are summed in two steps, so that
    a group never has more rows than the square root of the number of tasks."""
    code = make_code(histogram)
    kind = "block int, task long, counts binary"
    counts = training.select("text").mapInArrow(partial(_learned, code=code), kind)
    groups = max(1, ceil(sqrt(tasks)))
    some = counts.groupBy("block", F.pmod("task", F.lit(groups)).alias("part")).applyInArrow(lambda t: _summed(t, None), kind)
    rows = some.groupBy("block").applyInArrow(lambda t: _summed(t, code), kind).collect()
    flat = np.zeros(sum(ROWS) * CLASSES, np.int8)
    size = BLOCK_ROWS * CLASSES
    for r in rows:
        flat[r.block * size : (r.block + 1) * size] = np.frombuffer(r.counts, np.int8)
    return Mixer(code, np.split(flat, np.cumsum(ROWS)[:-1] * CLASSES))


def score(docs: DataFrame, purpose: str = "mixing") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte): one row per row.

    Learns from the rows whose id's CRC-32 has a remainder other than ``HELD_OUT`` by ``FOLD``; rows without an id are
    among them. ``base_score`` adds up log10((c + 1) / (N + V + 1)) over a text's tokens and its end: c is the token's
    number in the training rows, N that of all and V that of distinct ones. ``score`` is the mixing model's log10
    probability of the text's bytes (A-Z in lower case) and its end, ``bits_per_byte`` the same as bits by length.

    Token counts are a table. Tokens with at least 1 / ``HEAVY`` of all occurrences, of which there can be at most
    ``HEAVY``, are looked up in memory; the others are joined. Null texts count as empty; repeated rows have the same
    result; without training rows every token is unknown and the predictors are silent.
    """
    spark = docs.sparkSession
    prepare(spark)
    held = F.coalesce(crc_of_id() % FOLD == HELD_OUT, F.lit(False))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out")
    )
    training = rows.where(~F.col("held_out"))
    counted = training.select("text").mapInArrow(_counted, "token binary, byte int, n long")
    counts = stored(counted.groupBy("token", "byte").agg(F.sum("n").alias("c")), purpose)
    histogram = np.zeros(256, np.int64)
    for r in counts.where("token is null").collect():
        histogram[r.byte] = r.c
    tokens = counts.where("token is not null").select("token", "c")
    whole = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    scale = float(whole.n + whole.v + 1)
    many = F.col("c") * HEAVY >= whole.n
    heavy = {bytes(r.token): r.c for r in tokens.where(many).collect()}
    mixer = _model(training, histogram, training.rdd.getNumPartitions())

    kind = (
        "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, bytes long, "
        "rest array<struct<token:binary,n:long>>"
    )
    send = spark.sparkContext.broadcast
    found = rows.mapInArrow(partial(_scored, mixer=send(mixer), heavy=send(heavy), scale=scale), kind)
    found = stored(found, purpose)
    rest = found.select("row", F.explode("rest").alias("r")).select("row", F.col("r.token").alias("word"), F.col("r.n").alias("n"))
    known = rest.join(tokens.where(~many), F.col("word") == F.col("token"), "left")
    c = F.coalesce("c", F.lit(0))
    added = known.groupBy(F.col("row").alias("of")).agg(
        F.sum(F.col("n") * F.log10((c + 1) / F.lit(scale))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("met")
    )
    return found.join(added, found.row == added.of, "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(whole.n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") / log10(2) / (F.col("bytes") + 1)).alias("bits_per_byte"),
    )
