"""Spelling variants: a vocabulary acceptor composed with a one-edit transducer and the acceptor again."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import discard, prepare, ranked_blocks, raw, slices, stored

SHORTEST = 6  # code points of a word
LEAST = 5  # occurrences of a word
RATIO = 5  # times that a word's form is more frequent
MODULUS = 199  # of the ids' and runs' hashes, one in so many loses a letter
#: Words under one initial state beyond which the part of the words that may hold the edit is halved.
CROWDED = 5_000
#: Words that are composed together.
PER_BIN = 20_000

PART = ["m", "a", "b", "head", "tail"]


def _counted(batches: Iterator[pa.RecordBatch], shortest: int, modulus: int | None) -> Iterator[pa.RecordBatch]:
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)
    for batch in slices(batches, 1000):
        counts: Counter[str] = Counter()
        for doc, data in zip(batch.column("doc_id").to_pylist(), raw(batch, "text")):
            own = runs.findall(data.lower().decode())
            start = zlib.crc32(b"" if doc is None else b"%d" % doc)
            start = zlib.crc32(b":", start)
            for run, n in Counter(own).items() if modulus else ():
                h = zlib.crc32(run.encode(), start)
                if h % modulus == 0:
                    counts[run] -= n
                    at = h % len(run)
                    if len(run) > shortest:
                        counts[run[:at] + run[at + 1 :]] += n
            counts.update(own)
        counts = {w: n for w, n in counts.items() if n}
        columns = [pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["word", "n"])


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, modulus: int | None = MODULUS) -> DataFrame:
    """(word, n): words of ``shortest`` code points or more with ``least`` occurrences or more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. Where ``modulus`` divides the CRC-32 h of
    ``<doc_id>:<run>`` the run loses its code point number h modulo its length (None: never). A null id is written as
    nothing there. Null texts have no words; repeated rows count each time.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(partial(_counted, shortest=shortest, modulus=modulus), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Acceptors:
    """Minimal acceptors of sets of words of one length. States are numbers, equal for equal rests; state 0 is the end."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.known: dict[tuple, int] = {(): 0}

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
        return self.known[key]

    def build(self, words: list[str]) -> int:
        """Initial state of the acceptor of sorted words: a branch is closed, and merged with an equal one, as soon as a
        word leaves it."""
        path: list[dict[str, int]] = [{}]
        last = ""
        for word in words:
            shared = 0
            for x, y in zip(last, word):
                if x != y:
                    break
                shared += 1
            self._close(path, last, shared)
            path += ({} for _ in range(len(word) - shared))
            last = word
        self._close(path, last, 0)
        return self._state(path[0])

    def _close(self, path: list[dict[str, int]], word: str, depth: int) -> None:
        while len(path) - 1 > depth:
            state = self._state(path.pop())
            path[-1][word[len(path) - 1]] = state

    def common(self, p: int, q: int) -> Iterator[str]:
        """Words that both states accept."""
        todo = [(p, q, "")]
        while todo:
            p, q, word = todo.pop()
            if p == 0 or q == 0:
                if p == q:
                    yield word
                continue
            other = self.arcs[q]
            todo += ((s, other[x], word + x) for x, s in self.arcs[p].items() if x in other)

    def replaced(self, p: int) -> Iterator[tuple[str, str]]:
        """Pairs that the acceptor, the transducer that replaces one letter, and the acceptor again let through."""
        todo = [(p, "")]
        while todo:
            p, done = todo.pop()
            for (x, s), (y, t) in combinations(self.arcs[p].items(), 2):
                for rest in self.common(s, t):
                    yield done + x + rest, done + y + rest
            todo += ((s, done + x) for x, s in self.arcs[p].items())

    def inserted(self, p: int, q: int, within: int) -> Iterator[tuple[str, str]]:
        """Pairs that an acceptor, the transducer that inserts one letter, and another acceptor let through; the pairs'
        first difference is among the first ``within`` letters."""
        todo = [(p, q, "")]
        while todo:
            p, q, done = todo.pop()
            if len(done) >= within:
                continue
            arcs = self.arcs[p]
            for y, t in self.arcs[q].items():
                for rest in self.common(p, t):
                    if rest[:1] != y:
                        yield done + rest, done + y + rest
                if y in arcs:
                    todo.append((arcs[y], t, done + y))


def near_pairs(words: list[str], m: int, a: int, b: int) -> Iterator[tuple[str, str]]:
    """Pairs at one edit among words of m and m + 1 letters that agree in the first a and the last m - b letters: each
    pair whose shorter word has m letters and whose first difference is in a..b-1, once."""
    tail = max(0, m - b)
    head, end = words[0][:a], words[0][len(words[0]) - tail :]
    middles: dict[int, list[str]] = {m: [], m + 1: []}
    for word in words:
        middles[len(word)].append(word[a : len(word) - tail])
    machine = Acceptors()
    base = machine.build(sorted(middles[m])) if middles[m] else 0
    if len(middles[m]) > 1:
        for u, v in machine.replaced(base):
            yield head + u + end, head + v + end
    if middles[m] and middles[m + 1]:
        for u, v in machine.inserted(base, machine.build(sorted(middles[m + 1])), b - a):
            yield head + u + end, head + v + end


def _near(rows: pa.Table) -> pa.Table:
    """For each word of a bin how many near words it has there and the best of them."""
    words, sizes = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    n = dict(zip(words, sizes))
    groups = defaultdict(list)
    for word, m, a, b in zip(words, *(rows.column(c).to_pylist() for c in ("m", "a", "b"))):
        groups[m, a, b, word[:a], word[len(word) - max(0, m - b) :]].append(word)
    near: Counter[str] = Counter()
    best: dict[str, tuple[int, str]] = {}
    for (m, a, b, _, _), own in groups.items():
        for pair in near_pairs(own, m, a, b) if len(own) > 1 else ():
            for word, other in (pair, pair[::-1]):
                near[word] += 1
                best[word] = min(best.get(word, (0, "")), (-n[other], other))
    columns = {"word": list(near), "n_near": list(near.values()), "rank": [best[w][0] for w in near], "other": [best[w][1] for w in near]}
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(columns.items(), kinds)})


def _parted(rows: DataFrame, halves: str) -> DataFrame:
    """Rows once for each part (a, b) that may hold the edit, with what the words under one initial state share."""
    return (
        rows.withColumn("part", F.explode(F.expr(halves)))
        .select("word", "n", "m", F.expr("part.a as a"), F.expr("part.b as b"))
        .withColumn("head", F.expr("substring(word, 1, a)")).withColumn("tail", F.expr("if(b < m, right(word, m - b), '')"))
    )


def near_words(words: DataFrame, crowded: int = CROWDED, per_bin: int = PER_BIN, purpose: str = "spelling") -> DataFrame:
    """(word, n_near, other_n, other): for each of the distinct words (columns word, n) that has words at one inserted,
    deleted or replaced code point, their number and the most frequent of them (the first in code-point order on a tie).

    A pair's first difference lies in the first or in the second half of the shorter word (of m letters). Words that agree
    in the other half are those under one initial state; for each of these a minimal acceptor is built, composed with the
    one-edit transducer and itself, and the pairs it lets through are enumerated: every near pair under exactly one
    state. Where more than ``crowded`` words share a state, the half is halved again, until at one letter at most a few
    thousand words can agree in all others. States are gathered into bins of about ``per_bin`` words.
    """
    each = words.select("word", "n", F.explode(F.expr("array(length(word), length(word) - 1)")).alias("m"))
    now = stored(
        _parted(each, "array(struct(0 as a, (m + 1) div 2 as b), struct((m + 1) div 2 as a, m + 1L as b))"), purpose
    )
    ready = []
    while True:
        full = now.groupBy(*PART).agg(F.count("*").alias("held")).where(f"held > {crowded} and b - a > 1").drop("held")
        full = stored(full, purpose)
        if full.isEmpty():
            ready.append(now)
            break
        ready.append(now.join(full, PART, "left_anti"))
        halves = "array(struct(a, (a + b) div 2 as b), struct((a + b) div 2 as a, b))"
        now = stored(_parted(now.join(full, PART, "left_semi").select("word", "n", "m", "a", "b"), halves), purpose)
    rows = ready[0].select(now.columns)
    for more in ready[1:]:
        rows = rows.unionByName(more)
    bins = ranked_blocks(rows.count(), per_bin)
    found = (
        rows.select("word", "n", *(F.col(c).cast("int").alias(c) for c in ("m", "a", "b")), F.expr(f"pmod(xxhash64({', '.join(PART)}), {bins})").alias("bin"))
        .groupBy("bin").applyInArrow(lambda t: _near(t), "word string, n_near long, rank long, other string")
    )
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("rank", "other")).alias("best")).select(
        "word", "n_near", F.expr("-best.rank").alias("other_n"), F.col("best.other").alias("other")
    )


def variants(
    docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, modulus: int | None = MODULUS,
    crowded: int = CROWDED, per_bin: int = PER_BIN, purpose: str = "spelling",
) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row per word of ``vocabulary``.

    ``form`` is the most frequent of the near words where it is ``ratio`` times as frequent, else null; ``root`` is where
    following forms ends, the word itself without one. Frequencies grow at each step, so chains are short; they are
    followed by doubling. Columns other than doc_id and text are not read; an empty table gives no rows.
    """
    words = stored(vocabulary(docs, shortest, least, modulus), purpose)
    near = near_words(words, crowded, per_bin, purpose)
    formed = words.join(near.withColumnRenamed("word", "known"), F.col("word") == F.col("known"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.expr(f"if(other_n >= {ratio} * n, other, null)").alias("form"),
        F.expr(f"if(other_n >= {ratio} * n, other_n, null)").alias("form_n"),
    )
    formed = stored(formed, purpose)
    roots = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.toDF("via", "next")
        further = roots.join(ahead, roots.root == ahead.via, "left")
        last, roots = roots, stored(further.select("word", F.coalesce("next", "root").alias("root"), F.col("via").isNotNull().alias("moved")), purpose)
        ended = roots.where("moved").isEmpty()
        discard(last)
        roots = roots.drop("moved")
        if ended:
            break
    roots = roots.withColumnRenamed("word", "start")
    return formed.join(roots, formed.word == roots.start, "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
