"""Phrase collocations, mined by SON partitioning: shards at lowered support, then exact counts of what any of them found."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import discard, prepare, ranked_blocks, raw, slices, stored
from creditloom.llm.suffix import Words

SUPPORT = 30  # occurrences of a candidate
LONGEST = 4  # words of a phrase
TOP = 2000  # phrases of a language in the report
SHARES = (80, 100)  # a longer phrase with that share of the occurrences covers a candidate
SHARDS = 10
#: Bytes of text that are read together, and digests that are counted together.
BLOCK = 3_000_000
ENTRIES = 2_000_000
#: Long texts are cut between pieces into parts of about this many bytes.
PART = 500_000

LINE = 10
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


def folded(data: bytes) -> bytes:
    """Pieces on lines of their own, words joined by one space."""
    lines = re.sub(rb" *\n[ \n]*", b"\n", data.translate(FOLD))
    return re.sub(rb" {2,}", b" ", lines).strip(b" \n")


def parts(data: bytes, size: int = PART) -> Iterator[bytes]:
    """The lines in parts of at most ``size`` bytes; a longer line stays whole."""
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b"\n", at, at + size)
        cut = cut if cut >= 0 else data.find(b"\n", at + size)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut + 1
    if data[at:]:
        yield data[at:]


class Pieces(Words):
    """Words of folded texts of one language, their pieces, and digests of the phrases in them."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.data = b"\n".join(texts)
        super().__init__(self.data)
        ends = np.frombuffer(self.data, np.uint8)[self.starts[1:] - 1] == LINE
        self.piece = np.concatenate([[0], np.cumsum(ends)])[: self.n]
        self.seed = np.frombuffer(blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]

    def phrases(self, k: int) -> np.ndarray:
        """Places where ``k`` words stand in one piece."""
        if self.n < k:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.piece[: self.n - k + 1] == self.piece[k - 1 :])

    def digests(self, k: int, at: np.ndarray) -> np.ndarray:
        return self.runs(k, at) ^ self.seed if len(at) else np.zeros(0, np.uint64)

    def marked(self, at: np.ndarray) -> np.ndarray:
        good = np.zeros(self.n, bool)
        good[at] = True
        return good

    def chained(self, k: int, good: np.ndarray) -> np.ndarray:
        """Places of phrases whose pairs all begin at good places."""
        at = self.phrases(k)
        for i in range(k - 1):
            at = at[good[at + i]]
        return at

    def spelled(self, k: int, at: np.ndarray) -> Iterator[bytes]:
        data = self.data
        return (data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + k - 1].tolist()))


def _by_language(rows: pa.Table) -> Iterator[tuple[str, Pieces]]:
    texts: dict[str, list[bytes]] = {}
    for lang, part in zip(rows.column("lang").to_pylist(), rows.column("part").to_pylist()):
        texts.setdefault(lang, []).append(part)
    for lang, own in texts.items():
        yield lang, Pieces(lang, own)


def _numbers(column) -> np.ndarray:
    """Binary values of 8-byte numbers, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        rows = [
            (lang, part) for lang, data in zip(batch.column("lang").to_pylist(), raw(batch, "text")) for part in parts(folded(data))
        ]
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "part"])


def _mined(block: int, found: list[np.ndarray], bits: int, most: int) -> pa.Table:
    """A block's distinct digests, with how often each occurs (``most`` stands for more, too), by ranges of digests."""
    digests, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    times = np.minimum(times, most).astype(np.uint32)
    ranges = (digests >> np.uint64(63 - bits) >> np.uint64(1)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
    ends = np.append(cuts[1:], len(digests))
    spans = list(zip(cuts.tolist(), ends.tolist()))
    return pa.table(
        {
            "range": pa.array(ranges[cuts]), "block": pa.array([block] * len(cuts), pa.int64()),
            "digests": pa.array([digests[a:b].tobytes() for a, b in spans], pa.binary()),
            "times": pa.array([times[a:b].tobytes() for a, b in spans], pa.binary()),
        }
    )


def _short(key: tuple, rows: pa.Table, bits: int, most: int) -> pa.Table:
    """Words and pairs of a block."""
    found = [own.digests(k, own.phrases(k)) for _, own in _by_language(rows) for k in (1, 2)]
    return _mined(key[0].as_py(), found, bits, most)


def _long(key: tuple, rows: pa.Table, frequent: pa.Table, bits: int, most: int, longest: int) -> pa.Table:
    """Longer phrases of a block whose pairs are all locally frequent somewhere."""
    pairs, found = _numbers(frequent.column("digests")), []
    for _, own in _by_language(rows) if len(pairs) else ():
        at = own.phrases(2)
        good = own.marked(at[np.isin(own.digests(2, at), pairs)])
        found += [own.digests(k, own.chained(k, good)) for k in range(3, longest + 1)]
    return _mined(key[0].as_py(), found, bits, most)


def _frequent(rows: pa.Table, shards: int, least: int, support: int) -> pa.Table:
    """Which digests of a range occur ``least`` times in some shard and ``support`` times in all, as a list for each block
    that has any of them."""
    blocks = rows.column("block").to_pylist()
    held = [np.frombuffer(x, np.uint64) for x in rows.column("digests").to_pylist()]
    times = np.frombuffer(b"".join(rows.column("times").to_pylist()), np.uint32)
    sizes = np.array([len(x) for x in held])
    distinct, place = np.unique(np.concatenate(held), return_inverse=True)
    shard = np.repeat(np.array(blocks) % shards, sizes)
    frequent = np.zeros(len(distinct), bool)
    for s in range(shards):
        here = shard == s
        frequent |= np.bincount(place[here], times[here], len(distinct)) >= least
    frequent &= np.bincount(place, times, len(distinct)) >= support
    marks = np.split(frequent[place], np.cumsum(sizes)[:-1])
    kept = [(b, x[m].tobytes()) for b, x, m in zip(blocks, held, marks) if m.any()]
    return pa.table({"block": pa.array([k[0] for k in kept], pa.int64()), "digests": pa.array([k[1] for k in kept], pa.binary())})


def _counted(key: tuple, rows: pa.Table, candidates: pa.Table, longest: int) -> pa.Table:
    """A block's candidates by their words with their occurrences; under no words the number of all words."""
    wanted = np.unique(_numbers(candidates.column("digests")))
    lang, size, phrase, times = [], [], [], []
    for name, own in _by_language(rows):
        counts = [Counter({b"": own.n})]
        for k in range(1, longest + 1):
            at = own.phrases(k) if k < 3 else own.chained(k, good)
            at = at[np.isin(own.digests(k, at), wanted)]
            counts.append(Counter(own.spelled(k, at)))
            if k == 2:
                good = own.marked(at)
        for k, found in enumerate(counts):
            lang += [name] * len(found)
            size += [k] * len(found)
            phrase += found.keys()
            times += found.values()
    columns = {"lang": pa.array(lang, pa.string()), "words": pa.array(size, pa.int32())}
    return pa.table(columns | {"phrase": pa.array(phrase, pa.binary()).cast(pa.string()), "a": pa.array(times, pa.int64())})


def frequent_phrases(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS, block: int = BLOCK,
    entries: int = ENTRIES, purpose: str = "phrases",
) -> DataFrame:
    """(lang, words, phrase, a): every phrase of up to ``longest`` words that occurs ``support`` times or more in its
    language, with its occurrences; and for each language, under 0 words, the number of all its words.

    Texts are cut into pieces at ``.,;:!?`` and line ends; phrases don't cross them. A-Z are lower-cased.

    1. Texts are dealt in turn to blocks of about ``block`` bytes, blocks in turn to ``shards`` shards. A phrase that is
       frequent has ``support / shards`` occurrences (rounded up) in one shard at least.
    2. Each shard is mined at that support. A block counts its words and pairs by digest and sends the digests to ranges;
       a range adds up the blocks of each shard, unites what the shards found frequent, and tells every block which of
       its digests are among it, unless all shards together stay below ``support``. Then the same for longer phrases, of
       which only those are counted whose pairs all are left.
    3. What is left is counted in all blocks by its words, and added up exactly.

    A block holds one entry for a phrase however often it occurs, so a common phrase costs a range one entry a block.
    Digests only choose candidates: two phrases that share one can make a candidate too many, never one too few. Null
    languages count as ``und``, null texts as empty; repeated rows count each time; ids are not read. An empty table
    gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")
    )
    folds = rows.mapInArrow(_fold, "lang string, part binary").withColumn("at", F.monotonically_increasing_id())
    folds = stored(folds, purpose)
    size = folds.agg(F.sum(F.length("part")).alias("size")).first()["size"] or 0
    blocks = ranked_blocks(size, block)
    shards = min(shards, blocks)
    least = -(-support // shards)
    bits = min((ranked_blocks(size // 2, entries) - 1).bit_length(), 40)  # two entries a word, words of four bytes or more
    dealt = folds.select("lang", "part", F.expr(f"pmod(at, {blocks})").alias("block"))
    entry, back = "range long, block long, digests binary, times binary", "block long, digests binary"

    def union_of_shards(found: DataFrame) -> DataFrame:
        merged = found.groupBy("range").applyInArrow(lambda t: _frequent(t, shards, least, support), back)
        return stored(merged, purpose)

    short = union_of_shards(dealt.groupBy("block").applyInArrow(lambda k, t: _short(k, t, bits, support), entry))
    discard(rows)  # removes no table, but lets shuffle files of the finished step go
    both = dealt.groupBy("block").cogroup(short.groupBy("block"))
    long = union_of_shards(both.applyInArrow(lambda k, a, b: _long(k, a, b, bits, support, longest), entry))
    discard(rows)
    both = dealt.groupBy("block").cogroup(short.unionByName(long).groupBy("block"))
    kinds = "lang string, words int, phrase string, a long"
    counted = both.applyInArrow(lambda k, a, b: _counted(k, a, b, longest), kinds)
    total = counted.groupBy("lang", "words", "phrase").agg(F.sum("a").alias("a")).where(F.expr(f"words = 0 or a >= {support}"))
    total = stored(total, purpose)
    discard(folds, short, long)
    return total


def _run(first: str, n: str) -> str:
    """SQL for the phrase of ``n`` of the words from number ``first`` on."""
    return f"array_join(slice(w, {first}, {n}), ' ')"


def collocations(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, shares: tuple[int, int] = SHARES,
    purpose: str = "phrases", **sizes: int,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two words or more that occur ``support``
    times or more.

    The score of a phrase is that of its weakest cut into two (the earliest on a tie): ``2000000 a / (l + r)``, rounded
    down, where l and r count the two parts. Phrases inside a longer one with a ``shares`` part of their occurrences
    are left out. Order: score and occurrences descending, then the phrase by its bytes. See ``frequent_phrases`` for how
    phrases are counted, and for ``sizes``.
    """
    known = frequent_phrases(docs, support, longest, purpose=purpose, **sizes)
    split = known.where("words > 1").withColumn("w", F.split("phrase", " "))
    cuts = split.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr(_run("1", "k")).alias("left"), F.expr(_run("k + 1", "words - k")).alias("right")
    )
    part = known.where("words > 0").select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
    scored = cuts.join(part, ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"])
    exact = "cast({} as decimal(20,0))"
    score = f"(cast(2000000 as decimal(7,0)) * {exact.format('a')}) div ({exact.format('l')} + {exact.format('r')})"
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(score).alias("score"), "k", "l", "r")).alias("cut"))

    inner = split.where("words > 2").select("lang", "words", "a", "w", F.explode(F.expr("sequence(2, words - 1)")).alias("n"))
    inner = inner.select("lang", "a", "w", "n", F.explode(F.expr("sequence(1, words - n + 1)")).alias("i"))
    longer = inner.groupBy("lang", F.expr(_run("i", "n")).alias("phrase")).agg(F.max("a").alias("longer"))
    covered = f"{exact.format('longer')} * {shares[1]} >= {exact.format('a')} * {shares[0]}"
    own = best.join(longer, ["lang", "phrase"], "left").where(F.expr(f"longer is null or not ({covered})"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    first = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    words = known.where("words = 0").select("lang", F.col("a").alias("n"))
    return first.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
