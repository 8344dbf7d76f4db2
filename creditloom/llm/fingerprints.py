"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

A sketch has three subtables. Each digest is added to one cell of each: a cell holds the count, the XOR of the digests and
the XOR of their check values. Two sketches are subtracted cell by cell; digests in both cancel. A cell that is left with
one digest (count 1 or -1, and the check fits) gives it away; it is taken out of its other cells, and so on until nothing
is left. If that stops early the sketches were too small, and larger ones are made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creditloom.llm.common import discard, ranked_blocks, stored

#: Cells of each subtable in the stored fingerprint.
CELLS = 8
#: Tries after the first, each with four times as many cells.
RETRIES = 3
ROUNDS = 60
PER_BLOCK = 200_000
#: Digests whose cells a task adds up.
PER_TASK = 100_000
#: Cells in each subtable of a sketch for every digest of both sides. Only full cells are held, so width costs nothing.
WIDE = 32
#: What ends a paragraph.
BREAKS = r"[\r\n]+"
#: What ends a unit of finer sketches; besides, a word whose hash is a multiple of RUN does.
SENTENCES = r"(?<=[.!?])[ \t]+|(?<=[。！？])|[\r\n]+"
RUN = 16
#: Cells are added up in parts of about this many entries; a list that grows is copied each time.
PART = 128

_CELL = "struct<at:int,n:int,k:bigint,c:bigint>"
_LIST = "array<bigint>"


def digests(text: str) -> str:
    """SQL for the distinct digests of a text's paragraphs."""
    return f"array_distinct(transform(filter(split({text}, '{BREAKS}'), x -> x <> ''), x -> xxhash64(x)))"


def fine(text: str) -> str:
    """SQL for the distinct digests of a text's sentences and, within them, runs of words that end where a word's hash says
    so: an edit changes only the units that it touches, in texts of a single line too."""
    marked = f"array_join(transform(split(p, ' '), w -> if(pmod(xxhash64(w), {RUN}) = 0, concat(w, '\n'), w)), ' ')"
    runs = f"transform(filter(split({marked}, '\n ?'), x -> x <> ''), x -> xxhash64(x))"
    return f"array_distinct(flatten(transform(split({text}, '{SENTENCES}'), p -> {runs})))"


def _check(d: str) -> str:
    return f"(xxhash64({d}, 'check') & 4294967295L)"


def _entries(d: str, sign: str, size: str) -> str:
    """The three cells that a digest is added to (sign 1) or taken from (-1), numbered through all subtables."""
    cells = ", ".join(
        f"named_struct('at', cast({j} * {size} + pmod(xxhash64({d}, {size}, {j}), {size}) as int), 'n', {sign}, 'k', {d}, 'c', {_check(d)})"
        for j in range(3)
    )
    return f"array({cells})"


def _added(entries: str) -> str:
    """Entries of the same cell added up, in order of cells, without the cells that come out empty."""
    empty = f"cast(array() as array<{_CELL}>)"
    nothing = f"cast(null as {_CELL})"
    full = "(s.now.n <> 0 or s.now.k <> 0 or s.now.c <> 0)"
    return (
        f"aggregate(sort_array({entries}), named_struct('now', {nothing}, 'out', {empty}), (s, e) -> "
        "if(s.now.at = e.at, "
        "named_struct('now', named_struct('at', e.at, 'n', s.now.n + e.n, 'k', s.now.k ^ e.k, 'c', s.now.c ^ e.c), 'out', s.out), "
        f"named_struct('now', e, 'out', if(s.now is not null and {full}, concat(s.out, array(s.now)), s.out))), "
        f"s -> if(s.now is not null and {full}, concat(s.out, array(s.now)), s.out))"
    )


def _added_in_parts(entries: str, size: str) -> str:
    """The same by ranges of cells."""
    here = f"filter(q, x -> x.at * g div (3 * {size}) = j)"
    parts = f"flatten(transform(sequence(0, g - 1), j -> {_added(here)}))"
    return f"element_at(transform(array({entries}), q -> element_at(transform(array(1L + size(q) div {PART}), g -> {parts}), 1)), 1)"


def sketch(digested: str, size: str) -> str:
    """SQL for the sketch of an array of distinct digests: its full cells in order."""
    return _added_in_parts(f"flatten(transform({digested}, d -> {_entries('d', '1', size)}))", size)


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body``, in which ``name`` stands for the value; computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def written(cells: str, size: int = CELLS) -> str:
    """SQL for a sketch as text: 16 bytes for each cell (count, digests, checks), in base 64."""
    shown = "concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c), 8, '0'))"
    full = f"map_from_arrays({cells}.at, transform({cells}, c -> {shown}))"
    dense = f"transform(sequence(0, {3 * size - 1}), i -> coalesce(element_at(m, i), repeat('0', 32)))"
    return f"base64(unhex(array_join({_let(full, 'm', dense)}, '')))"


def difference(a: str, b: str, size: str) -> str:
    """SQL for the digests that only one of two sketches has: struct of two arrays, null where peeling stops early."""
    turned = f"transform({b}, c -> named_struct('at', c.at, 'n', -c.n, 'k', c.k, 'c', c.c))"
    return peeled(_added_in_parts(f"concat({a}, {turned})", size), size)


def peeled(cells: str, size: str) -> str:
    """SQL for the digests in the cells of a subtracted sketch, by the side that has them; null where peeling stops early.

    A round reads the digests off all cells that are left with one. Those cells are done with; in the others the digests
    are taken out, and what comes out empty there goes too.
    """
    pure = f"(abs(c.n) = 1 and c.c = {_check('c.k')})"
    start = f"named_struct('left', {cells}, 'a', cast(array() as {_LIST}), 'b', cast(array() as {_LIST}), 'go', true)"
    sides = ", ".join(
        f"'{side}', array_distinct(transform(filter(p.pure, c -> c.n = {n}), c -> c.k))" for side, n in (("a", 1), ("b", -1))
    )
    rest = "filter(s.left, c -> not " + pure + ")"
    parted = f"named_struct('pure', filter(s.left, c -> {pure}), 'rest', {rest})"
    found = _let(parted, "p", f"named_struct({sides}, 'rest', p.rest, 'ats', p.rest.at)")
    out = f"concat(flatten(transform(f.a, x -> {_entries('x', '-1', size)})), flatten(transform(f.b, x -> {_entries('x', '1', size)})))"
    entries = f"concat(f.rest, filter({out}, e -> array_contains(f.ats, e.at)))"
    taken = _added_in_parts(entries, size).replace("(s, e)", "(t, e)").replace("s.now", "t.now").replace("s.out", "t.out").replace(", s -> if", ", t -> if")
    step = _let(
        found, "f",
        "if(size(f.a) + size(f.b) = 0, named_struct('left', s.left, 'a', s.a, 'b', s.b, 'go', false), "
        f"named_struct('left', {taken}, 'a', concat(s.a, f.a), 'b', concat(s.b, f.b), 'go', true))",
    )
    return (
        f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> if(not s.go or size(s.left) = 0, s, {step}), "
        "s -> if(size(s.left) = 0, named_struct('a', s.a, 'b', s.b), null))"
    )


def _differing(a: str, b: str) -> str:
    """SQL for the difference of two digest arrays through sketches; null only if all retries fail.

    How many digests a sketch holds is the sum of its counts, so both sides know it: the first try has four cells in
    each subtable for every digest of both, every retry four times as many. Only full cells are held, so that a wide sketch
    costs no more than a narrow one, and peeling ends in a few rounds.
    """
    first = f"(4 * (size({a}) + size({b})) + {CELLS})"
    one = difference("u.a", "u.b", "z")
    tried = f"element_at(transform(array(named_struct('a', {sketch(a, 'z')}, 'b', {sketch(b, 'z')})), u -> {one}), 1)"
    sizes = f"transform(sequence(0, {RETRIES}), t -> cast({first} * power(4, t) as int))"
    return f"aggregate({sizes}, cast(null as struct<a:{_LIST},b:{_LIST}>), (found, z) -> coalesce(found, {tried}))"


def followers(keys: DataFrame, purpose: str, per_block: int = PER_BLOCK) -> DataFrame:
    """Adds next_id and next_h, the row that follows in order of (id, h); the first follows the last.

    Rows are spread by ranges over tasks and follow each other there; the last of a range is followed by the first of the
    next one. Only the ranges' first rows are ordered in one task.
    """
    keys = stored(keys, purpose)
    blocks = ranked_blocks(keys.count(), per_block)
    placed = stored(keys.repartitionByRange(blocks, "id", "h").withColumn("range", F.spark_partition_id()), purpose)
    first = placed.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("o"), "id", "h")).alias("first"))
    ordered = Window.orderBy("range")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = first.select(
        "range", F.coalesce(F.lead("first").over(ordered), F.first("first").over(whole)).alias("after")
    )
    own = Window.partitionBy("range").orderBy("id", "h")
    here = placed.withColumn("follower", F.lead(F.struct("id", "h")).over(own))
    return here.join(after, "range").select(
        *keys.columns,
        F.when(F.col("follower").isNull(), F.col("after.id")).otherwise(F.col("follower.id")).alias("next_id"),
        F.when(F.col("follower").isNull(), F.col("after.h")).otherwise(F.col("follower.h")).alias("next_h"),
    )


def _cells(sketched: DataFrame) -> DataFrame:
    """(id, h, z, at, n, k, c, n2, k2, c2): the cells of the sketches of each row's own, new and next digests.

    From 0 on, ``at`` numbers the cells of own minus new and (n2, k2, c2) own minus next, with z cells a subtable. Below
    stand the cells -1, -2, ... of the two short sketches, of own and (n2, k2, c2) new. Entries are added up by Spark where the
    row's digests are; only cells are held, not entries.
    """
    sides = "array(named_struct('side', 0, 'ds', own), named_struct('side', 1, 'ds', new), named_struct('side', 2, 'ds', next))"
    each = sketched.select("id", "h", "z", F.expr(f"inline({sides})")).select("id", "h", "z", "side", F.explode("ds").alias("d"))
    told = each.withColumn("c", F.expr(_check("d"))).withColumn("j", F.expr("explode(if(side < 2, array(0, 1, 2, 3, 4, 5), array(0, 1, 2)))"))
    wide = "cast(j * z + pmod(xxhash64(d, z, j), z) as int)"
    short = f"cast(-1 - ((j - 3) * {CELLS} + pmod(xxhash64(d, {CELLS}, j - 3), {CELLS})) as int)"
    entries = told.select(
        "id", "h", "z", F.expr(f"if(j < 3, {wide}, {short})").alias("at"), "d", "c",
        F.expr("case when side = 0 then 1 when side = 1 and j < 3 then -1 else 0 end").alias("s"),
        F.expr("case when j < 3 then case side when 0 then 1 when 2 then -1 else 0 end when side = 1 then 1 else 0 end").alias("s2"),
    )

    def added(sign: str, suffix: str) -> list:
        return [F.sum(sign).alias("n" + suffix), *(F.expr(f"bit_xor(if({sign} = 0, 0L, {x}))").alias(y + suffix) for x, y in (("d", "k"), ("c", "c")))]

    return entries.groupBy("id", "h", "z", "at").agg(*added("s", ""), *added("s2", "2"))


def _recovered(cells: DataFrame) -> DataFrame:
    """(id, h, fingerprint, edited_fingerprint, edited, next): per row the two short sketches as text, and the numbers of
    digests that only own (a) and only the other side (b) has; null where peeling stops early.

    Cells with one digest give it away. A digest met in all of its three cells is done with. The others are taken out of
    the cells that hold several, and those few cells are peeled within the row.
    """
    kinds = (
        "array(named_struct('kind', if(at < 0, 2, 0), 'n', n, 'k', k, 'c', c), named_struct('kind', if(at < 0, 3, 1), 'n', n2, 'k', k2, 'c', c2))"
    )
    full = cells.select("id", "h", "z", "at", F.expr(f"inline({kinds})")).where("n <> 0 or k <> 0 or c <> 0")
    pure = F.expr(f"kind < 2 and abs(n) = 1 and c = {_check('k')}")
    read = full.withColumn("pure", pure).withColumn("x", F.expr("if(pure, k, cast(at as bigint))"))
    once = read.groupBy("id", "h", "z", "kind", "pure", "x", "n").agg(F.count("*").alias("m"), F.max("k").alias("k"), F.max("c").alias("c"))
    cell = "named_struct('at', cast(x as int), 'n', cast(n as int), 'k', k, 'c', c)"
    counts = [
        F.count_if(F.expr(f"kind = {kind} and pure and n = {sign}")).cast("int").alias(f"{side}{kind}")
        for kind in (0, 1) for side, sign in (("a", 1), ("b", -1))
    ]
    mixed = [F.expr(f"collect_list(if(kind = {kind} and not pure, {cell}, null))").alias(f"mixed{kind}") for kind in range(4)]
    partial = [F.expr(f"collect_list(if(kind = {kind} and pure and m < 3, named_struct('k', k, 'n', cast(-n as int)), null))").alias(f"part{kind}") for kind in (0, 1)]
    held = once.groupBy("id", "h", "z").agg(*counts, *mixed, *partial)

    def left(kind: int) -> str:
        out = f"flatten(transform(part{kind}, p -> {_entries('p.k', 'p.n', 'z')}))"
        more = _let(f"mixed{kind}.at", "ats", f"filter({out}, e -> array_contains(ats, e.at))")
        return f"if(size(mixed{kind}) = 0, mixed{kind}, {_added_in_parts(f'concat(mixed{kind}, {more})', 'z')})"

    def numbers(kind: int) -> str:
        found = _let(peeled(left(kind), "z"), "r", f"if(r is null, null, named_struct('a', a{kind} + size(r.a), 'b', b{kind} + size(r.b)))")
        return f"if(size(mixed{kind}) = 0, named_struct('a', a{kind}, 'b', b{kind}), {found})"

    def short(kind: int) -> str:
        return _let(f"transform(mixed{kind}, c -> named_struct('at', -1 - c.at, 'n', c.n, 'k', c.k, 'c', c.c))", "cells", written("cells"))

    return held.select(
        "id", "h", F.expr(short(2)).alias("fingerprint"), F.expr(short(3)).alias("edited_fingerprint"),
        F.expr(numbers(0)).alias("edited"), F.expr(numbers(1)).alias("next"),
    )


def _counted(a: str, b: str) -> str:
    """SQL for the numbers of digests that only one of two arrays has, through larger sketches; for the case that all of them
    fail (several digests would have to fall into the same three cells), from the arrays themselves."""
    plain = f"named_struct('a', size(array_except({a}, {b})), 'b', size(array_except({b}, {a})))"
    return _let(_differing(a, b), "r", f"if(r is null, {plain}, named_struct('a', size(r.a), 'b', size(r.b)))")


def _alike(only: str, own: str = "n_own") -> str:
    """SQL for shared digests among all of both; 1 where both have none."""
    union = f"({own} + {only}.b)"
    return f"if({union} = 0, 1D, ({own} - {only}.a) / cast({union} as double))"


def compare_edits(docs: DataFrame, purpose: str = "fingerprints", units: Callable[[str], str] = digests) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row per row.

    The edited text has its last quarter of code points (rounded down) replaced by the first as many of the next
    document. Documents follow each other by doc_id, null first; those that share one by a hash of their texts. Repeated
    rows count once in that order and have the same result. Null texts count as empty. ``units`` gives the SQL for a
    text's digests, of its lines or finer ones; a unit never goes beyond its line.

    Digests of a text's lines are taken once and serve for the text, for the lines that its edit leaves alone and for the
    document before; texts themselves are shuffled but not stored. Sketches have ``WIDE`` cells in each subtable for every digest of both sides; where peeling stops
    early, larger ones are made.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).withColumn("h", F.xxhash64("text"))
    keys = rows.groupBy("id", "h").agg(F.max(F.length("text")).alias("n"))
    order = stored(followers(keys, purpose), purpose).select(F.col("id").alias("to_id"), F.col("h").alias("to_h"), "n", "next_id", "next_h")

    def to_former(table: DataFrame, *columns) -> DataFrame:
        """What the row before each one shall have of it."""
        return table.join(order, table.id.eqNullSafe(order.next_id) & (table.h == order.next_h)).select("to_id", "to_h", *columns)

    heads = to_former(rows, F.substring("text", F.lit(1), F.expr("n div 4")).alias("head"))
    heads = stored(heads.groupBy("to_id", "to_h").agg(F.first("head").alias("head")), purpose)
    # the whole lines that an edit leaves alone have the same digests in both texts; only the rest is taken anew
    edited = (
        rows.join(heads, rows.id.eqNullSafe(heads.to_id) & (rows.h == heads.to_h))
        .withColumn("n", F.length("text")).withColumn("stays", F.expr("substring(text, 1, n - n div 4)"))
        .withColumn("parts", F.expr(f"split(stays, '{BREAKS}')")).withColumn("rest", F.expr("concat(element_at(parts, -1), head)"))
        .select(
            "id", "h", F.col("n").cast("long").alias("n_chars"), F.sha2(F.concat("stays", "head"), 256).alias("edited_sha256"),
            F.expr(f"transform(split(text, '{BREAKS}'), l -> {units('l')})").alias("lines"), F.expr("size(parts) - 1").alias("whole"),
            F.expr(units("rest")).alias("rest"),
        )
    )
    edited = stored(edited, purpose)
    discard(heads)
    mine = edited.select("id", "h", "lines", "whole", "rest")
    held = mine.agg(F.coalesce(F.sum(F.expr("3 * (size(flatten(lines)) + size(rest))")), F.lit(0)).alias("n")).first().n
    sent = to_former(mine, F.expr("array_distinct(flatten(lines))").alias("next"))
    sent = sent.withColumnsRenamed({"to_id": "id", "to_h": "h"})
    gathered = mine.unionByName(sent, allowMissingColumns=True).repartition(ranked_blocks(held, PER_TASK), "id", "h")
    gathered = gathered.groupBy("id", "h").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("lines", "whole", "rest", "next")))
    arrays = gathered.select(
        "id", "h", F.expr("array_distinct(flatten(lines))").alias("own"),
        F.expr("array_distinct(concat(flatten(slice(lines, 1, whole)), rest))").alias("new"), "next",
    )
    sketched = arrays.withColumn("z", F.expr(f"cast({WIDE} * (size(own) + greatest(size(new), size(next))) + {CELLS} as int)"))
    found = stored(_recovered(_cells(sketched)), purpose)
    failed = found.where("edited is null or next is null")
    if not failed.isEmpty():
        again = failed.select(F.col("id").alias("i"), F.col("h").alias("g"), "fingerprint", "edited_fingerprint")
        again = arrays.join(again, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))).select(
            "id", "h", "fingerprint", "edited_fingerprint", F.expr(_counted("own", "new")).alias("edited"), F.expr(_counted("own", "next")).alias("next")
        )
        found = found.where("edited is not null and next is not null").unionByName(again)
    told = edited.select(
        F.col("id").alias("doc_id"), F.col("h").alias("g"), "n_chars", "edited_sha256",
        F.expr("size(array_distinct(flatten(lines)))").alias("n_own"),
    )
    # what has no digests has no cells either
    none = F.expr("named_struct('a', 0, 'b', 0)")
    empty = F.expr(written(f"cast(array() as array<{_CELL}>)"))
    return (
        told.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("g") == F.col("h")), "left")
        .withColumn("edited", F.coalesce("edited", none)).withColumn("next", F.coalesce("next", none))
        .select(
            "doc_id", "n_chars", "edited_sha256", F.coalesce("fingerprint", empty).alias("fingerprint"),
            F.coalesce("edited_fingerprint", empty).alias("edited_fingerprint"),
            F.expr(_alike("edited")).alias("near_edited"), F.expr(_alike("next")).alias("near_next"),
        )
    )
