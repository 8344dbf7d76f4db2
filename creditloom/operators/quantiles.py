"""Exact interpolated quantiles of any number of rows.

Spark's own exact ``percentile`` keeps every distinct value of a column in the memory of one task. Here the values
that may hold a quantile are narrowed: a small mergeable sketch gives two values that enclose it, and one pass counts the
rows below, at and up to them. If the wanted row is among those equal to an end, its value is known; else it lies strictly
between the ends. Rows there are counted by value and stored, and that smaller table is narrowed on until a bracket has
few distinct values, which are then put in order. A value that many rows share is never inside a bracket for long, as
each round takes the rows equal to the ends out. The result is exact. The full table is read three times at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.session import discard, stored

ACCURACY = 1000
#: Distinct values that one task puts in order, at most.
FEW_VALUES = 100_000
#: Ends that split a bracket anew.
GRID = 16


@dataclass
class _Rank:
    """A row to find by its place in order, and what is known of its value."""

    column: int
    rank: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def bracket(self) -> tuple:
        return self.column, self.low, self.high

    def narrow(self, ends: list[tuple[float, int, int]]) -> None:
        """Takes over counts at ascending ends: (end, rows less, rows less or equal), counted within the bracket."""
        start = self.below
        for end, less, upto in ends:
            if self.rank < start + less:
                self.high = end
                return
            if self.rank < start + upto:
                self.value = end
                return
            self.low, self.below = end, start + upto


def _between(value: Column, low: float | None, high: float | None) -> Column:
    """Strictly, as the rows equal to an end are accounted for."""
    test = value.isNotNull()
    if low is not None:
        test = test & (value > low)
    if high is not None:
        test = test & (value < high)
    return test


def _open(ranks: list[_Rank]) -> dict[tuple, list[_Rank]]:
    groups: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        if r.value is None:
            groups.setdefault(r.bracket(), []).append(r)
    return groups


def _enclosed(numbers: DataFrame, ranks: list[_Rank]) -> DataFrame:
    """(c, value, n): rows within a bracket, counted by column and value; one pass over the table."""
    tests: dict[int, Column] = {}
    for column, low, high in _open(ranks):
        test = _between(F.col(f"v{column}"), low, high)
        tests[column] = tests[column] | test if column in tests else test
    tagged = [F.when(t, F.struct(F.lit(c).alias("c"), F.col(f"v{c}").alias("value"))) for c, t in tests.items()]
    pairs = numbers.select(F.explode(F.array_compact(F.array(*tagged))).alias("e"))
    return pairs.groupBy("e.c", "e.value").agg(F.count(F.lit(1)).alias("n"))


def _refine(counts: DataFrame, ranks: list[_Rank]) -> None:
    """Narrows brackets on the table of counted values until each has few distinct ones; those are then ordered."""
    value, n = F.col("value"), F.col("n")
    while groups := _open(ranks):
        inside = [(F.col("c") == c) & _between(value, low, high) for c, low, high in groups]
        grid = [(i + 1) / (GRID + 1) for i in range(GRID)]
        found = counts.agg(
            *[F.count_if(t) for t in inside], *[F.percentile_approx(F.when(t, value), grid, ACCURACY) for t in inside]
        ).first()
        sizes, ends = found[: len(inside)], found[len(inside) :]
        large = [(g, t, sorted(set(e))) for g, t, size, e in zip(groups, inside, sizes, ends) if size > FEW_VALUES]
        if not large:
            break
        sums = counts.agg(
            *[F.coalesce(F.sum(F.when(t & c, n)), F.lit(0)) for _, t, e in large for x in e for c in (value < x, value <= x)]
        ).first()
        at = iter(sums)
        for g, _, e in large:
            told = [(x, next(at), next(at)) for x in e]
            for r in groups[g]:
                r.narrow(told)
    _order(counts, ranks)


def _order(counts: DataFrame, ranks: list[_Rank]) -> None:
    """Reads the remaining ranks off the ordered values of their brackets."""
    groups = _open(ranks)
    if not groups:
        return
    wanted = [(k, r.rank - r.below, c) for k, ((c, _, _), own) in enumerate(groups.items()) for r in own]
    place = F.lit(None).cast("int")
    for k, (c, low, high) in enumerate(groups):
        place = F.when((F.col("c") == c) & _between(F.col("value"), low, high), F.lit(k)).otherwise(place)
    ordered = Window.partitionBy("k").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("k", place).where("k is not null").withColumn("upto", F.sum("n").over(ordered))
    asked = counts.sparkSession.createDataFrame(sorted({(k, rank) for k, rank, _ in wanted}), "k int, rank long")
    # one row per bracket and rank
    hits = upto.join(F.broadcast(asked), "k").where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    values = {(h.k, h["rank"]): h.value for h in hits.select("k", "rank", "value").collect()}
    for k, own in enumerate(groups.values()):
        for r in own:
            r.value = values[k, r.rank - r.below]


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> DataFrame:
    """Rows (column_name, probability, value); a column without values gives no rows. Nulls are skipped.

    Runs its jobs when it is called; the rows are few and known then.
    """
    if not columns:
        raise ValueError("no columns given")
    numbers = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    chosen = [float(p) for p in probabilities]
    sides = [min(max(p + shift, 0.0), 1.0) for p in chosen for shift in (-2 / ACCURACY, 2 / ACCURACY)]
    first = numbers.agg(
        *[F.count(c) for c in numbers.columns], *[F.percentile_approx(c, sides, ACCURACY) for c in numbers.columns]
    ).first()
    sizes, sketches = first[: len(columns)], first[len(columns) :]

    ends: dict[int, list[float]] = {i: sorted(set(s)) for i, (size, s) in enumerate(zip(sizes, sketches)) if size}
    schema = "column_name string, probability double, value double"
    if not ends:
        return df.sparkSession.createDataFrame([], schema)
    counted = numbers.agg(
        *[F.count_if(t) for i, own in ends.items() for x in own for t in (F.col(f"v{i}") < x, F.col(f"v{i}") <= x)]
    ).first()
    at = iter(counted)
    told = {i: [(x, next(at), next(at)) for x in own] for i, own in ends.items()}

    quantiles, ranks = [], []
    for i in ends:
        for p, given in zip(chosen, probabilities):
            position = (sizes[i] - 1) * p
            pair = [_Rank(i, math.floor(position)), _Rank(i, math.ceil(position))]
            for r in pair:
                r.narrow(told[i])
            ranks += pair
            quantiles.append((columns[i], p, position - pair[0].rank, pair))
    if _open(ranks):
        counts = stored(_enclosed(numbers, ranks), "quantiles")
        _refine(counts, ranks)
        discard(counts)
    rows = [(name, p, low.value + (high.value - low.value) * weight) for name, p, weight, (low, high) in quantiles]
    return df.sparkSession.createDataFrame(rows, schema)


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact median per column; null for a column without values."""
    found = {r.column_name: r.value for r in exact_quantiles(df, columns, [0.5]).collect()}
    return {c: found.get(c) for c in columns}
