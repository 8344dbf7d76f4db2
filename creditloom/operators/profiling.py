"""Table profiles. Every result has one row per column, per value or per table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.operators.quantiles import exact_quantiles
from creditloom.operators.selection import cols_of_type, n_unique

__all__ = [
    "all_counts", "class_ratio", "describe", "info", "mode", "n_unique", "null_counts", "profile", "ranges", "sentinel_report",
    "shape", "top_k", "value_counts",
]

QUARTILES = (0.25, 0.5, 0.75)


def _per_column(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    """One pass over the table; then one row per column with the measures, each a function of the column."""
    wide = df.agg(
        *[measure(F.col(f"`{c}`")).alias(f"{m}_{i}") for i, c in enumerate(columns) for m, measure in measures.items()]
    )
    rows = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{m}_{i}").alias(m) for m in measures])
        for i, c in enumerate(columns)
    ]
    return wide.select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """Rows per value, most frequent first, without nulls; ``normalize`` gives percent of the counted rows."""
    known = df.where(F.col(column).isNotNull())
    counts = known.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        total = known.agg(F.count(F.lit(1))).scalar()
        counts = counts.select(column, (F.col("n") / total * 100).alias("percent"))
    return counts.orderBy(F.col(counts.columns[1]).desc(), column)


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; on equal counts the smaller value first."""
    return value_counts(df, column).limit(k)


def mode(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (column_name, value) with each column's most frequent value as text; the smallest on a tie.

    Values are counted where they are, by pair of column and value. The tie is settled in the column's own order.
    """
    numbers = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}

    def pair(c: str) -> Column:
        # whole numbers stay such: as doubles, large ones would lose their order
        whole = isinstance(numbers.get(c), T.IntegralType)
        integer = F.col(c).cast("long") if whole else F.lit(None).cast("long")
        number = F.col(c).cast("double") if c in numbers and not whole else F.lit(None).cast("double")
        return F.struct(
            F.lit(c).alias("column_name"), integer.alias("whole"), number.alias("number"), F.col(c).cast("string").alias("value")
        )

    counted = (
        df.select(F.explode(F.array(*[pair(c) for c in columns])).alias("p"))
        .where(F.col("p.value").isNotNull())
        .groupBy("p.column_name", "p.whole", "p.number", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    best = F.min(F.struct(-F.col("n"), F.col("whole"), F.col("number"), F.col("value")))
    return counted.groupBy("column_name").agg(best.alias("best")).select("column_name", "best.value")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact interpolated quartiles and maximum per numeric column."""
    names = columns or cols_of_type(df, "number")
    basics = _per_column(
        df,
        names,
        {
            "count": F.count,
            "mean": lambda c: F.avg(c.cast("double")),
            "std": lambda c: F.stddev_samp(c.cast("double")),
            "min": lambda c: F.min(c.cast("double")),
            "max": lambda c: F.max(c.cast("double")),
        },
    )
    quartiles = exact_quantiles(df, names, list(QUARTILES)).groupBy("column_name").agg(
        *[F.max(F.when(F.col("probability") == p, F.col("value"))).alias(f"p{p * 100:.0f}") for p in QUARTILES]
    )
    # one row per column on either side
    return basics.join(F.broadcast(quartiles), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def null_counts(df: DataFrame, columns: list[str] | None = None, only_missing: bool = False) -> DataFrame:
    counts = _per_column(df, list(columns or df.columns), {"n_null": lambda c: F.count_if(c.isNull())})
    return counts.where(F.col("n_null") > 0) if only_missing else counts


def ranges(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = columns or cols_of_type(df, "number")
    return _per_column(
        df, names, {"min": lambda c: F.min(c.cast("double")), "max": lambda c: F.max(c.cast("double"))}
    )


def sentinel_report(df: DataFrame, columns: list[str], sentinel: float = 999.0) -> DataFrame:
    """How often the stand-in value occurs per column, next to the largest value."""
    return _per_column(
        df,
        columns,
        {"n_sentinel": lambda c: F.count_if(c == sentinel), "max": lambda c: F.max(c.cast("double"))},
    )


def class_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives, positives, and negatives per positive (null without positives)."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives")
    )
    return counts.withColumn("ratio", F.try_divide("negatives", "positives"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"))


def info(df: DataFrame) -> DataFrame:
    """Position, type and non-null count per column."""
    types = {f.name: (i, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)}
    counts = _per_column(df, df.columns, {"n_known": F.count})
    place = F.create_map(*[F.lit(v) for c, (i, t) in types.items() for v in (c, i)])
    kind = F.create_map(*[F.lit(v) for c, (i, t) in types.items() for v in (c, t)])
    name = F.col("column_name")
    return counts.select(place[name].alias("position"), name, kind[name].alias("type"), "n_known")


def all_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (column_name, value, n) for every value of the columns, as text and without nulls; one pass, no ordering."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    counted = df.select(F.explode(F.array(*pairs)).alias("p")).where(F.col("p.value").isNotNull())
    return counted.groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, label: str | None = None, k: int = 10) -> dict[str, Callable[[], DataFrame]]:
    """All profile tables by name. Each is made when it is called, so that nobody pays for quartiles they do not read."""
    texts = cols_of_type(df, "string")
    tables: dict[str, Callable[[], DataFrame]] = {
        "shape": lambda: shape(df),
        "info": lambda: info(df),
        "describe": lambda: describe(df),
        "null_counts": lambda: null_counts(df),
        **{f"top_{c}": lambda c=c: top_k(df, c, k) for c in texts},
    }
    if texts:
        tables["n_unique"] = lambda: n_unique(df, texts)
        tables["counts"] = lambda: all_counts(df, texts)
    if label:
        tables["label_counts"] = lambda: value_counts(df, label)
        tables["label_shares"] = lambda: value_counts(df, label, normalize=True)
    return tables
