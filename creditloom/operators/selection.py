"""Choosing and ordering columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {
    "number": T.NumericType,
    "string": T.StringType,
    "boolean": T.BooleanType,
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


def cols_of_type(df: DataFrame, kind: str) -> list[str]:
    """Names of the columns of a kind, in table order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, KINDS[kind])]


def order_columns(
    df: DataFrame, first: tuple[str, ...] = (), last: tuple[str, ...] = (), drop: tuple[str, ...] = ()
) -> DataFrame:
    """``first``, then the rest in table order, then ``last``; ``drop`` is left out."""
    moved = {*first, *last, *drop}
    return df.select(*first, *[c for c in df.columns if c not in moved], *last)


def transformed_first(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns, then the rest in table order."""
    return order_columns(df, first=tuple(columns))


def split_label(df: DataFrame, label: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Features without the label, and the label, both with the row key."""
    return df.drop(label), df.select(key, label)


def features_and_label(df: DataFrame, label: str, key: str) -> DataFrame:
    """(key, features, label): both parts of every row out of one scan; ``features`` is a struct of the other columns."""
    rest = [c for c in df.columns if c not in (label, key)]
    return df.select(key, F.struct(*rest).alias("features"), label)


def n_unique(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (column_name, n_unique) per column; nulls do not count.

    Each value goes to the task of its (column, value) pair, so no task holds all values of a column.
    """
    names = list(columns or df.columns)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, T.FractionalType)}

    def text(c: str) -> Column:
        return (F.col(f"`{c}`") + 0.0 if c in floats else F.col(f"`{c}`")).cast("string")  # -0.0 is 0.0

    pairs = [F.struct(F.lit(c).alias("column_name"), text(c).alias("value")) for c in names]
    values = df.select(F.inline(F.array(*pairs))).distinct()
    every = df.sparkSession.createDataFrame([(c, None) for c in names], "column_name string, value string")
    return values.unionByName(every).groupBy("column_name").agg(F.count("value").alias("n_unique"))


def scalable_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns, but for the excluded ones, with more than two distinct values.

    A third value lies between the smallest and the largest, so two plain passes tell, without any distinct count.
    """
    candidates = [c for c in cols_of_type(df, "number") if c not in exclude]
    if not candidates:
        return []
    numbers = df.selectExpr(*[f"cast(`{c}` as double) as v{i}" for i, c in enumerate(candidates)])
    ends = numbers.selectExpr(*[f"{f}({v}) as {f}_{v}" for v in numbers.columns for f in ("min", "max")]).first()
    inner = numbers.selectExpr(
        *[
            f"count_if({v} > double('{ends[f'min_{v}']}') and {v} < double('{ends[f'max_{v}']}')) as {v}"
            if ends[f"min_{v}"] is not None
            else f"count({v}) as {v}"
            for v in numbers.columns
        ]
    ).first()
    return [c for i, c in enumerate(candidates) if inner[i]]
