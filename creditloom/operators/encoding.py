"""Fitted column transformations: impute, flag, one-hot, standardise.

``fit`` looks at a table once and keeps a small state; ``expressions`` turns the state into SQL text per output column,
so that the same transformation runs as a DataFrame step and is saved inside a Spark ML pipeline.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators.profiling import mode
from creditloom.operators.quantiles import medians
from creditloom.operators.running import placed
from creditloom.operators.skew import spread_join
from creditloom.session import stored


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def quoted_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def real(value: float) -> str:
    return f"double('{float(value)!r}')"


@dataclass
class Step:
    """Output columns as SQL; ``drops`` are the inputs that do not go on. New columns come first or last."""

    drops: tuple[str, ...] = ()
    new_first: bool = False

    def expressions(self) -> dict[str, str]:
        raise NotImplementedError

    def select_list(self, columns: list[str]) -> list[tuple[str, str]]:
        """(output, SQL) for every column of the result, given the input's columns."""
        made = self.expressions()
        kept = [(c, made.get(c, quoted(c))) for c in columns if c not in self.drops]
        new = [(c, e) for c, e in made.items() if c not in columns or c in self.drops]
        return new + kept if self.new_first else kept + new

    def columns(self, columns: list[str]) -> list[str]:
        return [c for c, _ in self.select_list(columns)]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.expr(e).alias(c) for c, e in self.select_list(df.columns)])


@dataclass
class Expressions(Step):
    """Columns that need no fitting."""

    made: dict[str, str] = field(default_factory=dict)

    def expressions(self) -> dict[str, str]:
        return self.made


@dataclass
class Impute(Step):
    """Null becomes the fitted value (SQL literal) of its column; ``cast`` then sets a type."""

    values: dict[str, str] = field(default_factory=dict)
    cast: str | None = None

    def expressions(self) -> dict[str, str]:
        filled = {c: f"coalesce({quoted(c)}, {v})" for c, v in self.values.items()}
        return {c: f"cast({e} as {self.cast})" for c, e in filled.items()} if self.cast else filled


def fit_median(df: DataFrame, columns: list[str]) -> Impute:
    """Exact median per column; a column without any value keeps its nulls."""
    return Impute(values={c: real(v) for c, v in medians(df, columns).items() if v is not None})


def fit_mode(df: DataFrame, columns: list[str], cast: str | None = None) -> Impute:
    """Most frequent value per column, the smallest on a tie."""
    types = dict(df.dtypes)
    found = {r.column_name: r.value for r in mode(df, columns).collect()}
    return Impute(
        values={c: f"cast({quoted_text(found[c])} as {types[c]})" for c in columns if c in found}, cast=cast
    )


def sentinel_to_null(column: str, sentinel: float = 999.0) -> Expressions:
    """Flag column ``<column>_is_<n>``, and null in place of the stand-in value."""
    is_it = f"{quoted(column)} = {real(sentinel)}"
    return Expressions(
        made={
            column: f"case when {is_it} then null else {quoted(column)} end",
            f"{column}_is_{sentinel:g}": f"cast(coalesce({is_it}, false) as int)",
        }
    )


@dataclass
class OneHot(Step):
    """One column per category, named ``<column>_<category>``. A value not seen in fitting gives zeros throughout."""

    categories: dict[str, list[str | None]] = field(default_factory=dict)
    as_boolean: bool = False

    def expressions(self) -> dict[str, str]:
        made = {}
        for column, values in self.categories.items():
            for value in values:
                if value is None:
                    made[f"{column}_nan"] = self._shown(f"{quoted(column)} is null")
                else:
                    made[f"{column}_{value}"] = self._shown(f"coalesce({quoted(column)} = {quoted_text(value)}, false)")
        return made

    def _shown(self, condition: str) -> str:
        return condition if self.as_boolean else f"cast({condition} as int)"


def fit_one_hot(
    df: DataFrame,
    columns: list[str],
    drop_first: bool = False,
    as_boolean: bool = False,
    null_category: bool = True,
    new_first: bool = False,
    most: int = 5000,
) -> OneHot:
    """Sorted categories per column. Each becomes a column of the result, so more than ``most`` in all is an error;
    ``fit_sparse_one_hot`` has no such limit.

    ``null_category`` gives nulls a column of their own if there are any. ``drop_first`` leaves out the smallest
    category, and nulls then are zeros throughout.
    """
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    found = df.select(F.inline(F.array(*pairs))).distinct().limit(most + 1).collect() if columns else []
    if len(found) > most:
        raise ValueError(f"more than {most} categories in {', '.join(columns)}")
    categories: dict[str, list[str | None]] = {}
    for c in columns:
        known = sorted(r.value for r in found if r.column_name == c and r.value is not None)
        with_null = any(r.column_name == c and r.value is None for r in found)
        categories[c] = (known[1:] if drop_first else known) + ([None] if with_null and null_category else [])
    return OneHot(drops=tuple(columns), new_first=new_first, categories=categories, as_boolean=as_boolean)


@dataclass
class SparseOneHot:
    """Categories as places of one sparse vector, for more of them than a table can have columns.

    ``dictionary`` has a row (column_no, value, slot) per category, slots from 0 on in each column: sorted, null last.
    """

    columns: list[str]
    dictionary: DataFrame
    sizes: list[int]

    def names(self) -> DataFrame:
        """(slot, name): what stands at each place of the vector, named as ``OneHot`` names its columns."""
        starts = [sum(self.sizes[:i]) for i in range(len(self.sizes))]
        start, column = (F.array(*[F.lit(v) for v in values]) for values in (starts, self.columns))
        at = F.col("column_no")
        return self.dictionary.select(
            (start[at] + F.col("slot")).alias("slot"), F.concat(column[at], F.lit("_"), F.coalesce("value", F.lit("nan"))).alias("name")
        )

    def transform(self, df: DataFrame, key: str, output: str = "categories") -> DataFrame:
        """``df`` with the vector. A value not seen in fitting, or without a place, gives zeros throughout. Rows meet the
        dictionary by value; a value that very many rows share is spread over tasks by ``key``."""
        text, place = [], []
        for i, c in enumerate(self.columns):
            text.append(f"_text{i}")
            place.append(f"_place{i}")
            df = df.withColumn(text[i], F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")))
        for i, size in enumerate(self.sizes):
            own = self.dictionary.where(F.col("column_no") == i).select(
                F.coalesce(F.concat(F.lit("="), "value"), F.lit("")).alias(text[i]), F.col("slot").cast("double").alias(place[i])
            )
            df = spread_join(df, own, text[i], key, "left").fillna(float(size), [place[i]]).drop(text[i])
        used = [i for i, size in enumerate(self.sizes) if size]
        if not used:
            raise ValueError("no category in any column")
        vector = [f"_vector{i}" for i in used]
        last = df.sparkSession.createDataFrame([tuple(float(self.sizes[i] - 1) for i in used)], [place[i] for i in used])
        # one place beyond the last stands for values without a place, and is dropped
        encoder = OneHotEncoder(inputCols=last.columns, outputCols=vector, handleInvalid="keep", dropLast=True).fit(last)
        joined = VectorAssembler(inputCols=vector, outputCol=output).transform(encoder.transform(df))
        return joined.drop(*place, *vector)


def fit_sparse_one_hot(
    df: DataFrame, columns: list[str], drop_first: bool = False, null_category: bool = True
) -> SparseOneHot:
    """The categories of each column as a stored table; only their number per column comes to the driver. Options as for
    ``fit_one_hot``, without a limit on categories."""
    pairs = [
        F.struct(F.lit(i).alias("column_no"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(columns)
    ]
    found = df.select(F.inline(F.array(*pairs))).distinct().withColumn("is_null", F.col("value").isNull())
    if not null_category:
        found = found.where("not is_null")
    ordered = stored(placed(stored(found, "categories"), ["column_no", "is_null", "value"]), "dictionary")
    first = {r.column_no: (r.start, r.n, r.nulls) for r in ordered.groupBy("column_no").agg(
        F.min("place").alias("start"), F.count("*").alias("n"), F.count_if("is_null").alias("nulls")).collect()}
    out = [int(drop_first and c in first and first[c][1] > first[c][2]) for c in range(len(columns))]
    starts = F.array(*[F.lit(first.get(i, (0, 0, 0))[0] + out[i]) for i in range(len(columns))])
    slots = ordered.withColumn("slot", F.col("place") - starts[F.col("column_no")]).where("slot >= 0")
    sizes = [first.get(i, (0, 0, 0))[1] - out[i] for i in range(len(columns))]
    return SparseOneHot(list(columns), slots.select("column_no", "value", "slot"), sizes)


@dataclass
class Standardize(Step):
    """(x - mean) / population deviation; a constant column is only centred."""

    moments: dict[str, tuple[float, float]] = field(default_factory=dict)

    def expressions(self) -> dict[str, str]:
        return {
            c: f"(cast({quoted(c)} as double) - {real(mean)}) / {real(std)}" for c, (mean, std) in self.moments.items()
        }


def fit_standardize(df: DataFrame, columns: list[str]) -> Standardize:
    """Means and deviations of all columns in one pass."""
    if not columns:
        return Standardize()
    value = [f"cast({quoted(c)} as double)" for c in columns]
    row = df.selectExpr(*[f"{f}({v}) as {f}_{i}" for i, v in enumerate(value) for f in ("avg", "stddev_pop")]).first()
    pairs = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}
    return Standardize(
        moments={c: (mean, std if std else 1.0) for c, (mean, std) in pairs.items() if mean is not None}
    )


def apply_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    for step in steps:
        df = step.transform(df)
    return df
