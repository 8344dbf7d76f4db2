"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditloom.functions.dates import parse_date
from creditloom.sources import schemas


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, fmt: str = "csv") -> DataFrame:
    """Scan a table with a stated schema. CSV files carry a header and are never sampled to infer types."""
    if fmt == "csv" and schema is None:
        raise ValueError("a CSV scan needs a schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
        return nan_to_null(reader.load(path))
    # other formats are written by this library without not-a-number; a wrapped column would keep filters from the scan
    return reader.load(path)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number means missing in the raw files, while Spark's max, median and deviation would return it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}) if floats else df


def require(df: DataFrame, columns: Iterable[str], table: str = "input") -> DataFrame:
    """Stop before any job runs when a column is missing, naming what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks the columns: {', '.join(missing)}")
    return df


def load_raw(
    spark: SparkSession,
    applications: str,
    accounts: str,
    transactions: str,
    application_format: str = "dd-MM-yyyy",
    account_format: str = "yyyy-MM-dd",
    transaction_format: str = "yyyy-MM-dd",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three raw CSV tables with their dates parsed strictly, each in its own format."""
    apps = read_table(spark, applications, schemas.APPLICATIONS)
    accs = read_table(spark, accounts, schemas.CREDIT_ACCOUNTS)
    txns = read_table(spark, transactions, schemas.TRANSACTIONS)
    return (
        apps.withColumn("application_date", parse_date(F.col("application_date"), application_format)),
        accs.withColumn("account_open_date", parse_date(F.col("account_open_date"), account_format)),
        txns.withColumn("transaction_date", parse_date(F.col("transaction_date"), transaction_format)),
    )


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)
