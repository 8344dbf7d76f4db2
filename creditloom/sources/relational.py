"""Relational source. Credentials come from the caller, never from the code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    user: str | None = None,
    password: str | None = None,
    driver: str | None = None,
    partition_column: str | None = None,
    lower: object = None,
    upper: object = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options. A partition column with bounds splits the read over executors.

    A query is pushed to the server as a derived table, because Spark refuses ``query`` with a partition column.
    """
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    split = (partition_column, lower, upper, partitions)
    if any(v is not None for v in split) and any(v is None for v in split):
        raise ValueError("a split read needs the column, both bounds and the number of partitions")
    options = {
        "url": url,
        "dbtable": table if table is not None else f"({query}) pushed",
        "user": user,
        "password": password,
        "driver": driver,
        "partitionColumn": partition_column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": partitions,
        "fetchsize": fetch_size,
        "pushDownAggregate": "true",
    }
    return {k: str(v) for k, v in options.items() if v is not None}


def read_jdbc(spark: SparkSession, **settings) -> DataFrame:
    """Lazy scan of a server table or query, with filters and columns pushed down."""
    return spark.read.format("jdbc").options(**jdbc_options(**settings)).load()
