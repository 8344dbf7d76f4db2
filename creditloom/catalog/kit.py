"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalog:
    """Named queries, each with the SQL it must agree with where there is such SQL."""

    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register

    def merge(self, *others: Catalog) -> Catalog:
        for other in others:
            for name, query in other.queries.items():
                self.add(name, other.sql.get(name))(query)
        return self


def comparable(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded and decimals turned into doubles, as the comparing SQL does; dates as ISO text."""

    def shown(f: T.StructField) -> str:
        name = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return f"round(cast({name} as double), {digits}) as {name}"
        if isinstance(f.dataType, T.DateType):
            return f"date_format({name}, 'yyyy-MM-dd') as {name}"
        return name

    return df.selectExpr(*[shown(f) for f in df.schema.fields])
