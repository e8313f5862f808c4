"""What the query modules share: table access and the shape of a registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Named queries over a folder of tables, and the SQL that says the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(f: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(ship(spark), sf_dir)

            run.__name__, run.__doc__ = name, f.__doc__
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return f

        return register
