"""One registry of named queries; a duplicate name is an error at registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Maps a unique name to a query and, where SQL can say the same, its oracle."""

    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}
        self._oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            if name in self._queries:
                raise ValueError(f"query {name!r} is already registered")
            self._queries[name] = fn
            if oracle is not None:
                self._oracles[name] = oracle
            return fn

        return add

    def queries(self) -> dict[str, Query]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._oracles)


REGISTRY = Registry()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table by name; the path goes to Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
