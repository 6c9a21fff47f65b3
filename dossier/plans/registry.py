"""How plan modules register a query with the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The driver's tables as attributes: t.orders is the DataFrame of orders.parquet."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(build: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
            if sql is not None:
                self.oracle[name] = sql
            return build

        return add
