"""How a module of queries is written down: each query beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder by name: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        """Register a function of the tables under ``name``, with the SQL that gives the same rows."""

        def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            if name in self.queries:
                raise ValueError(f"two queries of the name {name}")
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if sql is not None:
                self.oracles[name] = sql
            return f

        return keep


def r(x: Column, digits: int = 9) -> Column:
    """Rounded, so that the order in which partial sums meet does not show."""
    return F.round(x, digits)
