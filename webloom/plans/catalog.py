"""Registered queries. Each has a Spark job and, where SQL can say it, a check in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from webloom.sources.pages import read_texts


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


# Tables whose rows are long texts, costly to work through.
LONG_TEXTS = ("pages", "documents")

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``. ``sql`` may use ``{table}`` for the given tables."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql and plain_sql(sql))
        return fn

    return register


def plain_sql(sql: str) -> str:
    """SQL with ``{table}`` replaced by the table's own name."""
    names = {field for _, field, _, _ in Formatter().parse(sql) if field}
    return sql.format(**{name: name for name in names})


class Tables:
    """The given tables, read with the columns a job asks for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        if name in LONG_TEXTS:
            return read_texts(self.spark, self.path(name))
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.read(name)

    def derive(self, sql: str, **more: DataFrame) -> DataFrame:
        """Result of SQL over ``{table}`` placeholders; the same text derives the check's input."""
        names = {field for _, field, _, _ in Formatter().parse(sql) if field} - set(more)
        return self.spark.sql(sql, **{name: self.read(name) for name in names}, **more)
