"""User hooks: transforms, URL filters, extractors, exporters, step chains, rule sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

Transform = Callable[[pd.Series, dict], pd.Series]
UrlFilter = Callable[[Column, dict], Column]
PandasUrlFilter = Callable[[pd.Series, dict], pd.Series]
Extractor = Callable[[str, str, dict], Iterable[tuple[str, str]]]


@dataclass
class Hooks:
    """Named user functions. They are shipped to the workers with the job that uses them."""

    transforms: dict[str, Transform] = field(default_factory=dict)
    url_filters: dict[str, tuple[Callable, bool]] = field(default_factory=dict)
    extractors: dict[str, Extractor] = field(default_factory=dict)

    def register_transform(self, name: str, fn: Transform) -> None:
        """``fn(values, config) -> values`` over Arrow batches of strings."""
        self.transforms[name] = fn

    def register_url_filter(self, name: str, fn: UrlFilter | PandasUrlFilter, python: bool = False) -> None:
        """``fn(url column, config) -> boolean column``; with ``python`` the same over pandas series."""
        self.url_filters[name] = (fn, python)

    def register_extractor(self, name: str, fn: Extractor) -> None:
        """``fn(html, url, config) -> (field, value) pairs``."""
        self.extractors[name] = fn

    def transform(self, name: str, column: Column, config: dict | None = None) -> Column:
        fn, config = self.transforms[name], config or {}
        return F.pandas_udf(lambda values: fn(values, config), "string")(column)

    def url_filter(self, column: Column, chain: Sequence[tuple[str, dict]]) -> Column:
        """All filters of the chain must pass. Column filters come first, so that
        Spark settles them before any Python worker is asked."""
        passed = F.lit(True)
        for name, config in sorted(chain, key=lambda c: self.url_filters[c[0]][1]):
            fn, python = self.url_filters[name]
            if python:
                passed = passed & F.pandas_udf(lambda urls, fn=fn, config=config: fn(urls, config), "boolean")(column)
            else:
                passed = passed & fn(column, config)
        return passed

    def extract(self, pages: DataFrame, name: str, config: dict | None = None) -> DataFrame:
        """(page_id, field, value) rows of a user extractor."""
        fn, config = self.extractors[name], config or {}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [
                    (page_id, key, value)
                    for page_id, url, html in batch.itertuples(index=False)
                    for key, value in fn(html or "", url, config)
                ]
                yield pd.DataFrame(rows, columns=["page_id", "field", "value"])

        return pages.select("page_id", "url", "html").mapInPandas(run, "page_id BIGINT, field STRING, value STRING")


@dataclass(frozen=True)
class Step:
    """A step of a chain: ``columns`` gives new values of columns, ``frame`` rewrites the relation."""

    name: str
    columns: Callable[[], dict[str, Column]] | None = None
    frame: Callable[[DataFrame], DataFrame] | None = None
    after: tuple[str, ...] = ()
    before: tuple[str, ...] = ()


def ordered_steps(steps: Sequence[Step]) -> list[Step]:
    """Steps in an order that keeps all constraints, else in the given one."""
    names = [s.name for s in steps]
    graph = {s.name: {a for a in s.after if a in names} for s in steps}
    for s in steps:
        for later in s.before:
            if later in graph:
                graph[later].add(s.name)
    sorter = TopologicalSorter(graph)
    sorter.prepare()
    order: list[str] = []
    ready: list[str] = []
    while sorter.is_active():
        ready = sorted([*ready, *sorter.get_ready()], key=names.index)
        order.append(ready.pop(0))
        sorter.done(order[-1])
    by_name = {s.name: s for s in steps}
    return [by_name[n] for n in order]


def run_chain(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply the steps. Rows with ``terminal`` keep their values in later steps.

    Terminal rows are guarded inside the expressions: the relation is read
    once and never split and united again.
    """
    if "terminal" not in df.columns:
        df = df.withColumn("terminal", F.lit(False))
    for step in ordered_steps(steps):
        if step.frame is not None:
            df = step.frame(df)
        if step.columns is not None:
            made = step.columns()
            old = {c: F.col(c) if c in df.columns else F.lit(None) for c in made}
            df = df.withColumns({c: F.when(F.col("terminal"), old[c]).otherwise(v) for c, v in made.items()})
    return df


def fetched_rules(locations: DataFrame, fetch: Callable[[dict], Iterable[tuple[str, str, str]]]) -> DataFrame:
    """Rule documents (source, path, content) that ``fetch(row)`` yields for every row of ``locations``.

    Spark reads and deals out the locations; the function is called where they are.
    """
    names = ["source", "path", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [found for item in batch.to_pylist() for found in fetch(item)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=names)

    return locations.mapInArrow(run, "source STRING, path STRING, content STRING")


class _CallWriter(DataSourceWriter):
    def __init__(self, write: Callable[[list[dict]], None], batch: int):
        self.call, self.batch = write, batch

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        items: list[dict] = []
        for row in iterator:
            items.append(row.asDict(recursive=True))
            if len(items) >= self.batch:
                self.call(items)
                items = []
        if items:
            self.call(items)
        return WriterCommitMessage()


def register_exporter(spark: SparkSession, name: str, write: Callable[[list[dict]], None], batch: int = 1000) -> None:
    """A sink ``name``: ``write(items)`` is called on the workers with batches of rows.

    Use it as ``df.write.format(name).mode("append").save()``. A task that is
    run again calls it again, so writers must accept repeated rows.
    """

    class Exporter(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return _CallWriter(write, batch)

    spark.dataSource.register(Exporter)
