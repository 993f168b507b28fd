"""Stored pages and other tables of long texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(table: DataFrame) -> DataFrame:
    """A scanned table over at least as many tasks as the cluster has cores.

    Long texts are costly per row, and a file with one row group is one task
    however many cores wait. Tables of many files, the normal case at scale,
    have more scan tasks than cores and are left as they are, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    return spread(spark.read.parquet(path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``pages(page_id, url, html)``."""
    return read_texts(spark, path).select("page_id", "url", "html")
