"""Endpoint health and failure bursts over arriving events, in built-in operators.

Health is a windowed count behind a watermark. A burst needs the exact times of
the last failures, so each batch is joined by the stored failures that its
look-back reaches and judged by the batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators import windows as W
from webloom.session import stored
from webloom.sources.history import keep, recall

# Weighted failures in a window from which an endpoint counts as open.
FAILURE_LIMIT = 3


def endpoint_windows(df: DataFrame, size: str = "60 seconds", delay: str = "10 seconds", limit: int = FAILURE_LIMIT) -> DataFrame:
    """Weighted failures and successes of ``(endpoint, ts, kind, weight)`` per window, once the watermark has passed it.

    ``state`` is closed without failures, open from ``limit`` on, else degraded.
    Windows behind the last watermark are not emitted: that is append mode.
    """
    failed = F.col("kind") == "failure"
    counts = (
        df.withWatermark("ts", delay)
        .groupBy(F.window("ts", size).alias("w"), "endpoint")
        .agg(F.sum(F.when(failed, F.col("weight")).otherwise(0)).alias("failures"), F.count_if(~failed).alias("successes"))
    )
    state = F.when(F.col("failures") >= limit, "open").when(F.col("failures") > 0, "degraded").otherwise("closed")
    return counts.select("endpoint", F.col("w.start").alias("window_start"), "failures", "successes", state.alias("state"))


def burst_writer(spark: SparkSession, sink: str, n: int, seconds: int) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: alerts once per key of ``(key, us)`` below ``sink``.

    A batch writes its own folders and replaces them when it is run again. Rows
    may come late by any time: the days that their look-back reaches are read
    again, and no others.
    """
    span = seconds * 1_000_000

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch.select("key", "us"), "failures")
        first, last = rows.agg(F.min("us"), F.max("us")).first()
        reach = ((first or 0) - span, (last or 0) + span)
        near = recall(spark, f"{sink}/rows", batch_id, "key BIGINT, us BIGINT", *reach).where(F.col("us").between(*reach))
        told = recall(spark, f"{sink}/told", batch_id, "key BIGINT")
        opened = stored(W.bursts(rows.unionByName(near), "key", n, seconds).join(told, "key", "left_anti"), "opened")
        opened.select("key", "opened_us").write.mode("overwrite").parquet(f"{sink}/alerts/batch={batch_id}")
        keep(opened.select("key"), f"{sink}/told", batch_id)
        keep(rows, f"{sink}/rows", batch_id, "us")

    return write


def stream_bursts(df: DataFrame, sink: str, checkpoint: str, n: int = 10, seconds: int = 60):
    """Alert once per key of ``(key, us)`` when more than ``n`` failures lie within ``seconds``."""
    write = burst_writer(df.sparkSession, sink, n, seconds)
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
