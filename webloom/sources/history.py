"""What stream batches keep for later ones, by event day, in few folders.

Batch n writes ``level=0/part=n/day=d``. Whenever a batch number is a multiple
of ``MERGED ** l``, the last ``MERGED`` parts of level l - 1 are first written
together as one part of level l. What batch n may see, the rows of batches
before it, is then named by the digits of n alone: at most ``MERGED - 1`` parts
of each level, and of those the days that are asked for. Nothing is listed or
deleted, and a batch that is run again reads and writes the same folders.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGED = 8
DAY_US = 86_400_000_000
# Days named one by one; a wider reach reads all days of its parts and filters them.
NAMED_DAYS = 400


def _parts(batch_id: int) -> list[str]:
    """Folders with the rows of all batches before ``batch_id``."""
    parts, level, first = [], 0, batch_id
    while first:
        rest = first // MERGED
        parts += [f"level={level}/part={p}" for p in range(rest * MERGED, first)]
        level, first = level + 1, rest
    return parts


def _read(spark: SparkSession, root: str, parts: list[str], days: str, schema: str) -> DataFrame:
    """Rows below some parts; none if there are none. Other faults are raised."""
    try:
        pattern = f"{root}/{{{','.join(parts)}}}/{days}"
        return spark.read.schema(f"{schema}, level INT, part BIGINT, day BIGINT").option("basePath", root).parquet(pattern)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{schema}, day BIGINT")


def day_of(us):
    return F.floor(us / DAY_US).cast("bigint")


def keep(df: DataFrame, root: str, batch_id: int, us: str | None = None) -> None:
    """Write the rows of a batch, by the day of column ``us`` (microseconds; None: all together)."""
    spark, schema = df.sparkSession, df.schema.toDDL()
    level, first = 1, batch_id
    while first and first % MERGED == 0:
        last = first // MERGED
        parts = [f"level={level - 1}/part={p}" for p in range(first - MERGED, first)]
        rows = _read(spark, root, parts, "day=*", schema).drop("level", "part")
        rows.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{root}/level={level}/part={last - 1}")
        level, first = level + 1, last
    day = F.lit(0) if us is None else F.coalesce(day_of(F.col(us)), F.lit(0))
    df.withColumn("day", day).write.mode("overwrite").partitionBy("day").parquet(f"{root}/level=0/part={batch_id}")


def recall(spark: SparkSession, root: str, batch_id: int, schema: str, first_us: int | None = None, last_us: int | None = None) -> DataFrame:
    """Rows that batches before ``batch_id`` kept, of the days from ``first_us`` to ``last_us`` (None: of all days)."""
    parts = _parts(batch_id)
    if not parts:
        return spark.createDataFrame([], schema)
    if first_us is None or last_us is None:
        return _read(spark, root, parts, "day=*", schema).select(*_names(schema))
    first, last = first_us // DAY_US, last_us // DAY_US
    named = last - first < NAMED_DAYS
    rows = _read(spark, root, parts, f"day={{{','.join(map(str, range(first, last + 1)))}}}" if named else "day=*", schema)
    return rows.where(F.col("day").between(first, last)).select(*_names(schema))


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]
