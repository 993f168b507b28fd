"""Order-dependent work that does not need one task per key.

A plain ``row_number`` or running sum over a key sends all rows of that key to
one task, and without a key all rows to one task. The jobs here split every key
into ordered buckets: bucket totals are summed first (small, partial sums on
the map side), then each bucket is numbered on its own and shifted by the total
of the buckets before it. ``bucket`` must not decrease along ``order_by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import stored

# Rows with neighbouring ids per bucket.
BUCKET_ROWS = 1_000_000


def id_bucket(id_col: Column | str, rows: int = BUCKET_ROWS) -> Column:
    id_col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.floor(id_col / F.lit(rows)).cast("bigint")


def in_ranges(df: DataFrame, order_by: Sequence[Column | str]) -> DataFrame:
    """``df`` stored in ranges of the order with about equal numbers of rows: ``_part`` rises along it, ``_at`` within.

    Spark samples the order for the splitters, so a busy hour or key makes more
    ranges and not larger ones. ``_part`` has one value per partition of the
    job; it is a bucket for the functions here, and a window over the parts
    alone has as many rows as the job had tasks. The order should be total.
    """
    dealt = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    # The upper bits of the rising ids are the number of the partition.
    return stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright("_at", 33))


def running_sum(
    df: DataFrame,
    value: Column,
    order_by: Sequence[Column | str],
    bucket: Column,
    name: str,
    partition_by: Sequence[str] = (),
    include_current: bool = True,
    totals_of: DataFrame | None = None,
) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before (and with) each row.

    ``totals_of``: a cheaper relation with the same bucket totals and all buckets.
    """
    keys = [*partition_by, "_bucket"]
    marked = df.withColumn("_bucket", bucket).withColumn("_value", value)
    before = Window.partitionBy(*partition_by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    source = marked if totals_of is None else totals_of.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = source.groupBy(*keys).agg(F.sum("_value").alias("_total"))
    offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    end = Window.currentRow if include_current else -1
    inside = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, end)
    return (
        marked.join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .drop("_bucket", "_value", "_offset")
    )


def numbered(
    df: DataFrame, order_by: Sequence[Column | str], bucket: Column, name: str = "rn", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Row numbers from 1 per key, for a unique order."""
    return running_sum(df, F.lit(1), order_by, bucket, name, partition_by)


def ordered_take(df: DataFrame, n: int, order_by: Sequence[Column | str], bucket: Column) -> DataFrame:
    """The first ``n`` rows in order. Buckets that start after row ``n`` are never sorted."""
    marked = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_bucket").orderBy(*order_by)
    return (
        marked.join(offsets.where(F.col("_offset") < n), "_bucket")
        .withColumn("_rn", F.col("_offset") + F.row_number().over(inside))
        .where(F.col("_rn") <= n)
        .drop("_bucket", "_offset", "_rn")
    )


def with_lookback(df: DataFrame, time_us: str, lookback_us: int, bucket_us: int | None = None) -> DataFrame:
    """Rows keyed by time bucket, each repeated in the buckets its lookback reaches.

    ``_bucket`` and the key partition a window whose frame reaches back at most
    ``lookback_us``; only rows with ``_own`` are results. A busy key is split
    over time, and no frame loses rows.
    """
    width = bucket_us or max(lookback_us * 4, 1)
    own = F.floor(F.col(time_us) / width).cast("bigint")
    last = F.floor((F.col(time_us) + lookback_us) / width).cast("bigint")
    return df.withColumn("_bucket", F.explode(F.sequence(own, last))).withColumn("_own", F.col("_bucket") == own)


# Rows, and bytes written as JSON, of a relation that every executor may hold.
SMALL_ROWS, SMALL_BYTES = 200_000, 64 << 20


def checked_side(stored_rows: DataFrame) -> DataFrame:
    """A stored side of a join, to be broadcast if it is small in rows and bytes; beyond that Spark decides by size."""
    rows, size = stored_rows.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(stored_rows) if rows <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else stored_rows


# Rows of one key that a single task joins.
ROWS_PER_SALT = 1_000_000


def hot_keys(df: DataFrame, on: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys with more rows than ``rows_per_salt`` and the number of parts they need.

    The counts are summed on the map side. At most one key per ``rows_per_salt``
    rows can be listed, a hundred thousand for 10^11 rows, so the list is small
    enough to broadcast whatever the data.
    """
    return (
        df.where(F.col(on).isNotNull())
        .groupBy(on)
        .agg(F.ceil(F.count(F.lit(1)) / rows_per_salt).cast("int").alias("_parts"))
        .where("_parts > 1")
    )


def salted_join(
    left: DataFrame, right: DataFrame, on: str, spread_by: Column, how: str = "left", hot: DataFrame | None = None
) -> DataFrame:
    """Join in which one key of ``left`` may hold a large share of the rows.

    The rows of a hot key are split over as many partitions as they need, and
    only the ``right`` rows of that key are repeated; all other keys join as
    usual. ``hot`` is a ready list of hot keys, for joins in a loop.
    """
    listed = F.broadcast(hot_keys(left, on) if hot is None else hot)
    parts = F.coalesce("_parts", F.lit(1))
    spread = left.join(listed, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread_by), parts).cast("int"))
    repeated = right.join(listed, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.drop("_parts").join(repeated.drop("_parts"), [on, "_salt"], how).drop("_salt")
