"""Rows set aside from training, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """True for rows of one fold of the ids' checksums; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def some_per_label(rows: DataFrame, key: str, label: str, most: int) -> DataFrame:
    """At most ``most`` distinct (key, label) of each label, by the hash of the key. Cut in every task before the last shuffle."""
    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    return rows.select(key, label).distinct().withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= most).drop("_rn")
