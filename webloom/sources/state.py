"""Versioned snapshots of the state relations, and changes between them.

A version is written below its own folder, in full or as the rows that changed
since the version before, and then committed by a small marker that names the
full version it builds on. Readers take the newest committed version, so a lost
job leaves no half version behind, and merge the changes as they read: of each
key the newest row holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Every so many versions a full one is written again.
FULL_EVERY = 16
# Keys of the crawl state; other relations have their URL as the key.
KEYS = {"boundary": ["parent_url", "child_url"]}


def current_version(spark: SparkSession, root: str) -> int | None:
    try:
        marks = spark.read.schema("version INT").json(f"{root}/commits/*")
        return marks.agg(F.max("version")).first()[0]
    except AnalysisException as fault:
        # Only a missing folder means that nothing was stored yet.
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _commit(spark: SparkSession, root: str, version: int, base: int) -> None:
    mark = spark.range(1).select(F.lit(version).alias("version"), F.lit(base).alias("base"))
    mark.coalesce(1).write.mode("overwrite").json(f"{root}/commits/{version}")


def write_state(relations: dict[str, DataFrame], root: str, version: int) -> None:
    """Write all relations as ``version``; an uncommitted earlier try is replaced."""
    spark = next(iter(relations.values())).sparkSession
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{root}/version={version}/{name}")
    _commit(spark, root, version, version)


def write_changes(spark: SparkSession, changes: dict[str, DataFrame], root: str, version: int, keys: dict[str, list[str]]) -> None:
    """Write new and changed rows as ``version``, on top of the version before.

    ``keys``: the key of every relation of the state. Relations that are not in
    ``changes`` stay as they are. Every ``FULL_EVERY`` versions the whole state is
    written, so a reader merges fewer changes than that.
    """
    base = _base(spark, root, version - 1)
    for name in keys:
        rows = changes.get(name)
        if rows is None:
            rows = spark.read.parquet(f"{root}/version={base}/{name}").limit(0)
        rows.write.mode("overwrite").parquet(f"{root}/version={version}/changed_{name}")
    if version - base >= FULL_EVERY:
        write_state({name: _merged(spark, root, name, base, version, key) for name, key in keys.items()}, root, version)
    else:
        _commit(spark, root, version, base)


def _base(spark: SparkSession, root: str, version: int) -> int:
    mark = spark.read.schema("version INT, base INT").json(f"{root}/commits/{version}").first()
    # Markers of earlier releases name no base: their versions are full.
    return version if mark["base"] is None else mark["base"]


def _merged(spark: SparkSession, root: str, name: str, base: int, version: int, key: list[str]) -> DataFrame:
    whole = spark.read.parquet(f"{root}/version={base}/{name}")
    if version == base:
        return whole
    read = lambda v: spark.read.schema(whole.schema).parquet(f"{root}/version={v}/changed_{name}").withColumn("_version", F.lit(v))
    changed = reduce(DataFrame.unionByName, [read(v) for v in range(base + 1, version + 1)])
    newest = changed.groupBy(*key).agg(F.max_by(F.struct(*whole.columns), "_version").alias("_row")).select("_row.*")
    return whole.join(newest.select(*key), key, "left_anti").select(*whole.columns).unionByName(newest)


def read_state(
    spark: SparkSession, root: str, names: list[str], version: int | None = None, keys: dict[str, list[str]] | None = None
) -> dict[str, DataFrame]:
    """The relations of a version, the newest by default. ``keys``: keys of the relations where they are not those of the crawl state."""
    if version is None:
        version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"no committed snapshot below {root}")
    base = _base(spark, root, version)
    return {name: _merged(spark, root, name, base, version, (keys or KEYS).get(name, ["url"])) for name in names}
