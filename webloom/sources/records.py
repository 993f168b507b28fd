"""Crawl records as JSON Lines, the crawl report, and crawl logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.functions.urls import let

SCHEMA_VERSION = 1
CORRUPT = "_corrupt"

RECORD_COLUMNS = {
    "url": "STRING",
    "depth": "INT",
    "text": "STRING",
    "ts": "TIMESTAMP",
    "extraction_type": "STRING",
    "title": "STRING",
    "fields": "MAP<STRING, ARRAY<STRING>>",
    "schema_org": "STRING",
}


def write_records(df: DataFrame, path: str, gzip: bool = False, resume: bool = False) -> None:
    """A fresh run replaces the dataset, a resumed one adds to it.

    The schema version is a side dataset below ``_schema``, which readers of
    the folder skip.
    """
    if isinstance(df.schema["schema_org"].dataType, T.VariantType):
        df = df.withColumn("schema_org", F.to_json("schema_org"))
    writer = df.write.mode("append" if resume else "overwrite")
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.json(path)
    version = df.sparkSession.range(1).select(F.lit(SCHEMA_VERSION).alias("version"))
    version.coalesce(1).write.mode("overwrite").json(f"{path}/_schema")


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt lines) of a dataset or a foreign file with a version line."""
    columns = {**RECORD_COLUMNS, "_schema": "STRING", CORRUPT: "STRING"}
    schema = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE").json(path)
    records = rows.where(f"{CORRUPT} IS NULL AND _schema IS NULL").select(*RECORD_COLUMNS)
    # Spark does not read the corrupt column alone, so the filter names another one too.
    corrupt = rows.where(f"{CORRUPT} IS NOT NULL AND (_schema IS NULL OR length(_schema) >= 0)").select(F.col(CORRUPT).alias("line"))
    return records, corrupt


def write_report(report: DataFrame, domains: DataFrame, path: str) -> None:
    """The one-row report as one JSON document, figures per domain as JSON Lines beside it."""
    report.select(F.to_json("report").alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/report")
    domains.write.mode("overwrite").json(f"{path}/domains")


def _logfmt_pairs(line: Column) -> Column:
    """Map of the pairs of a line; of repeated keys the first counts."""
    pair = F.lit(r'([^\s="]+)=("(?:[^"\\]|\\.)*+"|\S*)')
    keys = F.regexp_extract_all(line, pair, F.lit(1))
    values = F.transform(
        F.regexp_extract_all(line, pair, F.lit(2)),
        lambda v: F.when(
            F.startswith(v, F.lit('"')),
            F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r'\\(["\\])', "$1"),
        ).otherwise(v),
    )
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))

    def first_per_key(pairs: Column) -> Column:
        return let(
            F.transform(pairs, lambda p: p["k"]),
            lambda ks: F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(ks, p["k"]) == i + 1)),
        )

    return let(pairs, first_per_key)


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Structured rows of logfmt or JSON log lines: ts, level, logger, event and the other pairs."""
    line = F.col(column)
    kv = F.when(F.startswith(F.ltrim(line), F.lit("{")), F.from_json(line, "map<string,string>")).otherwise(_logfmt_pairs(line))
    named = lines.select(line.alias("line"), kv.alias("kv"))
    plain_ts = F.regexp_extract("line", r"^ts=(.+?) level=", 1)
    ts = F.coalesce(F.nullif(plain_ts, F.lit("")), F.try_element_at("kv", F.lit("ts")))

    def of(key: str) -> Column:
        return F.try_element_at("kv", F.lit(key)).alias(key)

    meta = ("ts", "level", "logger", "event")
    rest = F.map_filter("kv", lambda k, _v: ~k.isin(*meta))
    return named.select(
        F.replace(ts, F.lit(","), F.lit(".")).try_cast("timestamp").alias("ts"), of("level"), of("logger"), of("event"), rest.alias("kv")
    ).where("level IS NOT NULL")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))
