"""Streaming jobs built from Spark's own stream operators and ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.functions import urls as U
from webloom.operators import frontier as FR
from webloom.operators.windows import HASH_TTL_S, ttl_dedup
from webloom.plans.records import crawl_records, saved_records
from webloom.session import stored
from webloom.sources.history import keep, recall
from webloom.sources.state import KEYS, current_version, read_state, write_changes, write_state

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"
EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(query_writer) -> None:
    """Process what is there now, then stop."""
    query: StreamingQuery = query_writer.trigger(availableNow=True).start()
    query.awaitTermination()


def batch_time_us(spark: SparkSession, root: str, batch_id: int) -> int:
    """The time of the first attempt of a batch, stored below ``root``; later attempts read it."""
    path = f"{root}/batch={batch_id}"
    try:
        known = spark.read.schema("us BIGINT").json(path).first()
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    if known:
        return known["us"]
    spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("us")).coalesce(1).write.mode("overwrite").json(path)
    return spark.read.schema("us BIGINT").json(path).first()["us"]


def record_writer(spark: SparkSession, snapshot: DataFrame, sink: str, ttl_s: int = HASH_TTL_S) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: pages to new records under ``sink``.

    A batch writes its own folder and replaces it when it is run again. Its
    hashes are anti-joined with those that earlier batches stored within the
    last ``ttl_s`` seconds, so a page that comes back later is new; only the days
    within reach are read. The time of a batch is that of its first attempt, so
    a second one judges the same hashes live. Pages without a hash go round the
    join.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        marked = saved_records(crawl_records(batch, snapshot)).where("is_new")
        now = batch_time_us(spark, f"{sink}/times", batch_id)
        oldest = now - ttl_s * 1_000_000
        seen = recall(spark, f"{sink}/hashes", batch_id, "content_hash STRING, us BIGINT", oldest, now).where(F.col("us") > oldest)
        hashed = marked.where("content_hash IS NOT NULL").join(seen.select("content_hash"), "content_hash", "left_anti")
        fresh = hashed.unionByName(marked.where("content_hash IS NULL"))
        out = fresh.select(
            "page_id", "url", F.lit(0).alias("depth"), "text", "extraction_type", "title", "fields",
            F.to_json("schema_org").alias("schema_org"), "content_hash",
        )
        path = f"{sink}/records/batch={batch_id}"
        out.write.mode("overwrite").json(path)
        written = spark.read.schema("content_hash STRING").json(path).where("content_hash IS NOT NULL")
        keep(written.withColumn("us", F.lit(now).cast("bigint")), f"{sink}/hashes", batch_id, "us")

    return write


def stream_pages(pages: DataFrame, snapshot: DataFrame, sink: str, checkpoint: str):
    """Arriving pages to records: match, parse, extract, transform, drop copies, write."""
    write = record_writer(pages.sparkSession, snapshot, sink)
    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def sight_writer(spark: SparkSession, sink: str, ttl_s: int = HASH_TTL_S) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: rows ``(hash, id, us)`` that are new, below ``sink/rows``.

    The entry of a hash expires ``ttl_s`` after it was first seen, by the times of
    the rows. Sights are kept by day; a batch reads the days that the TTL reaches
    from its own rows. A row within the TTL of a stored sight, on either side, is
    a repeat: a late row cannot take back a later sight. What remains is judged
    by the batch job, so in order of time batches give what one batch gives.
    """
    ttl_us = ttl_s * 1_000_000

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where("hash IS NOT NULL AND us IS NOT NULL")
        first, last = rows.agg(F.min("us"), F.max("us")).first()
        sights = recall(spark, f"{sink}/sights", batch_id, "hash STRING, us BIGINT", (first or 0) - ttl_us, (last or 0) + ttl_us)
        # A sight meets the rows of the spans of time it reaches, so a busy hash is split over time.
        reach = F.sequence(F.floor((F.col("us") - ttl_us) / ttl_us), F.floor((F.col("us") + ttl_us) / ttl_us))
        live = sights.select("hash", F.col("us").alias("_seen"), F.explode(reach).alias("_span"))
        near = F.abs(F.col("us") - F.col("_seen")) <= ttl_us
        asked = rows.withColumn("_span", F.floor(F.col("us") / ttl_us)).alias("r")
        open_rows = asked.join(live.alias("s"), (F.col("r.hash") == F.col("s.hash")) & (F.col("r._span") == F.col("s._span")) & near, "left_anti")
        path = f"{sink}/rows/batch={batch_id}"
        ttl_dedup(open_rows.select("hash", "id", "us"), ttl_s).write.mode("overwrite").parquet(path)
        keep(spark.read.schema("hash STRING, us BIGINT").parquet(path), f"{sink}/sights", batch_id, "us")

    return write


def stream_dedup(df: DataFrame, sink: str, checkpoint: str, ttl_s: int = HASH_TTL_S):
    """Drop repeats of ``(hash, id, us)`` until their entry has expired."""
    write = sight_writer(df.sparkSession, sink, ttl_s)
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_outcomes(df: DataFrame, size: str = "5 seconds", slide: str | None = None, delay: str = "10 seconds") -> DataFrame:
    """Outcome counts of ``(ts, outcome)`` per window, emitted once the watermark has passed it."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        df.withWatermark("ts", delay)
        .groupBy(window.alias("w"), "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "outcome", "n")
    )


def stream_timeouts(df: DataFrame, seconds: int = 300, delay: str = "10 seconds") -> DataFrame:
    """Starts of ``(url, us, kind)`` without an end of the same URL within ``seconds``.

    An outer join of the stream with itself, bounded in time: a start leaves
    the state when its end comes or the watermark has passed its timeout.
    """
    timed = df.withColumn("ts", F.timestamp_micros("us"))
    starts = timed.where("kind = 'start'").select("url", "us", "ts").withWatermark("ts", delay)
    ends = (
        timed.where("kind = 'end'")
        .select(F.col("url").alias("end_url"), F.col("ts").alias("end_ts"))
        .withWatermark("end_ts", delay)
    )
    ended = F.expr(f"url = end_url AND end_ts >= ts AND end_ts <= ts + INTERVAL {seconds} SECONDS")
    joined = starts.join(ends, ended, "left_outer")
    return joined.where("end_url IS NULL").select("url", F.col("us").alias("started_us"))


STATE_NAMES = ["urls", "queue", "failures", "in_flight", "boundary"]
STATE_DDL = {
    "urls": "url STRING, depth INT, status STRING, added_time TIMESTAMP, completed_time TIMESTAMP, outcome STRING",
    "queue": "id BIGINT, url STRING, depth INT, added_time TIMESTAMP, domain STRING",
    "failures": "url STRING, depth INT, error STRING, ts TIMESTAMP, requeue_count INT",
    "in_flight": "url STRING, depth INT, started_at TIMESTAMP",
    "boundary": "parent_url STRING, child_url STRING, parent_depth INT",
}
STATE_KEYS = {name: KEYS.get(name, ["url"]) for name in STATE_NAMES}


def frontier_writer(
    spark: SparkSession, root: str, patterns: tuple[str, ...] = (), max_depth: int = 3, cap: int | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: admit ``(seq, parent_url, url, depth)`` against the stored state.

    Batch n reads version n and commits version n+1 as changes to it: what it
    writes grows with the batch, not with the queue. Run again it writes the same
    version, since it reads by batch id. Version 0 is the state the stream
    starts from.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        state = read_state(spark, root, STATE_NAMES, batch_id)
        judged = FR.admit(
            batch.select("seq", "parent_url", "url", "depth"),
            state["urls"], state["queue"], state["in_flight"], patterns, max_depth, cap,
        )
        judged = stored(judged, "judged")
        now = F.timestamp_micros(F.lit(batch_time_us(spark, f"{root}/times", batch_id)))
        admitted = judged.where("verdict = 'enqueued'").select(
            F.col("seq").alias("id"), "url", "depth", now.alias("added_time"), U.domain_of("url").alias("domain")
        )
        edges = judged.where("verdict = 'boundary'").select(
            "parent_url", F.col("url").alias("child_url"), (F.col("depth") - 1).alias("parent_depth")
        )
        again, failures = FR.retry_reclaim(state["failures"], state["queue"], state["in_flight"], state["urls"])
        again = stored(again, "again")
        retried = again.join(admitted, "url", "left_anti").select(
            F.lit(None).cast("bigint").alias("id"), "url", "depth", now.alias("added_time"), "domain"
        )
        pair = ["parent_url", "child_url"]
        changes = {
            "queue": admitted.unionByName(retried),
            "failures": failures.join(again.select("url"), "url", "left_semi"),
            "boundary": edges.dropDuplicates(pair).join(state["boundary"], pair, "left_anti"),
        }
        write_changes(spark, {n: df.select(*state[n].columns) for n, df in changes.items()}, root, batch_id + 1, STATE_KEYS)

    return write


def start_state(spark: SparkSession, root: str, **relations: DataFrame) -> None:
    """Version 0: the given relations, the others empty."""
    if current_version(spark, root) is None:
        full = {n: relations.get(n, spark.createDataFrame([], STATE_DDL[n])) for n in STATE_NAMES}
        write_state(full, root, 0)


def stream_frontier(edges: DataFrame, root: str, checkpoint: str, **settings):
    """Arriving links admitted batch by batch."""
    write = frontier_writer(edges.sparkSession, root, **settings)
    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
