"""Streaming jobs run over the stored tables until all is processed, compared with batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.plans.catalog import Tables, query
from webloom.plans.inputs import EDGES_SQL, EV_SQL, SEEDS_SQL
from webloom.plans.rule_queries import MATCH_SQL, page_rules
from webloom.session import scratch_path
from webloom.streaming import jobs as J
from webloom.streaming import stateful as S


def _arriving(t: Tables, name: str) -> str:
    """Path of a table as a pattern, which a file stream takes for a file and a folder alike."""
    return t.path(name) + "*"


def _events(t: Tables):
    k = F.regexp_extract("props", "[0-9]+", 0)
    raw = J.read_stream(t.spark, _arriving(t, "events"), J.EVENTS_SCHEMA)
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        "event_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), "user_id", "event_type", "value", k.cast("int").alias("k"),
        F.concat(F.lit("https://s"), "user_id", F.lit(".example.com/"), k).alias("url"),
    )


def _drained(t: Tables, stream, name: str, ddl: str):
    """Run a stream into parquet files of the shared folder and read them."""
    out = scratch_path(t.spark, name)
    J.run_available(stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint"))
    return t.spark.read.schema(ddl).parquet(f"{out}/rows")


@query(
    "stream_pages",
    f"""WITH {MATCH_SQL}, x AS (SELECT page_id, CASE WHEN rule IN ('default', 'french') THEN 'default' ELSE rule END AS extraction_type,
      regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav, regexp_replace(replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '&quot;', '"'), '[\\s]*<[^>]*>[\\s]*', '|', 'g') AS body FROM m JOIN u USING (page_id)),
    n AS (SELECT extraction_type, row_number() OVER (PARTITION BY extraction_type = 'default', extraction_type = 'com-all', body, CASE WHEN extraction_type = 'default' THEN '' ELSE nav END ORDER BY page_id) AS rn FROM x)
    SELECT extraction_type, count(*) AS records FROM n WHERE rn = 1 GROUP BY 1""",
)
def stream_pages(t: Tables):
    out = scratch_path(t.spark, "stream-pages")
    pages = J.read_stream(t.spark, _arriving(t, "pages"), J.PAGES_SCHEMA)
    J.run_available(J.stream_pages(pages, page_rules(t), out, f"{out}/checkpoint"))
    records = t.spark.read.schema("extraction_type STRING").json(f"{out}/records")
    return records.groupBy("extraction_type").agg(F.count("*").alias("records"))


@query(
    "stream_dedup_ttl",
    f"""WITH RECURSIVE {EV_SQL}, e AS (SELECT md5(user_id || event_type) AS hash, event_id AS id, us FROM ev),
    kept(hash, r) AS (SELECT hash, min({{{{'us': us, 'id': id}}}}) FROM e GROUP BY hash
      UNION ALL SELECT kept.hash, min({{{{'us': e.us, 'id': e.id}}}}) FROM kept JOIN e ON e.hash = kept.hash AND e.us - kept.r.us > 86400000000 GROUP BY kept.hash)
    SELECT hash, r.id AS id, r.us AS us FROM kept""",
)
def stream_dedup_ttl(t: Tables):
    """Sights of a month, so most hashes come back after their entry has expired."""
    key = F.md5(F.concat(F.col("user_id").cast("string"), "event_type").cast("binary"))
    rows = _events(t).select(key.alias("hash"), F.col("event_id").alias("id"), "us")
    out = scratch_path(t.spark, "stream-dedup")
    J.run_available(J.stream_dedup(rows, out, f"{out}/checkpoint"))
    return t.spark.read.schema("hash STRING, id BIGINT, us BIGINT").parquet(f"{out}/rows/batch=*")


@query(
    "stream_outcome_windows",
    """SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts)) AS window_us, event_type AS outcome, count(*) AS n FROM {events}
    WHERE time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' <= (SELECT max(ts) FROM {events}) - INTERVAL '10 seconds' GROUP BY 1, 2""",
)
def stream_outcome_windows(t: Tables):
    rows = _events(t).select("ts", F.col("event_type").alias("outcome"))
    out = _drained(t, J.stream_outcomes(rows, "6 hours"), "stream-outcomes", "window_start TIMESTAMP, outcome STRING, n BIGINT")
    return out.select(F.unix_micros("window_start").alias("window_us"), "outcome", "n")


@query(
    "stream_outcome_windows_sliding",
    """WITH s AS (SELECT time_bucket(INTERVAL '3 hours', ts) - i * INTERVAL '3 hours' AS start, event_type FROM {events}, (VALUES (0), (1)) v(i))
    SELECT epoch_us(start) AS window_us, event_type AS outcome, count(*) AS n FROM s
    WHERE start + INTERVAL '6 hours' <= (SELECT max(ts) FROM {events}) - INTERVAL '10 seconds' GROUP BY 1, 2""",
)
def stream_outcome_windows_sliding(t: Tables):
    rows = _events(t).select("ts", F.col("event_type").alias("outcome"))
    out = _drained(t, J.stream_outcomes(rows, "6 hours", "3 hours"), "stream-sliding", "window_start TIMESTAMP, outcome STRING, n BIGINT")
    return out.select(F.unix_micros("window_start").alias("window_us"), "outcome", "n")


@query(
    "stream_endpoint_state",
    """WITH e AS (SELECT user_id AS endpoint, time_bucket(INTERVAL '6 hours', ts) AS start, event_type = 'error' AS failed, CASE WHEN value > 20 THEN 3 ELSE 1 END AS weight FROM {events}),
    w AS (SELECT endpoint, start, CAST(sum(CASE WHEN failed THEN weight ELSE 0 END) AS BIGINT) AS failures, count(*) FILTER (WHERE NOT failed) AS successes FROM e GROUP BY 1, 2)
    SELECT endpoint, epoch_us(start) AS window_us, failures, successes, CASE WHEN failures >= 3 THEN 'open' WHEN failures > 0 THEN 'degraded' ELSE 'closed' END AS state
    FROM w WHERE start + INTERVAL '6 hours' <= (SELECT max(ts) FROM {events}) - INTERVAL '10 seconds'""",
)
def stream_endpoint_state(t: Tables):
    failed = F.col("event_type") == "error"
    rows = _events(t).select(
        F.col("user_id").alias("endpoint"), "ts", F.when(failed, "failure").otherwise("success").alias("kind"), F.when(F.col("value") > 20, 3).otherwise(1).alias("weight")
    )
    ddl = "endpoint BIGINT, window_start TIMESTAMP, failures BIGINT, successes BIGINT, state STRING"
    out = _drained(t, S.endpoint_windows(rows, "6 hours"), "stream-endpoints", ddl)
    return out.select("endpoint", F.unix_micros("window_start").alias("window_us"), "failures", "successes", "state")


@query(
    "stream_in_flight_timeout",
    f"""WITH {EV_SQL}, s AS (SELECT url, us FROM ev WHERE event_type = 'view'), e AS (SELECT url, us FROM ev WHERE event_type = 'purchase'),
    last AS (SELECT least((SELECT max(us) FROM s), (SELECT max(us) FROM e)) - 10000000 AS us)
    SELECT url, us AS started_us FROM s WHERE us + 300000000 < (SELECT us FROM last)
      AND NOT EXISTS (SELECT 1 FROM e WHERE e.url = s.url AND e.us >= s.us AND e.us <= s.us + 300000000)""",
)
def stream_in_flight_timeout(t: Tables):
    """Views start a request of a page, purchases end it."""
    kind = F.when(F.col("event_type") == "view", "start").otherwise("end")
    rows = _events(t).where("event_type IN ('view', 'purchase')").select("url", "us", kind.alias("kind"))
    return _drained(t, J.stream_timeouts(rows), "stream-timeouts", "url STRING, started_us BIGINT")


@query(
    "stream_failure_burst",
    f"""WITH {EV_SQL}, c AS (SELECT user_id, us, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS n
      FROM ev WHERE event_type = 'error')
    SELECT user_id AS key, min(us) AS opened_us FROM c WHERE n > 2 GROUP BY user_id""",
)
def stream_failure_burst(t: Tables):
    rows = _events(t).where("event_type = 'error'").select(F.col("user_id").alias("key"), "us")
    out = scratch_path(t.spark, "stream-bursts")
    J.run_available(S.stream_bursts(rows, out, f"{out}/checkpoint", n=2, seconds=43_200))
    return t.spark.read.schema("key BIGINT, opened_us BIGINT").option("basePath", f"{out}/alerts").parquet(f"{out}/alerts/batch=*").select("key", "opened_us")


@query(
    "stream_frontier",
    f"""WITH e AS ({EDGES_SQL}), s AS ({SEEDS_SQL}) SELECT DISTINCT dst_url AS url, 1 AS depth FROM e WHERE dst_url NOT IN (SELECT url FROM s)""",
)
def stream_frontier(t: Tables):
    """Links arrive as a stream of orders and are admitted to the queue; the seed pages are visited."""
    root = scratch_path(t.spark, "stream-frontier")
    seeds = t.derive(SEEDS_SQL)
    visited = seeds.selectExpr(
        "url", "0 AS depth", "'completed' AS status", "CAST(NULL AS TIMESTAMP) AS added_time", "CAST(NULL AS TIMESTAMP) AS completed_time", "'ok' AS outcome"
    )
    J.start_state(t.spark, root, urls=visited)
    orders = J.read_stream(t.spark, _arriving(t, "orders"), "o_orderkey BIGINT, o_custkey BIGINT")
    site = F.lit("https://c.example.com/")
    edges = orders.select(
        F.col("o_orderkey").alias("seq"), F.concat(site, "o_custkey").alias("parent_url"),
        F.concat(site, F.floor(F.col("o_orderkey") / 10).cast("bigint")).alias("url"), F.lit(1).alias("depth"),
    )
    J.run_available(J.stream_frontier(edges, root, f"{root}/checkpoint"))
    return J.read_state(t.spark, root, ["queue"])["queue"].select("url", "depth")
