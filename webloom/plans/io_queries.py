"""Sinks and sources written and read back in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators.stats import domain_stats
from webloom.plans.catalog import Tables, query
from webloom.plans.inputs import EV_SQL, STATE_CTES, ev, state
from webloom.plans.records import crawl_records
from webloom.plans.rule_queries import MATCH_SQL, page_rules
from webloom.plans.stats_queries import OUTCOMES, report
from webloom.session import cut_lineage, scratch_path
from webloom.sources.records import parse_log_lines, read_records, write_records, write_report
from webloom.sources.state import read_state, write_state


@query(
    "record_sink_jsonl",
    f"""WITH {MATCH_SQL} SELECT CASE WHEN rule = 'french' THEN 'default' ELSE rule END AS extraction_type, 2 * count(*) AS records,
      CAST(2 * sum(length(regexp_replace(regexp_replace(split_part(url, '#', 1), '[?&](ref|utm_source)=[^&]*', '', 'g'), '/+$', ''))) AS BIGINT) AS url_chars
    FROM m JOIN u USING (page_id) GROUP BY 1""",
)
def record_sink_jsonl(t: Tables):
    """Fresh run, fresh run again (replaces), resumed run (adds): every record twice."""
    path = scratch_path(t.spark, "records")
    out = crawl_records(t.pages, page_rules(t)).select(
        "url", F.lit(0).alias("depth"), "text", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"),
        "extraction_type", "title", "fields", F.to_json("schema_org").alias("schema_org"),
    )
    out = cut_lineage(out)
    write_records(out, path, gzip=True)
    write_records(out, path, gzip=True)
    write_records(out, path, gzip=True, resume=True)
    records, _ = read_records(t.spark, path)
    return records.groupBy("extraction_type").agg(F.count("*").alias("records"), F.sum(F.length("url")).alias("url_chars"))


# Lines of a foreign record file: a version line, records, and broken lines for French pages.
FOREIGN_LINES = """
SELECT CASE WHEN url LIKE '%/fr/%' THEN concat('{{"url": "', url, '", "depth": ') ELSE
  concat('{{"url": "', url, '", "depth": ', page_id % 3, ', "title": "t", "fields": {{"a": ["x", "y"]}}, "unknown": 1}}') END AS value FROM {pages}
UNION ALL SELECT concat('{{"_schema": "records/', min(page_id) + 1, '"}}') FROM {pages}
"""


@query(
    "record_scan_jsonl",
    """SELECT url, CAST(page_id % 3 AS INTEGER) AS depth, 'x,y' AS a, FALSE AS corrupt FROM {pages} WHERE url NOT LIKE '%/fr/%'
    UNION ALL SELECT url, NULL, NULL, TRUE FROM {pages} WHERE url LIKE '%/fr/%'""",
)
def record_scan_jsonl(t: Tables):
    path = scratch_path(t.spark, "foreign")
    t.derive(FOREIGN_LINES).write.text(path)
    records, corrupt = read_records(t.spark, path)
    good = records.select("url", "depth", F.array_join(F.col("fields")["a"], ",").alias("a"), F.lit(False).alias("corrupt"))
    bad = corrupt.select(
        F.regexp_extract("line", '"url": "([^"]*)"', 1).alias("url"), F.lit(None).cast("int").alias("depth"),
        F.lit(None).cast("string").alias("a"), F.lit(True).alias("corrupt"),
    )
    return good.union(bad)


def log_lines(t: Tables):
    """A log line per event: JSON for clicks, logfmt with quoted text for the others."""
    ts = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss,SSS")
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    json = F.to_json(
        F.struct(
            F.replace(ts, F.lit(","), F.lit(".")).alias("ts"), level.alias("level"), F.lit("shop").alias("logger"),
            F.col("event_type").alias("event"), F.col("value").cast("string").alias("ms"), F.lit("x").alias("field_level"),
        )
    )
    text = F.concat(
        F.lit("ts="), ts, F.lit(" level="), level, F.lit(" logger=shop event="), "event_type", F.lit(" ms="), F.col("value").cast("string"),
        F.lit(' note="said \\"hi\\" in C:\\\\tmp = ok" level=again empty=""'),
    )
    return ev(t).select(F.when(F.col("event_type") == "click", json).otherwise(text).alias("value"))


@query(
    "crawl_log_scan",
    f"""WITH {EV_SQL} SELECT event_type AS event, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, count(*) AS lines,
      round(sum(value), 4) AS total_ms, CASE WHEN event_type = 'click' THEN 'x' ELSE 'said "hi" in C:\\tmp = ok' END AS note, CAST(sum(us // 1000) AS BIGINT) AS ts_sum
    FROM ev GROUP BY event_type""",
)
def crawl_log_scan(t: Tables):
    path = scratch_path(t.spark, "logs")
    log_lines(t).write.text(path)
    rows = parse_log_lines(t.spark.read.text(path))
    note = F.coalesce(F.try_element_at("kv", F.lit("note")), F.try_element_at("kv", F.lit("field_level")))
    return rows.groupBy("event", "level").agg(
        F.count("*").alias("lines"),
        F.round(F.sum(F.col("kv")["ms"].cast("double")), 4).alias("total_ms"),
        F.max(note).alias("note"),
        F.sum(F.unix_millis("ts")).alias("ts_sum"),
    )


@query(
    "report_sink",
    f"""WITH {EV_SQL}, {STATE_CTES} SELECT count(*) AS ok, (SELECT count(DISTINCT user_id) FROM ev) AS domains FROM ev WHERE event_type = 'view'""",
)
def report_sink(t: Tables):
    path = scratch_path(t.spark, "report")
    write_report(report(t), domain_stats(t.derive(OUTCOMES)), path)
    doc = t.spark.read.schema("outcome_summary MAP<STRING, BIGINT>").json(f"{path}/report")
    domains = t.spark.read.schema("domain STRING").json(f"{path}/domains")
    return doc.select(F.col("outcome_summary")["ok"].alias("ok"), domains.agg(F.count("*")).scalar().alias("domains"))


@query(
    "state_snapshot_io",
    f"""WITH {EV_SQL}, {STATE_CTES} SELECT 'urls' AS relation, count(*) AS n FROM urls UNION ALL SELECT 'queue', count(*) FROM queue WHERE depth < 2
    UNION ALL SELECT 'failures', count(*) FROM failures UNION ALL SELECT 'in_flight', count(*) FROM in_flight UNION ALL SELECT 'boundary', count(*) FROM boundary""",
)
def state_snapshot_io(t: Tables):
    """Two versions and a third that is never committed; the second is read."""
    root, s = scratch_path(t.spark, "state"), state(t)
    write_state(s, root, 1)
    second = read_state(t.spark, root, list(s), 1)
    second["queue"] = second["queue"].where("depth < 2")
    write_state(second, root, 2)
    s["queue"].limit(1).write.parquet(f"{root}/version=3/queue")
    out = None
    for name, df in read_state(t.spark, root, list(s)).items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = n if out is None else out.union(n)
    return out
