"""State relations derived from the events, in SQL that both engines read.

``ev`` is the events with the time in microseconds and the number of ``props``.
A user stands for a site, ``https://s<user>.example.com/<k>`` for a page of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.plans.catalog import Tables

EV_SQL = """
ev AS (SELECT event_id, epoch_us(ts) AS us, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k,
  concat('https://s', user_id, '.example.com/', regexp_extract(props, '[0-9]+', 0)) AS url FROM {events})
"""


def ev(t: Tables) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0)
    return t.events.select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "user_id",
        "event_type",
        "value",
        k.cast("int").alias("k"),
        F.concat(F.lit("https://s"), "user_id", F.lit(".example.com/"), k).alias("url"),
    )


STATE_SQL = {
    "urls": """SELECT url, min(k % 5) AS depth, 'completed' AS status, min(us) AS added_time, max(us) AS completed_time,
        CASE WHEN max(value) > 150 THEN 'truncated' WHEN max(value) > 100 THEN 'duplicate' ELSE 'ok' END AS outcome
      FROM {ev} WHERE event_type = 'purchase' GROUP BY url""",
    "queue": """SELECT min(event_id) AS id, url, min(k % 4) AS depth, min(us) AS added_time, concat('s', min(user_id), '.example.com') AS domain
      FROM {ev} WHERE event_type = 'view' GROUP BY url""",
    "failures": """SELECT url, min(k % 4) AS depth, 'net::ERR_TIMED_OUT' AS error, max(us) AS us, CAST(count(*) - 1 AS INTEGER) AS requeue_count
      FROM {ev} WHERE event_type = 'error' GROUP BY url""",
    "in_flight": "SELECT url, min(k % 4) AS depth, min(us) AS us FROM {ev} WHERE event_type = 'click' GROUP BY url",
    "boundary": """SELECT DISTINCT url AS parent_url, concat('https://s', (user_id * 7) % 150, '.example.com/', (k + 1) % 100) AS child_url, k % 4 AS parent_depth
      FROM {ev} WHERE event_type = 'signup'""",
}
STATE_CTES = ", ".join(f"{name} AS ({sql.replace('{ev}', 'ev')})" for name, sql in STATE_SQL.items())


def state(t: Tables) -> dict[str, DataFrame]:
    base = ev(t)
    return {name: t.derive(sql, ev=base) for name, sql in STATE_SQL.items()}


# Link graph over customers: an order links its customer to the customer its number points at.
EDGES_SQL = """SELECT DISTINCT concat('https://c.example.com/', o_custkey) AS src_url,
  concat('https://c.example.com/', CAST(floor(o_orderkey / 10) AS BIGINT)) AS dst_url FROM {orders}"""
SEEDS_SQL = "SELECT concat('https://c.example.com/', c_custkey) AS url FROM {customer} WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7"
