"""Frontier jobs over state derived from the events, and the link graph of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import frontier as O
from webloom.plans.catalog import Tables, query
from webloom.plans.inputs import EDGES_SQL, EV_SQL, SEEDS_SQL, STATE_CTES, ev, state

WITH = f"WITH {EV_SQL}, {STATE_CTES} "
_DAY = 86_400_000_000
_START = 1_704_067_200_000_000  # 2024-01-01 in microseconds

CANDIDATES = """SELECT event_id AS seq, CASE WHEN value < 5 THEN concat('ftp', substr(url, 6)) WHEN value < 10 THEN concat(url, '/a b')
  ELSE url END AS url, k % 5 AS depth FROM {ev} WHERE event_type IN ('signup', 'purchase')"""


@query(
    "url_admission",
    WITH
    + f""", c AS ({CANDIDATES.replace("{ev}", "ev")}), known AS (SELECT url FROM urls UNION SELECT url FROM queue UNION SELECT url FROM in_flight),
    e AS (SELECT *, CASE WHEN url LIKE 'ftp%' OR url LIKE '% %' THEN 'invalid_url' WHEN regexp_matches(url, '/9[0-9]$') THEN 'excluded'
      WHEN depth >= 4 THEN 'boundary' END AS early FROM c),
    f AS (SELECT *, CASE WHEN early IS NULL AND url NOT IN (SELECT url FROM known)
      AND row_number() OVER (PARTITION BY url, early IS NULL ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM e),
    n AS (SELECT *, coalesce(sum(fresh) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
    SELECT seq, url, depth, coalesce(early, CASE WHEN fresh = 0 THEN 'duplicate' ELSE 'enqueued' END) AS verdict FROM n""",
)
def url_admission(t: Tables):
    s = state(t)
    candidates = t.derive(CANDIDATES, ev=ev(t))
    return O.admit(
        candidates, s["urls"], s["queue"], s["in_flight"], ["/9[0-9]$"], max_depth=4, bucket_rows=2000
    )


@query(
    "discovery_union",
    WITH
    + """, c AS (SELECT url, 0 AS depth, 'seeds' AS channel FROM urls UNION ALL SELECT url, depth + 1, 'links' FROM queue
      UNION ALL SELECT url, depth, 'sitemap' FROM in_flight UNION ALL SELECT child_url, parent_depth + 1, 'promoted' FROM boundary)
    SELECT url, min(depth) AS depth, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels FROM c GROUP BY url""",
)
def discovery_union(t: Tables):
    s = state(t)
    found = O.discover(
        seeds=s["urls"].select("url", F.lit(0).alias("depth")),
        links=s["queue"].select("url", (F.col("depth") + 1).alias("depth")),
        sitemap=s["in_flight"],
        promoted=s["boundary"].select(F.col("child_url").alias("url"), (F.col("parent_depth") + 1).alias("depth")),
    )
    return found.withColumn("channels", F.array_join("channels", ","))


@query(
    "domain_round_robin",
    WITH + "SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY depth, id) AS turn FROM queue",
)
def domain_round_robin(t: Tables):
    return O.round_robin(state(t)["queue"], bucket_rows=3000).select("id", "domain", "turn")


@query(
    "crawl_order_head",
    WITH
    + """, r AS (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY depth, id) AS turn FROM queue)
    SELECT id, turn, domain FROM r ORDER BY turn, domain LIMIT 200""",
)
def crawl_order_head(t: Tables):
    return O.queue_page(state(t)["queue"], 200).select("id", "turn", "domain")


@query(
    "politeness_plan",
    f"""WITH {EV_SQL} SELECT event_id, greatest(us, coalesce(lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) + 5000000000, us)) AS slot_us FROM ev""",
)
def politeness_plan(t: Tables):
    requests = ev(t).select(F.col("user_id").alias("domain"), "event_id", "us")
    return O.politeness(requests, 5_000_000_000, bucket_us=3 * _DAY).select("event_id", "slot_us")


@query(
    "politeness_plan_strict",
    f"""WITH {EV_SQL}, n AS (SELECT event_id, user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev)
    SELECT event_id, max(us - n * 5000000000) OVER (PARTITION BY user_id ORDER BY n) + n * 5000000000 AS slot_us FROM n""",
)
def politeness_plan_strict(t: Tables):
    requests = ev(t).select(F.col("user_id").alias("domain"), "event_id", "us")
    return O.politeness(requests, 5_000_000_000, "strict", bucket_us=3 * _DAY).select("event_id", "slot_us")


@query(
    "domain_batch_cap",
    WITH + "SELECT id, domain FROM queue QUALIFY row_number() OVER (PARTITION BY domain ORDER BY depth, id) <= 3",
)
def domain_batch_cap(t: Tables):
    return O.domain_cap(state(t)["queue"], k=3).select("id", "domain")


@query(
    "boundary_promote",
    WITH + "SELECT child_url AS url, min(parent_depth + 1) AS depth FROM boundary WHERE parent_depth + 1 < 3 GROUP BY child_url",
)
def boundary_promote(t: Tables):
    return O.promote(state(t)["boundary"], 3)[0]


@query("boundary_remaining", WITH + "SELECT * FROM boundary WHERE parent_depth + 1 >= 3")
def boundary_remaining(t: Tables):
    return O.promote(state(t)["boundary"], 3)[1]


@query(
    "lost_children",
    WITH
    + """SELECT DISTINCT child_url AS url FROM boundary WHERE parent_depth = 1 AND child_url NOT IN (SELECT url FROM urls)
      AND child_url NOT IN (SELECT url FROM queue) AND child_url NOT IN (SELECT url FROM in_flight)""",
)
def lost_children(t: Tables):
    s = state(t)
    return O.lost_children(s["boundary"], s["urls"], s["queue"], s["in_flight"], 1)


@query(
    "depth_trim",
    WITH
    + """SELECT 'queue' AS relation, depth, count(*) AS n FROM queue WHERE depth < 2 GROUP BY depth
    UNION ALL SELECT 'failures', depth, count(*) FROM failures WHERE depth < 2 GROUP BY depth
    UNION ALL SELECT 'boundary', parent_depth, count(*) FROM (SELECT * FROM boundary UNION SELECT '', url, depth - 1 FROM queue WHERE depth >= 2) b GROUP BY parent_depth""",
)
def depth_trim(t: Tables):
    s = state(t)
    queue, failures, boundary = O.depth_trim(s["queue"], s["failures"], s["boundary"], 2)
    parts = [
        queue.groupBy(F.lit("queue").alias("relation"), "depth"),
        failures.groupBy(F.lit("failures").alias("relation"), "depth"),
        boundary.groupBy(F.lit("boundary").alias("relation"), F.col("parent_depth").alias("depth")),
    ]
    a, b, c = (p.agg(F.count("*").alias("n")) for p in parts)
    return a.union(b).union(c)


@query(
    "in_flight_recover",
    WITH
    + """SELECT url, depth, CASE WHEN url IN (SELECT url FROM urls WHERE status = 'completed') THEN 'skipped'
      WHEN url IN (SELECT url FROM queue) THEN 'queued' ELSE 'recovered' END AS action FROM in_flight""",
)
def in_flight_recover(t: Tables):
    s = state(t)
    return O.recover(s["in_flight"], s["urls"], s["queue"]).select("url", "depth", "action")


_RECLAIM = (
    WITH
    + """, taken AS (SELECT url, depth FROM failures WHERE requeue_count < 1 AND url NOT IN (SELECT url FROM queue)
      AND url NOT IN (SELECT url FROM in_flight) AND url NOT IN (SELECT url FROM urls WHERE status = 'completed') ) """
)


@query("retry_reclaim", _RECLAIM + "SELECT url, depth, split_part(url, '/', 3) AS domain FROM taken")
def retry_reclaim(t: Tables):
    s = state(t)
    return O.retry_reclaim(s["failures"], s["queue"], s["in_flight"], s["urls"])[0]


@query(
    "retry_counters",
    _RECLAIM + "SELECT url, requeue_count + CASE WHEN url IN (SELECT url FROM taken) THEN 1 ELSE 0 END AS requeue_count FROM failures",
)
def retry_counters(t: Tables):
    s = state(t)
    return O.retry_reclaim(s["failures"], s["queue"], s["in_flight"], s["urls"])[1].select("url", "requeue_count")


ATTEMPTS = """SELECT url, CASE WHEN event_type = 'error' THEN CASE WHEN value > 40 THEN 'infra' WHEN value < 2 THEN 'shutdown' ELSE 'error' END
  ELSE 'success' END AS kind FROM {ev} WHERE event_type IN ('error', 'view')"""


@query(
    "retry_ledger",
    WITH
    + f""", a AS ({ATTEMPTS.replace("{ev}", "ev")}), g AS (SELECT url, count(*) FILTER (WHERE kind = 'success') AS ok,
      count(*) FILTER (WHERE kind = 'error') AS errs, count(*) FILTER (WHERE kind = 'shutdown') AS stops FROM a GROUP BY url),
    old AS (SELECT url, requeue_count FROM failures),
    j AS (SELECT coalesce(o.url, g.url) AS url, o.url IS NOT NULL AS stored, coalesce(requeue_count, 0) AS rc, coalesce(ok, 0) AS ok,
      coalesce(errs, 0) AS errs, coalesce(stops, 0) AS stops FROM old o FULL JOIN g ON o.url = g.url),
    c AS (SELECT url, CASE WHEN stops > 0 THEN 3 ELSE least(3, rc + errs) END AS requeue_count FROM j WHERE ok = 0 AND (stored OR errs + stops > 0))
    SELECT url, CAST(requeue_count AS INTEGER) AS requeue_count, requeue_count >= 3 AS permanent FROM c""",
)
def retry_ledger(t: Tables):
    return O.apply_attempts(state(t)["failures"], t.derive(ATTEMPTS, ev=ev(t)), max_requeue=3)


TIMED_ATTEMPTS = ATTEMPTS.replace("SELECT url,", "SELECT event_id AS id, url, k % 4 AS depth,")


@query(
    "retry_requeue",
    WITH
    + f""", a AS ({TIMED_ATTEMPTS.replace("{ev}", "ev")}), g AS (SELECT url, min(id) FILTER (WHERE kind = 'infra') AS id, min({{{{'i': id, 'd': depth}}}}) FILTER (WHERE kind = 'infra') AS f FROM a
      GROUP BY url HAVING count(*) FILTER (WHERE kind = 'success') = 0)
    SELECT id, url, f.d AS depth, regexp_extract(url, '^https://([^/]*)', 1) AS domain FROM g WHERE id IS NOT NULL AND url NOT IN (SELECT url FROM urls) AND url NOT IN (SELECT url FROM queue)""",
)
def retry_requeue(t: Tables):
    s = state(t)
    return O.requeued(t.derive(TIMED_ATTEMPTS, ev=ev(t)), s["urls"], s["queue"])


ORPHANS = """SELECT page_id, CASE WHEN url LIKE '%/fr/%' THEN 'not a url' ELSE url END AS url,
  CASE WHEN url LIKE '%/en/%' THEN split_part(url, '/', 3) ELSE '' END AS domain FROM {pages}"""


@query(
    "frontier_orphans",
    f"""SELECT page_id, CASE WHEN url LIKE 'http%' THEN CASE WHEN domain <> '' THEN domain ELSE regexp_replace(split_part(url, '/', 3), '^www[.]', '') END ELSE '' END AS domain,
      url NOT LIKE 'http%' AS removed FROM ({ORPHANS}) o""",
)
def frontier_orphans(t: Tables):
    return O.fix_orphans(t.derive(ORPHANS)).select("page_id", "domain", "removed")


_BFS = f"""WITH RECURSIVE e AS ({EDGES_SQL}), r(url, depth) AS (SELECT url, 0 FROM ({SEEDS_SQL}) s
  UNION SELECT e.dst_url, depth + 1 FROM r JOIN e ON e.src_url = r.url WHERE depth < 2), d AS (SELECT url, min(depth) AS depth FROM r GROUP BY url) """


@query("crawl_depth_bfs", _BFS + "SELECT url, depth FROM d")
def crawl_depth_bfs(t: Tables):
    return O.bfs(t.derive(EDGES_SQL), t.derive(SEEDS_SQL), 3)[0]


@query("crawl_depth_boundary", _BFS + "SELECT src_url AS parent_url, dst_url AS child_url, 2 AS parent_depth FROM e JOIN d ON d.url = e.src_url WHERE depth = 2")
def crawl_depth_boundary(t: Tables):
    return O.bfs(t.derive(EDGES_SQL), t.derive(SEEDS_SQL), 3)[1]


@query(
    "crawl_budget_cut",
    f"""WITH {EV_SQL}, n AS (SELECT event_id, us, coalesce(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
      OVER (ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM ev WHERE us < {_START + 20 * _DAY})
    SELECT event_id FROM n WHERE done < 600""",
)
def crawl_budget_cut(t: Tables):
    rows = ev(t).select("event_id", "us", (F.col("event_type") != "error").alias("success"))
    return O.budget(rows, 600, _START + 20 * _DAY).select("event_id")


# Finished requests: clicks of one week, some after a redirect from another page of the site.
DONE = """SELECT url, min(CASE WHEN value > 30 THEN concat('https://s', user_id, '.example.com/', (k + 1) % 100) END) AS original_url,
  max(k % 3) AS depth, max(us) AS ts, 'ok' AS outcome FROM {ev} WHERE event_type = 'click' GROUP BY url"""
_DONE_CTES = f""", done AS ({DONE.replace("{ev}", "ev")}), settled AS (SELECT url FROM done UNION SELECT original_url FROM done WHERE original_url IS NOT NULL) """


@query(
    "complete_merge",
    WITH
    + _DONE_CTES
    + """SELECT coalesce(d.url, u.url) AS url, coalesce(d.depth, u.depth) AS depth, CASE WHEN d.url IS NOT NULL THEN 'completed' ELSE u.status END AS status,
      coalesce(u.added_time, d.ts) AS added_time, coalesce(d.ts, u.completed_time) AS completed_time, coalesce(d.outcome, u.outcome) AS outcome
    FROM urls u FULL JOIN done d ON u.url = d.url""",
)
def complete_merge(t: Tables):
    s = state(t)
    return O.complete(s["urls"], s["failures"], s["in_flight"], t.derive(DONE, ev=ev(t)))[0]


@query(
    "complete_merge_cleared",
    WITH
    + _DONE_CTES
    + """SELECT 'failures' AS relation, url FROM failures WHERE url NOT IN (SELECT url FROM settled)
    UNION ALL SELECT 'in_flight', url FROM in_flight WHERE url NOT IN (SELECT url FROM settled)""",
)
def complete_merge_cleared(t: Tables):
    s = state(t)
    _, failures, in_flight = O.complete(s["urls"], s["failures"], s["in_flight"], t.derive(DONE, ev=ev(t)))
    return failures.select(F.lit("failures").alias("relation"), "url").union(
        in_flight.select(F.lit("in_flight").alias("relation"), "url")
    )


@query(
    "legacy_state_merge",
    WITH
    + """SELECT coalesce(v.url, c.url) AS url, coalesce(v.depth, 0) AS depth, CASE WHEN c.url IS NOT NULL THEN 'completed' ELSE 'visited' END AS status,
      v.added_time, CASE WHEN v.url IS NULL THEN c.completed_time END AS completed_time
    FROM queue v FULL JOIN urls c ON v.url = c.url""",
)
def legacy_state_merge(t: Tables):
    s = state(t)
    return O.merge_legacy(s["queue"], s["urls"])


@query(
    "stale_in_flight",
    WITH + f"SELECT url, ({_START + 15 * _DAY} - us) / 1000000.0 AS age_s FROM in_flight WHERE {_START + 15 * _DAY} - us > 300000000",
)
def stale_in_flight(t: Tables):
    return O.stale(state(t)["in_flight"], _START + 15 * _DAY).select("url", "age_s")
