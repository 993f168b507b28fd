"""Time windows over the events: a user is an endpoint, domain, worker or key."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import windows as O
from webloom.plans.catalog import Tables, query
from webloom.plans.inputs import EV_SQL, ev

_DAY = 86_400_000_000
_START = 1_704_067_200_000_000  # 2024-01-01 in microseconds
# Moves values off the half, where the last bits of two engines may round apart.
OFF_HALF = 1e-8
_AT = _START + 10 * _DAY


@query(
    "failure_burst",
    f"""WITH {EV_SQL}, c AS (SELECT user_id, us, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 43199999999 PRECEDING AND CURRENT ROW) AS n
      FROM ev WHERE event_type = 'error')
    SELECT user_id, min(us) AS opened_us FROM c WHERE n > 2 GROUP BY user_id""",
)
def failure_burst(t: Tables):
    # The log has one event in four minutes, so the span is half a day.
    failures = ev(t).where("event_type = 'error'").select("user_id", "us")
    return O.bursts(failures, "user_id", n=2, seconds=43_200)


STATES = "SELECT DISTINCT user_id AS endpoint, CASE WHEN user_id % 7 = 1 THEN 'open' ELSE 'half_open' END AS state FROM {ev} WHERE user_id % 7 < 3"
LATENCIES = "SELECT user_id AS endpoint, event_id AS id, us, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS kind, CASE WHEN event_type = 'view' THEN value * 10 END AS latency_ms FROM {ev}"


@query(
    "endpoint_health_score",
    f"""WITH {EV_SQL}, e AS ({LATENCIES.replace("{ev}", "ev")}), p AS (SELECT * FROM e WHERE us <= {_AT}), s AS ({STATES.replace("{ev}", "ev")}),
    r AS (SELECT endpoint, latency_ms, row_number() OVER (PARTITION BY endpoint ORDER BY us DESC, id DESC) AS r FROM p WHERE latency_ms IS NOT NULL),
    w AS (SELECT endpoint, sum(0.3 * pow(0.7, r - 1) * latency_ms) AS ewma FROM r GROUP BY endpoint),
    g AS (SELECT endpoint, count(*) FILTER (WHERE kind = 'failure' AND {_AT} - us <= 15000000) AS recent, max(us) FILTER (WHERE kind = 'success') AS last_ok FROM p GROUP BY endpoint)
    SELECT g.endpoint, coalesce(s.state, 'closed') AS state, round(CASE WHEN s.state = 'open' THEN 0 ELSE greatest(0, least(1, greatest(0, CASE WHEN s.state = 'half_open' THEN 0.3 ELSE 1 END - recent * 0.15)
      - CASE WHEN ewma IS NULL THEN 0 ELSE least(0.15, ewma / 2000 * 0.15) END + CASE WHEN s.state IS NULL AND last_ok IS NOT NULL THEN greatest(0, 0.15 - ({_AT} - last_ok) / 1e6 / 30 * 0.15) ELSE 0 END)) END + 1e-8, 6) AS score
    FROM g LEFT JOIN w ON g.endpoint = w.endpoint LEFT JOIN s ON g.endpoint = s.endpoint""",
)
def endpoint_health_score(t: Tables):
    log = ev(t)
    scored = O.health_score(t.derive(LATENCIES, ev=log), _AT, t.derive(STATES, ev=log))
    return scored.select("endpoint", "state", F.round(F.col("score") + OFF_HALF, 6).alias("score"))


@query(
    "latency_ewma",
    f"""WITH {EV_SQL}, l AS (SELECT user_id, list(value ORDER BY us, event_id) AS vs FROM ev GROUP BY user_id)
    SELECT user_id, round(list_reduce(list_prepend(CAST(0.0 AS DOUBLE), vs), lambda a, b: a * 0.7 + b * 0.3) + 1e-8, 6) AS ewma, len(vs) AS samples FROM l""",
)
def latency_ewma(t: Tables):
    log = ev(t).select("user_id", F.col("event_id").alias("id"), "us", "value")
    return O.ewma(log, "user_id", "value").withColumn("ewma", F.round(F.col("ewma") + OFF_HALF, 6))


@query(
    "path_memory_asof",
    f"""WITH {EV_SQL}, q AS (SELECT user_id AS domain, event_id AS id, us FROM ev WHERE event_type = 'view'),
    m AS (SELECT user_id AS domain, us, CASE WHEN k < 50 THEN 'proxy' ELSE 'direct' END AS route FROM ev WHERE event_type IN ('purchase', 'signup'))
    SELECT q.domain, q.id, q.us, CASE WHEN q.us - m.us < 36000000000 THEN route END AS route FROM q ASOF LEFT JOIN m ON q.domain = m.domain AND q.us >= m.us""",
)
def path_memory_asof(t: Tables):
    log = ev(t)
    requests = log.where("event_type = 'view'").select(F.col("user_id").alias("domain"), F.col("event_id").alias("id"), "us")
    memory = log.where("event_type IN ('purchase', 'signup')").select(
        F.col("user_id").alias("domain"), "us", F.when(F.col("k") < 50, "proxy").otherwise("direct").alias("route")
    )
    return O.route_asof(requests, memory, ttl_s=36_000)


@query(
    "worker_liveness",
    f"""WITH {EV_SQL} SELECT user_id AS worker, max(us) AS last_us, {_AT} - max(us) <= 43200000000 AS alive FROM ev WHERE us <= {_AT} GROUP BY user_id""",
)
def worker_liveness(t: Tables):
    return O.liveness(ev(t).select(F.col("user_id").alias("worker"), "us"), _AT, 43_200)


@query(
    "worker_liveness_summary",
    f"""WITH {EV_SQL}, w AS (SELECT {_AT} - max(us) <= 43200000000 AS alive FROM ev WHERE us <= {_AT} GROUP BY user_id)
    SELECT count(*) FILTER (WHERE alive) AS alive, count(*) FILTER (WHERE NOT alive) AS stale, count(*) FILTER (WHERE alive) = 0 AS all_stale FROM w""",
)
def worker_liveness_summary(t: Tables):
    return O.liveness_summary(O.liveness(ev(t).select(F.col("user_id").alias("worker"), "us"), _AT, 43_200))


@query(
    "rate_limit_audit",
    f"""WITH {EV_SQL}, c AS (SELECT event_id, count(*) OVER (PARTITION BY k ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM ev)
    SELECT event_id, recent FROM c WHERE recent > 1""",
)
def rate_limit_audit(t: Tables):
    return O.rate_audit(ev(t).select("event_id", "k", "us"), "k", 1).select("event_id", "recent")


@query(
    "ttl_dedup",
    f"""WITH RECURSIVE {EV_SQL}, e AS (SELECT md5(user_id || event_type) AS hash, event_id AS id, us FROM ev),
    kept(hash, r) AS (SELECT hash, min({{{{'us': us, 'id': id}}}}) FROM e GROUP BY hash
      UNION ALL SELECT kept.hash, min({{{{'us': e.us, 'id': e.id}}}}) FROM kept JOIN e ON e.hash = kept.hash AND e.us - kept.r.us > 432000000000 GROUP BY kept.hash)
    SELECT hash, r.id AS id, r.us AS us FROM kept""",
)
def ttl_dedup(t: Tables):
    entries = ev(t).select(
        F.md5(F.concat(F.col("user_id").cast("string"), "event_type").cast("binary")).alias("hash"), F.col("event_id").alias("id"), "us"
    )
    return O.ttl_dedup(entries, ttl_s=432_000)
