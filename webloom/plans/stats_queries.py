"""Statistics over the events as a fetch log: a user is a domain, endpoint or worker, an error a failure."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.functions import urls as U
from webloom.operators import pages as P
from webloom.operators import stats as O
from webloom.operators.frontier import admission_reason, admit
from webloom.plans.catalog import Tables, query
from webloom.plans.inputs import EV_SQL, STATE_CTES, ev, state
from webloom.plans.page_queries import LINKED_PAGES, LINKS_SQL, TEXT_SQL
from webloom.plans.robots_queries import AGENT, ROBOTS_BODIES
from webloom.session import stored
from webloom.sources.robots import parse_robots

WITH = f"WITH {EV_SQL}, {STATE_CTES} "

# The outcome of a request by event type and value.
_OUTCOME = """CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'duplicate'
  WHEN 'purchase' THEN CASE WHEN value > 30 THEN 'truncated' ELSE 'noindex' END WHEN 'signup' THEN 'robots_denied'
  ELSE CASE WHEN value < 5 THEN 'internal_error' WHEN value < 10 THEN 'stopped' ELSE 'fetch_error' END END"""
_REASON = "CASE WHEN k < 30 THEN 'already_visited' WHEN k < 60 THEN 'queue_full' ELSE 'exclude_pattern' END"
OUTCOMES = f"""SELECT event_id, concat('s', user_id) AS domain, value AS elapsed_ms, {_OUTCOME} AS outcome FROM {{events}}"""
DROPS = f"""SELECT {_REASON} AS reason, count(*) AS dropped
  FROM {{ev}} WHERE event_type = 'signup' GROUP BY 1"""
_DROPS = DROPS.replace("{ev}", "ev")
_OK = "('ok', 'truncated', 'duplicate', 'noindex', 'parse_failed', 'robots_denied')"


@query(
    "outcome_summary",
    f"""WITH {EV_SQL}, o AS ({OUTCOMES}), d AS ({_DROPS}), c AS (SELECT count(*) FILTER (WHERE outcome IN {_OK}) AS ok,
      count(*) FILTER (WHERE outcome NOT IN {_OK}) AS fail, (SELECT CAST(sum(dropped) AS BIGINT) FROM d) AS dropped FROM o)
    SELECT outcome AS metric, count(*) AS n FROM o GROUP BY outcome UNION ALL SELECT 'total_ok', ok FROM c UNION ALL SELECT 'total_fail', fail FROM c
    UNION ALL SELECT 'total_dropped', dropped FROM c UNION ALL SELECT 'total_all', ok + fail + dropped FROM c""",
)
def outcome_summary(t: Tables):
    return O.outcome_summary(t.derive(OUTCOMES), t.derive(DROPS, ev=ev(t)))


@query(
    "domain_stats",
    f"""WITH o AS ({OUTCOMES}), p AS (SELECT domain, outcome, count(*) AS n FROM o GROUP BY 1, 2),
    m AS (SELECT domain, string_agg(outcome || '=' || n, ',' ORDER BY outcome) AS outcomes FROM p GROUP BY 1)
    SELECT domain, count(*) FILTER (WHERE outcome IN {_OK}) AS ok, count(*) FILTER (WHERE outcome NOT IN {_OK}) AS fail,
      round(sum(elapsed_ms), 4) AS total_ms, any_value(outcomes) AS outcomes FROM o JOIN m USING (domain) GROUP BY domain""",
)
def domain_stats(t: Tables):
    out = O.domain_stats(t.derive(OUTCOMES))
    pairs = F.transform(F.map_entries("outcomes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    total = F.round(F.col("avg_ms") * (F.col("ok") + F.col("fail")), 4)
    return out.withColumn("outcomes", F.array_join(pairs, ",")).withColumn("total_ms", total).drop("avg_ms")


# An error text per event, from codes of every family to plain messages.
_ERROR = """CASE k % 20
  WHEN 0 THEN 'Page.goto: net::ERR_NAME_NOT_RESOLVED at https://x' WHEN 1 THEN 'net::ERR_SSL_PROTOCOL_ERROR' WHEN 2 THEN 'net::ERR_CERT_DATE_INVALID'
  WHEN 3 THEN 'net::ERR_CONNECTION_TIMED_OUT' WHEN 4 THEN 'net::ERR_CONNECTION_REFUSED' WHEN 5 THEN 'net::ERR_CONNECTION_RESET' WHEN 6 THEN 'net::ERR_PROXY_CONNECTION_FAILED'
  WHEN 7 THEN 'net::ERR_TUNNEL_CONNECTION_FAILED' WHEN 8 THEN 'net::ERR_ABORTED; Target closed' WHEN 9 THEN 'net::ERR_TOO_MANY_REDIRECTS' WHEN 10 THEN 'net::HTTP_404'
  WHEN 11 THEN 'net::HTTP_503' WHEN 12 THEN 'net::HTTP_418' WHEN 13 THEN 'net::ERR_SOMETHING_NEW' WHEN 14 THEN 'Page.goto: Timeout 30000ms exceeded'
  WHEN 15 THEN 'Target page, context or browser has been closed' WHEN 16 THEN 'Download is starting' WHEN 17 THEN '' WHEN 18 THEN 'net::ERR_NAME_NOT_RESOLVED_X'
  ELSE 'boom' END"""
ERRORS = f"""SELECT event_id, value > 20 AS has_proxy, {_ERROR} AS error FROM {{ev}} WHERE event_type = 'error'"""


@query(
    "fetch_error_classes",
    f"""WITH {EV_SQL}, e AS ({ERRORS.replace("{ev}", "ev")}), t(k, category) AS (VALUES ('Page.goto: net::ERR_NAME_NOT_RESOLVED at https://x', 'dns'), ('net::ERR_SSL_PROTOCOL_ERROR', 'ssl'),
      ('net::ERR_CERT_DATE_INVALID', 'ssl'), ('net::ERR_CONNECTION_TIMED_OUT', 'timeout'), ('net::ERR_CONNECTION_REFUSED', 'connection_refused'),
      ('net::ERR_CONNECTION_RESET', 'connection_reset'), ('net::ERR_PROXY_CONNECTION_FAILED', 'proxy'), ('net::ERR_TUNNEL_CONNECTION_FAILED', 'proxy'),
      ('net::ERR_ABORTED; Target closed', 'aborted'), ('net::ERR_TOO_MANY_REDIRECTS', 'too_many_redirects'), ('net::HTTP_404', 'http_4xx'), ('net::HTTP_503', 'http_5xx'),
      ('Page.goto: Timeout 30000ms exceeded', 'timeout'), ('Target page, context or browser has been closed', 'target_closed'), ('Download is starting', 'download')),
    c AS (SELECT has_proxy, coalesce(category, 'generic') AS category FROM e LEFT JOIN t ON e.error = t.k)
    SELECT category, CASE WHEN category = 'timeout' THEN CASE WHEN has_proxy THEN 'rotate' ELSE 'transient' END
      WHEN has_proxy AND category IN ('connection_refused', 'dns') THEN 'rotate' WHEN category = 'proxy' THEN 'rotate' WHEN category = 'target_closed' THEN 'replace'
      WHEN category IN ('dns', 'ssl', 'connection_refused', 'download', 'too_many_redirects', 'http_4xx') THEN 'fatal' ELSE 'transient' END AS strategy,
      count(*) AS errors FROM c GROUP BY 1, 2""",
)
def fetch_error_classes(t: Tables):
    judged = O.classify_errors(t.derive(ERRORS, ev=ev(t)))
    return judged.groupBy("category", "strategy").agg(F.count("*").alias("errors"))


@query(
    "drop_summary",
    f"""WITH {EV_SQL}, d AS ({_DROPS}), n AS (SELECT count(*) AS pages FROM {{pages}} WHERE regexp_matches(url, '[?&]page='))
    SELECT reason, CAST(sum(dropped) AS BIGINT) AS dropped FROM (SELECT * FROM d UNION ALL SELECT 'exclude_pattern', pages FROM n
      UNION ALL SELECT 'container', 0 WHERE FALSE) x GROUP BY reason""",
)
def drop_summary(t: Tables):
    from webloom.operators.urls import pattern_hits

    excluded = pattern_hits(t.pages, ["[?&]page="]).select(F.lit("exclude_pattern").alias("reason"), F.col("hits").alias("dropped"))
    links = P.link_drops(P.judged_links(P.parse_pages(t.pages)))
    return O.drop_summary(t.derive(DROPS, ev=ev(t)), excluded, links)


# French pages must not be indexed; links of every third page are known already, every fourth page is at the depth limit.
_NOINDEX = "replace(html, '<title>', '<meta name=\"robots\" content=\"noindex\"><title>')"
CRAWLED = f"""SELECT page_id, url, CASE WHEN url LIKE '%/fr/%' THEN {_NOINDEX} ELSE html END AS html FROM ({LINKED_PAGES})"""


@query(
    "crawl_drops",
    f"""WITH {LINKS_SQL}, x AS ({TEXT_SQL}), o AS (SELECT page_id, CASE WHEN url LIKE '%/fr/%' THEN 'noindex'
      WHEN row_number() OVER (PARTITION BY url LIKE '%/fr/%', full_text ORDER BY page_id) > 1 THEN 'duplicate' ELSE 'ok' END AS outcome FROM x),
    e AS (SELECT page_id, dst_url, outcome, min(position) AS position, count(*) AS n FROM links JOIN o USING (page_id) WHERE dst_url NOT LIKE 'https://other.%' GROUP BY 1, 2, 3),
    c AS (SELECT *, CASE WHEN regexp_matches(dst_url, '/[a-e][a-z]*$') THEN 'exclude_pattern' WHEN page_id % 4 >= 3 THEN 'boundary' END AS early
      FROM e WHERE outcome = 'ok' AND page_id % 3 <> 0),
    v AS (SELECT CASE WHEN early IS NOT NULL THEN early WHEN dst_url IN (SELECT dst_url FROM e WHERE page_id % 3 = 0)
      OR row_number() OVER (PARTITION BY early IS NULL, dst_url ORDER BY page_id, position) > 1 THEN 'already_visited' END AS reason FROM c),
    n AS (SELECT count(*) AS pages FROM {{pages}}),
    d AS (SELECT 'same_page_dup' AS reason, sum(n - 1) AS dropped FROM e UNION ALL SELECT 'nofollow_link', pages FROM n UNION ALL SELECT 'download_candidate', pages FROM n
      UNION ALL SELECT 'invalid_url', pages * 4 FROM n UNION ALL SELECT 'skip_duplicate_links', count(*) FROM e WHERE outcome <> 'ok'
      UNION ALL SELECT reason, count(*) FROM v WHERE reason <> 'boundary' GROUP BY reason)
    SELECT reason, CAST(dropped AS BIGINT) AS dropped FROM d WHERE dropped > 0""",
)
def crawl_drops(t: Tables):
    """Drops of a whole pass: judged on the page, left on pages without new content, refused at the queue."""
    parsed = stored(P.parse_pages(t.derive(CRAWLED)), "parsed")
    judged = stored(P.judged_links(parsed, keep_containers=True, follow_nofollow=False), "links")
    gated = P.meta_robots(parsed).select("page_id", "allow_index")
    texts = P.page_text(parsed).select("page_id", "text").join(gated, "page_id")
    marked = P.content_dedup(texts, "page_id", "text", [], allow=F.col("allow_index"))
    outcomes = marked.select("page_id", P.page_outcome(F.lit(False), F.col("allow_index"), F.col("is_new"), F.lit(False)).alias("outcome"))
    edges = stored(P.skip_repeats(P.link_edges(judged), outcomes), "edges")
    known = edges.where("page_id % 3 = 0").select(F.col("dst_url").alias("url"))
    # The order of arrival is that of the pages and of the links on them.
    links = edges.where("reason IS NULL AND page_id % 3 <> 0").select(
        F.struct("page_id", "position").alias("seq"), F.col("dst_url").alias("url"), (F.col("page_id") % 4).cast("int").alias("depth")
    )
    none = known.where("FALSE")
    admitted = admit(links, known, none, none, ["/[a-e][a-z]*$"], max_depth=3)
    refused = O.reason_counts(admitted.select(admission_reason(F.col("verdict")).alias("reason")))
    return O.drop_summary(P.link_drops(judged), O.reason_counts(edges), refused)


SAVED_DEPTHS = "SELECT depth, count(*) + 10 AS processed, 3 * count(*) AS planned FROM {queue} WHERE depth < 3 GROUP BY depth"


@query(
    "depth_progress",
    WITH
    + f""", s AS ({SAVED_DEPTHS.replace("{queue}", "queue")}), d AS (SELECT depth FROM urls UNION SELECT depth FROM queue UNION SELECT depth FROM failures WHERE requeue_count >= 1 UNION SELECT depth FROM s),
    n AS (SELECT depth, (SELECT count(*) FROM urls u WHERE u.depth = d.depth) + (SELECT count(*) FROM failures f WHERE f.depth = d.depth AND requeue_count >= 1) AS done,
      (SELECT count(*) FROM queue q WHERE q.depth = d.depth) AS queued, coalesce((SELECT max(processed) FROM s WHERE s.depth = d.depth), 0) AS sp,
      coalesce((SELECT max(planned) FROM s WHERE s.depth = d.depth), 0) AS pl FROM d)
    SELECT depth, greatest(sp, done) AS processed, queued, greatest(pl, greatest(sp, done) + queued) AS planned FROM n""",
)
def depth_progress(t: Tables):
    s = state(t)
    return O.depth_progress(s["urls"], s["queue"], s["failures"], t.derive(SAVED_DEPTHS, queue=s["queue"]))


@query(
    "discovery_summary",
    f"""WITH b AS ({ROBOTS_BODIES}), u AS (SELECT concat(split_part(url, '/', 1), '//', split_part(url, '/', 3)) AS origin FROM {{pages}}),
    p AS (SELECT origin, CASE WHEN status = 200 THEN 'ok' WHEN status > 0 THEN 'http_' || status ELSE 'fetch_failed' END AS robots_status, count(*) AS sitemap_urls
      FROM b JOIN u USING (origin) GROUP BY ALL)
    SELECT origin, robots_status, sitemap_urls, 0 AS is_total FROM p UNION ALL SELECT NULL, NULL, CAST(sum(sitemap_urls) AS BIGINT), 1 FROM p""",
)
def discovery_summary(t: Tables):
    return _discovery(t)


def _discovery(t: Tables):
    robots = parse_robots(t.derive(ROBOTS_BODIES), AGENT)
    return O.discovery_summary(t.pages.select(U.origin_of("url").alias("origin"), "url"), robots)


@query(
    "redirect_stats",
    """WITH u AS (SELECT url, regexp_replace(split_part(url, '/', 3), '^www[.]', '') AS domain,
      CASE WHEN url LIKE '%#%' OR url LIKE '%ref=%' OR url LIKE '%utm_%' OR url LIKE '%/' THEN 1 ELSE 0 END AS moved FROM {pages})
    SELECT domain, CAST(sum(moved) AS BIGINT) AS redirects, count(*) AS results FROM u GROUP BY domain""",
)
def redirect_stats(t: Tables):
    return O.redirect_stats(_results(t))


def _results(t: Tables):
    return t.pages.select(U.domain_of("url").alias("domain"), "url", U.canonical_url("url").alias("final_url"))


_COUNTERS = """SELECT 'outcomes' AS metric, event_type AS key, count(*) AS value FROM {events} WHERE event_id {half} GROUP BY event_type
  UNION ALL SELECT 'domain_errors', concat('s', user_id), count(*) FROM {events} WHERE event_id {half} AND event_type = 'error' GROUP BY user_id"""


@query(
    "stats_merge",
    """SELECT 'outcomes' AS metric, event_type AS key, count(*) AS value FROM {events} GROUP BY event_type
    UNION ALL SELECT 'domain_errors', 's' || user_id, count(*) FROM {events} WHERE event_type = 'error' GROUP BY user_id""",
)
def stats_merge(t: Tables):
    # Two sessions: the events before and after the middle of the ids.
    middle = "(SELECT max(event_id) / 2 FROM {events})"
    saved = t.derive(_COUNTERS.replace("{half}", f"<= {middle}"))
    current = t.derive(_COUNTERS.replace("{half}", f"> {middle}"))
    return O.stats_merge(saved, current)


@query(
    "failure_counts",
    WITH
    + """SELECT depth, count(*) AS failures, count(*) FILTER (WHERE requeue_count < 1) AS retryable, count(*) FILTER (WHERE requeue_count >= 1) AS permanent
    FROM failures GROUP BY depth""",
)
def failure_counts(t: Tables):
    return O.failure_counts(state(t)["failures"])


COMPONENTS = """SELECT concat('c', right(concat('00000', user_id), 5)) AS component,
  CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 4 > count(*) THEN 'DOWN'
    WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 5 > count(*) THEN 'DEGRADED' ELSE 'UP' END AS state FROM {events} GROUP BY user_id"""


@query(
    "health_rollup",
    f"""WITH c AS ({COMPONENTS}), r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY component) AS rn FROM c)
    SELECT state, count(*) AS components, string_agg(component, ', ' ORDER BY component) FILTER (WHERE rn <= 3) AS first_names,
      (SELECT max_by(state, CASE state WHEN 'DOWN' THEN 2 WHEN 'DEGRADED' THEN 1 ELSE 0 END) FROM c) AS overall FROM r GROUP BY state""",
)
def health_rollup(t: Tables):
    return O.health_rollup(t.derive(COMPONENTS), names=3)


@query(
    "token_usage",
    r"""WITH m AS (SELECT conv_id, role, len(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s\p{{Z}}]')) AS n FROM {conversations}),
    u AS (SELECT conv_id, role, CASE WHEN role = 'assistant' THEN 0 ELSE n END AS p, CASE WHEN role = 'assistant' THEN n ELSE 0 END AS c FROM m)
    SELECT conv_id, role, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(p + c) AS BIGINT) AS total_tokens
    FROM u GROUP BY GROUPING SETS ((conv_id, role), ())""",
)
def token_usage(t: Tables):
    n = X.word_count(F.col("text"))
    answer = F.col("role") == "assistant"
    usage = t.conversations.select(
        "conv_id", "role", F.when(answer, 0).otherwise(n).alias("prompt_tokens"), F.when(answer, n).otherwise(0).alias("completion_tokens")
    )
    return O.token_usage(usage)


CALLS = """SELECT CASE WHEN event_type = 'view' THEN 'embed' ELSE 'chat' END AS operation, CASE WHEN user_id < 50 THEN 'a' ELSE 'b' END AS provider,
  CASE WHEN value > 20 THEN 'large' ELSE 'small' END AS model, CASE WHEN event_type = 'error' THEN 'failed' END AS error,
  CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS retry_count, value AS duration_ms FROM {events}"""


@query(
    "ai_call_rollup",
    f"""SELECT operation, provider, model, count(*) AS calls, count(error) AS errors, CAST(sum(retry_count) AS BIGINT) AS retries,
      round(sum(duration_ms), 4) AS total_ms, max(duration_ms) AS max_ms FROM ({CALLS}) c GROUP BY 1, 2, 3""",
)
def ai_call_rollup(t: Tables):
    total = F.round(F.col("avg_ms") * F.col("calls"), 4)
    return O.ai_calls(t.derive(CALLS)).withColumn("total_ms", total).drop("avg_ms")


@query(
    "state_counts",
    WITH
    + """SELECT 'rows' AS metric, 'urls' AS key, count(*) AS n FROM urls UNION ALL SELECT 'rows', 'queue', count(*) FROM queue
    UNION ALL SELECT 'rows', 'failures', count(*) FROM failures UNION ALL SELECT 'rows', 'in_flight', count(*) FROM in_flight
    UNION ALL SELECT 'rows', 'boundary', count(*) FROM boundary UNION ALL SELECT 'active_domains', '', count(DISTINCT domain) FROM queue
    UNION ALL SELECT 'outcome', outcome, count(*) FROM urls GROUP BY outcome UNION ALL SELECT 'completed_at_depth', CAST(depth AS VARCHAR), count(*) FROM urls GROUP BY depth
    UNION ALL SELECT 'queued_at_depth', CAST(depth AS VARCHAR), count(*) FROM queue GROUP BY depth""",
)
def state_counts(t: Tables):
    return O.state_counts(**state(t))


@query(
    "crawl_report",
    WITH
    + f""", o AS ({OUTCOMES}), d AS ({_DROPS}), e AS ({ERRORS.replace("{ev}", "ev")})
    SELECT count(*) FILTER (WHERE outcome = 'ok') AS ok, count(*) FILTER (WHERE outcome = 'fetch_error') AS fetch_error,
      count(*) + (SELECT CAST(sum(dropped) AS BIGINT) FROM d) AS total_all, (SELECT count(*) FROM e WHERE error LIKE 'net::ERR_CERT%' OR error LIKE 'net::ERR_SSL%') AS ssl_errors,
      (SELECT dropped FROM d WHERE reason = 'queue_full') AS queue_full, (SELECT count(*) FROM queue WHERE depth = 1) AS queued_at_1,
      (SELECT count(*) FROM {{events}} WHERE user_id = 7) AS rule7_hits, (SELECT count(*) FROM {{pages}}) AS sitemap_urls,
      (SELECT count(*) FROM {{pages}} WHERE url LIKE '%#%' OR url LIKE '%ref=%' OR url LIKE '%utm_%' OR url LIKE '%/') AS redirects,
      (SELECT (max(us) - min(us)) // 1000000 FROM ev) AS duration_s FROM o""",
)
def crawl_report(t: Tables):
    r = F.col("report")
    return report(t).select(
        r["outcome_summary"]["ok"].alias("ok"),
        r["outcome_summary"]["fetch_error"].alias("fetch_error"),
        r["totals"]["all"].alias("total_all"),
        r["fetch_errors"]["ssl"].alias("ssl_errors"),
        r["drops"]["queue_full"].alias("queue_full"),
        r["depth_layers"]["1"]["queued"].alias("queued_at_1"),
        r["rule_stats"]["rule7"]["hits"].alias("rule7_hits"),
        r["discovery"]["sitemap_urls"].alias("sitemap_urls"),
        r["redirects"].alias("redirects"),
        r["duration_s"].alias("duration_s"),
    )


# One row per event: its outcome, and where it has one its drop reason and error text.
REPORT_LOG = f"""SELECT o.outcome, o.elapsed_ms, CASE WHEN event_type = 'signup' THEN {_REASON} END AS reason,
  CASE WHEN event_type = 'error' THEN {_ERROR} END AS error, concat('rule', user_id) AS rule, 1 AS fields_filled, 4 AS fields_total, us
  FROM (SELECT *, value AS elapsed_ms, {_OUTCOME} AS outcome FROM {{ev}}) o"""
# Completed, queued and failed URLs of the log in one pass; the saved counters are those of SAVED_DEPTHS.
REPORT_DEPTHS = """WITH u AS (SELECT event_type, url, CASE WHEN event_type = 'purchase' THEN min(k % 5) ELSE min(k % 4) END AS depth, count(*) AS n
    FROM {ev} WHERE event_type IN ('purchase', 'view', 'error') GROUP BY event_type, url),
  d AS (SELECT depth, count_if(event_type = 'purchase' OR (event_type = 'error' AND n >= 2)) AS done, count_if(event_type = 'view') AS queued FROM u GROUP BY depth)
  SELECT *, CASE WHEN depth < 3 AND queued > 0 THEN queued + 10 ELSE 0 END AS saved_done, CASE WHEN depth < 3 THEN 3 * queued ELSE 0 END AS saved_plan
  FROM d WHERE done + queued > 0"""


def report(t: Tables):
    log = ev(t)
    category = F.when(F.col("error").isNotNull(), O.error_category(F.col("error")))
    moved = F.count_if(F.col("url") != F.col("final_url"))
    results = t.pages.select(U.origin_of("url").alias("origin"), "url", U.canonical_url("url").alias("final_url"))
    return O.crawl_report(
        t.spark,
        log=t.derive(REPORT_LOG, ev=log).withColumn("category", category),
        depths=O.depth_totals(t.derive(REPORT_DEPTHS, ev=log)),
        found=results.groupBy("origin").agg(F.count("url").alias("urls"), moved.alias("redirects")),
    )
