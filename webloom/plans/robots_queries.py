"""Robots: parsing of bodies, verdicts, delays, states."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators import robots as O
from webloom.plans.catalog import Tables, query
from webloom.sources.robots import parse_robots, robots_rules

AGENT = "Webloom"

# One robots answer per origin of the pages; the kind of answer depends on the host.
ROBOTS_BODIES = """
SELECT origin,
  CASE WHEN origin LIKE '%.com' THEN concat('# rules', chr(13), chr(10), 'Sitemap: /early.xml', chr(10), 'User-Agent: *', chr(10),
      'disallow: /de/', chr(10), 'Allow: /de/5', chr(10), 'Disallow:', chr(10), 'Crawl-delay: 9999', chr(10), 'Crawl-delay: 2', chr(10),
      'Sitemap: ', origin, '/map.xml', chr(10), 'Sitemap: /second.xml')
    WHEN origin LIKE '%.org' THEN concat('User-agent: *', chr(10), 'Disallow: /', chr(10), 'User-agent: other', chr(10),
      'User-agent: webloom', chr(10), 'Disallow: /*.html$', chr(10), 'Request-rate: 2/9', chr(10), chr(10), 'Disallow: /*/3')
    END AS body,
  CASE WHEN origin LIKE '%.net' THEN 404 WHEN origin LIKE '%//m.%' THEN 0 ELSE 200 END AS status
FROM (SELECT DISTINCT concat(split_part(url, '/', 1), '//', split_part(url, '/', 3)) AS origin FROM {pages}) o
"""


@query(
    "robots_corpus_load",
    f"""WITH b AS ({ROBOTS_BODIES})
    SELECT origin, kind, pattern, CAST(length(pattern) AS INTEGER) AS specificity FROM b, (VALUES ('.com', 'disallow', '/de/'), ('.com', 'allow', '/de/5'),
      ('.org', 'disallow', '/*.html$'), ('.org', 'disallow', '/*/3')) r(tld, kind, pattern)
    WHERE status = 200 AND right(origin, 4) = tld""",
)
def robots_corpus_load(t: Tables):
    return robots_rules(parse_robots(t.derive(ROBOTS_BODIES), AGENT)).select("origin", "kind", "pattern", "specificity")


@query(
    "robots_origins",
    f"""SELECT origin, CAST(CASE WHEN status = 200 AND origin LIKE '%.com' THEN 2.0 WHEN status = 200 AND origin LIKE '%.org' THEN 4.5 END AS DOUBLE) AS crawl_delay,
      CASE WHEN status = 200 AND origin LIKE '%.com' THEN origin || '/map.xml /second.xml' ELSE '' END AS sitemaps,
      CASE WHEN status = 200 THEN 'ok' WHEN status = 404 THEN 'http_404' ELSE 'fetch_failed' END AS fetch_status FROM ({ROBOTS_BODIES}) b""",
)
def robots_origins(t: Tables):
    parsed = parse_robots(t.derive(ROBOTS_BODIES), AGENT)
    joined = F.coalesce(F.array_join("sitemaps", " "), F.lit(""))
    return parsed.select("origin", "crawl_delay", joined.alias("sitemaps"), "fetch_status")


_VERDICT_SQL = f"""
b AS ({ROBOTS_BODIES}),
u AS (SELECT page_id, url, concat(split_part(url, '/', 1), '//', split_part(url, '/', 3)) AS origin,
  regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM {{pages}}),
v AS (SELECT page_id, url, CASE WHEN status <> 200 THEN TRUE
  WHEN u.origin LIKE '%.com' THEN path LIKE '/de/5%' OR path NOT LIKE '/de/%'
  WHEN u.origin LIKE '%.org' THEN path NOT LIKE '%.html' AND path NOT LIKE '/%/3%' ELSE TRUE END AS allowed
  FROM u JOIN b ON u.origin = b.origin)
"""


@query("robots_verdict", f"WITH {_VERDICT_SQL} SELECT page_id, allowed FROM v")
def robots_verdict(t: Tables):
    robots = parse_robots(t.derive(ROBOTS_BODIES), AGENT)
    return O.robots_verdict(t.pages.select("page_id", "url"), robots).select("page_id", "allowed")


@query(
    "robots_verdict_by_domain",
    f"""WITH {_VERDICT_SQL} SELECT regexp_replace(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1), '^www[.]', '') AS domain,
      count(*) FILTER (WHERE allowed) AS allowed, count(*) FILTER (WHERE NOT allowed) AS robots_denied FROM v GROUP BY 1""",
)
def robots_verdict_by_domain(t: Tables):
    robots = parse_robots(t.derive(ROBOTS_BODIES), AGENT)
    canonical = t.pages.select("page_id", U.canonical_url("url").alias("url"))
    return (
        O.robots_verdict(canonical, robots)
        .groupBy(U.domain_of("url").alias("domain"))
        .agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("robots_denied"))
    )


@query(
    "crawl_delay_overlay",
    f"""WITH b AS ({ROBOTS_BODIES}), o AS (SELECT regexp_replace(split_part(origin, '/', 3), '^www[.]', '') AS domain,
      CASE WHEN status = 200 AND origin LIKE '%.com' THEN 2.0 WHEN status = 200 AND origin LIKE '%.org' THEN 4.5 END AS d FROM b)
    SELECT domain, CAST(coalesce(max(d), 1.0) AS DOUBLE) AS delay FROM o GROUP BY domain""",
)
def crawl_delay_overlay(t: Tables):
    robots = parse_robots(t.derive(ROBOTS_BODIES), AGENT)
    domains = t.pages.select(U.domain_of("url").alias("domain")).distinct()
    return O.delay_overlay(domains, robots).select("domain", "delay")


@query(
    "robots_status_rollup",
    f"""SELECT CASE WHEN status > 0 THEN 'ok' ELSE 'failed' END AS state, count(*) AS origins FROM ({ROBOTS_BODIES}) b GROUP BY 1""",
)
def robots_status_rollup(t: Tables):
    return O.robots_status(parse_robots(t.derive(ROBOTS_BODIES), AGENT))
