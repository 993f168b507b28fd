"""Sitemaps derived from the pages: one file per host and thousand pages, some packed, some broken."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.operators import sitemaps as O
from webloom.plans.catalog import Tables, query
from webloom.plans.robots_queries import AGENT, ROBOTS_BODIES
from webloom.sources.robots import parse_robots
from webloom.sources.sitemaps import parse_sitemaps

SITEMAP_ITEMS = """
SELECT page_id, url, split_part(url, '/', 3) AS host,
  CASE WHEN url LIKE '%/en/%' THEN '2024-01-05' WHEN url LIKE '%/de/%' THEN '2024-01-05T10:00:00.250+0200'
    WHEN url LIKE '%/fr/%' THEN ' Fri, 05 Jan 2024 10:00:00 GMT ' ELSE 'yesterday' END AS lastmod,
  CASE WHEN url LIKE '%example.com%' THEN 'Daily' ELSE 'sometimes' END AS freq,
  CASE WHEN url LIKE '%/en/%' THEN '1.5' WHEN url LIKE '%/de/%' THEN '0.3' WHEN url LIKE '%/fr/%' THEN 'NaN' ELSE '-1' END AS prio
FROM {pages}
"""


def _pack(text: pd.Series) -> pd.Series:
    return text.map(lambda s: gzip.compress(s.encode()) if s.startswith("<?xml") else s.encode())


def sitemap_bodies(t: Tables) -> DataFrame:
    items = t.derive(SITEMAP_ITEMS)
    block = F.concat(
        F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc><lastmod>"), "lastmod",
        F.lit("</lastmod><changefreq>"), "freq", F.lit("</changefreq><priority>"), "prio",
        F.lit("</priority><image:image><image:loc>http://i/x.png</image:loc></image:image></url><url><loc> </loc></url>"),
    )
    grouped = items.groupBy("host", F.floor(F.col("page_id") / 1000).alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("page_id", block.alias("b"))))["b"], "").alias("blocks")
    )
    head = F.when(F.col("host").like("%.com"), "<?xml version='1.0' encoding='UTF-8'?>").otherwise("")
    space = "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9' xmlns:image='http://www.google.com/schemas/sitemap-image/1.1'>"
    # Files of .net hosts lack the end tag.
    end = F.when(F.col("host").like("%.net"), "").otherwise("</urlset>")
    return grouped.select(
        F.concat(F.lit("https://"), "host", F.lit("/map"), F.col("part").cast("string"), F.lit(".xml")).alias("url"),
        F.pandas_udf(_pack, "binary")(F.concat(head, F.lit(space), "blocks", end)).alias("body"),
    )


@query(
    "sitemap_corpus_load",
    f"""SELECT 'https://' || host || '/map' || (page_id // 1000) || '.xml' AS sitemap_url, 'urlset' AS kind, url AS loc,
      CASE WHEN lastmod LIKE '%GMT%' THEN '2024-01-05 10:00:00.000' WHEN lastmod LIKE '%T%' THEN '2024-01-05 08:00:00.250'
        WHEN lastmod LIKE '2024%' THEN '2024-01-05 00:00:00.000' END AS lastmod,
      CASE WHEN freq = 'Daily' THEN 'daily' END AS changefreq,
      CAST(CASE prio WHEN '1.5' THEN 1.0 WHEN '0.3' THEN 0.3 WHEN '-1' THEN 0.0 END AS DOUBLE) AS priority
    FROM ({SITEMAP_ITEMS}) i""",
)
def sitemap_corpus_load(t: Tables):
    return parse_sitemaps(sitemap_bodies(t)).select(
        "sitemap_url", "kind", "loc", F.date_format("lastmod", "yyyy-MM-dd HH:mm:ss.SSS").alias("lastmod"), "changefreq", "priority"
    )


# Index files three levels deep with a loop back to the top; hosts under .org hide their entries one level too deep.
SITEMAP_TREE = """
SELECT concat(origin, '/top.xml') AS sitemap_url, 'index' AS kind, concat(origin, '/mid.xml') AS loc, 0 AS position FROM ({origins}) o
UNION ALL SELECT concat(origin, '/mid.xml'), 'index', concat(origin, '/leaf.xml'), 0 FROM ({origins}) o
UNION ALL SELECT concat(origin, '/mid.xml'), 'index', concat(origin, '/top.xml'), 1 FROM ({origins}) o
UNION ALL SELECT concat(origin, '/leaf.xml'), 'index', concat(origin, '/deep.xml'), 0 FROM ({origins}) o WHERE origin LIKE '%.org'
UNION ALL SELECT concat(split_part(url, '/', 1), '//', split_part(url, '/', 3),
  CASE WHEN split_part(url, '/', 3) LIKE '%.org' THEN '/deep.xml' ELSE '/leaf.xml' END), 'urlset', url, CAST(page_id AS INTEGER) FROM {pages}
""".replace("{origins}", "SELECT DISTINCT concat(split_part(url, '/', 1), '//', split_part(url, '/', 3)) AS origin FROM {pages}")

_TOPS = "SELECT DISTINCT concat(split_part(url, '/', 1), '//', split_part(url, '/', 3), '/top.xml') AS sitemap_url FROM {pages}"


@query(
    "sitemap_expand",
    f"""WITH RECURSIVE e AS ({SITEMAP_TREE}), r(sitemap_url) AS (SELECT sitemap_url FROM ({_TOPS}) s
      UNION SELECT e.loc FROM r JOIN e ON e.sitemap_url = r.sitemap_url AND e.kind = 'index')
    SELECT sitemap_url, loc FROM e WHERE kind = 'urlset' AND sitemap_url IN (SELECT sitemap_url FROM r)""",
)
def sitemap_expand(t: Tables):
    return O.sitemap_expand(t.derive(SITEMAP_TREE), t.derive(_TOPS)).select("sitemap_url", "loc")


@query(
    "sitemap_candidates",
    f"""WITH b AS ({ROBOTS_BODIES}) SELECT origin, origin || path AS sitemap_url FROM b,
      (VALUES ('/sitemap.xml', FALSE), ('/sitemap_index.xml', FALSE), ('/sitemap-index.xml', FALSE), ('/map.xml', TRUE), ('/second.xml', TRUE)) p(path, listed)
    WHERE NOT listed OR (status = 200 AND origin LIKE '%.com')""",
)
def sitemap_candidates(t: Tables):
    robots = parse_robots(t.derive(ROBOTS_BODIES), AGENT)
    return O.sitemap_candidates(t.derive(f"SELECT origin FROM ({ROBOTS_BODIES}) b"), robots)


_LEAVES = SITEMAP_TREE + " UNION ALL SELECT 'https://a.example/bad.xml', 'urlset', concat('ftp:', url), CAST(page_id AS INTEGER) FROM {pages}"
_CANON = (
    "regexp_replace(regexp_replace(regexp_replace(split_part(loc, '#', 1), '[?&](ref|utm_source)=[^&]*', '', 'g'), '/+$', ''), '/+[?]', '?')"
)


@query(
    "sitemap_seed",
    f"""WITH e AS ({_LEAVES}), k AS (SELECT * FROM e WHERE kind = 'urlset' AND loc LIKE 'http%')
    SELECT regexp_extract(loc, '^([^:]+://[^/]+)', 1) AS origin, count(*) AS seeded, min({_CANON}) AS first_url FROM k GROUP BY 1""",
)
def sitemap_seed(t: Tables):
    entries = t.derive(_LEAVES).where("kind = 'urlset'")
    return (
        O.sitemap_seed(entries)
        .groupBy(O.U.origin_of("url").alias("origin"))
        .agg(F.count("*").alias("seeded"), F.min("url").alias("first_url"))
    )


@query(
    "sitemap_new_vs_known",
    f"""WITH e AS (SELECT DISTINCT {_CANON} AS u FROM (SELECT url AS loc FROM {{pages}}))
    SELECT regexp_extract(u, '^([^:]+://[^/]+)', 1) AS origin, count(*) FILTER (WHERE u LIKE '%/es/%') AS new_urls,
      count(*) FILTER (WHERE u NOT LIKE '%/es/%') AS already_visited FROM e GROUP BY 1""",
)
def sitemap_new_vs_known(t: Tables):
    canonical = t.pages.select(O.U.canonical_url("url").alias("url"))
    urls, queue, in_flight = (canonical.where(F.contains("url", F.lit(f"/{lang}/"))) for lang in ("en", "de", "fr"))
    judged = O.sitemap_new(t.pages.select(F.col("url").alias("loc")), O.known_urls(urls, queue, in_flight))
    return judged.groupBy(O.U.origin_of("url").alias("origin")).agg(
        F.count_if(~F.col("known")).alias("new_urls"), F.count_if("known").alias("already_visited")
    )
