"""URL tables: canonical form, validity, exclusion, assets, domains, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import urls as O
from webloom.plans.catalog import Tables, query

# Page URLs and three spellings of each: shouting host with default port, extra
# tracking and blank parameters, trailing slashes with a fragment.
URL_VARIANTS = """
SELECT page_id * 4 AS page_id, url FROM {pages}
UNION ALL
SELECT page_id * 4 + 1, concat(upper(split_part(url, '://', 1)), '://', upper(split_part(split_part(url, '://', 2), '/', 1)),
       CASE WHEN url LIKE 'https:%' THEN ':443' ELSE ':80' END,
       substr(split_part(url, '://', 2), length(split_part(split_part(url, '://', 2), '/', 1)) + 1)) FROM {pages}
UNION ALL
SELECT page_id * 4 + 2, concat(split_part(url, '#', 1), CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END,
       'utm_source=mail&empty=&UTM_Term=x&lang=', substr(split_part(url, '://', 2), 1, 1)) FROM {pages}
UNION ALL
SELECT page_id * 4 + 3, concat(split_part(split_part(url, '#', 1), '?', 1), '///#part') FROM {pages}
"""

CANONICAL_SQL = """
v AS ({variants}),
parts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([^:]+):', 1)) AS sch,
    lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)) AS host,
    regexp_extract(url, '^[^:]+://[^/?#:]*:([0-9]+)', 1) AS port,
    rtrim(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '/') AS path,
    [x FOR x IN string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&')
       IF x LIKE '%=_%' AND lower(split_part(x, '=', 1)) NOT IN
       ('utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','msclkid','ref','source')] AS q
  FROM v),
canon AS (
  SELECT page_id, url, sch || '://' || host
    || CASE WHEN port = '' OR (sch = 'http' AND port = '80') OR (sch = 'https' AND port = '443') THEN '' ELSE ':' || port END
    || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical
  FROM parts)
""".replace("{variants}", URL_VARIANTS)


@query(
    "url_canonical_groups",
    "WITH " + CANONICAL_SQL + "SELECT canonical, count(*) AS n_variants, min(page_id) AS first_page_id FROM canon GROUP BY canonical",
)
def url_canonical_groups(t: Tables):
    return O.canonical_groups(t.derive(URL_VARIANTS))


# Page URLs and spoiled spellings of each.
SPOILED_URLS = """
SELECT page_id, url FROM {pages}
UNION ALL SELECT page_id, concat('ftp', substr(url, 5)) FROM {pages}
UNION ALL SELECT page_id, concat(split_part(url, '://', 1), ':///', split_part(url, '/', 4)) FROM {pages}
UNION ALL SELECT page_id, concat(split_part(split_part(url, '?', 1), '#', 1), '/<b>') FROM {pages}
UNION ALL SELECT page_id, concat(split_part(split_part(url, '?', 1), '#', 1), '?q=a|b') FROM {pages}
UNION ALL SELECT page_id, concat(split_part(split_part(url, '?', 1), '#', 1), '/a b') FROM {pages}
"""


@query(
    "url_validity_audit",
    f"""WITH v AS ({SPOILED_URLS}), p AS (SELECT url, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
      regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS q FROM v),
    r AS (SELECT CASE WHEN url NOT SIMILAR TO 'https?:.*' THEN 'bad_scheme' WHEN url SIMILAR TO 'https?:///.*' THEN 'no_host'
      WHEN path LIKE '%<%' OR path LIKE '%>%' THEN 'illegal_path' WHEN q LIKE '%|%' THEN 'illegal_query'
      WHEN path LIKE '% %' OR q LIKE '% %' THEN 'space' ELSE 'valid' END AS reason FROM p)
    SELECT reason, count(*) AS urls FROM r GROUP BY reason""",
)
def url_validity_audit(t: Tables):
    return O.url_validity(t.derive(SPOILED_URLS)).groupBy("reason").agg(F.count("*").alias("urls"))


EXCLUDE_PATTERNS = ("[?&]page=[0-9]+", "^https?://blog[.]", "casino|pills", "/fr/[0-9]+$")


@query(
    "url_exclude_filter",
    "SELECT page_id, url FROM {pages} WHERE "
    + " AND ".join(f"NOT regexp_matches(url, '{p}')" for p in EXCLUDE_PATTERNS),
)
def url_exclude_filter(t: Tables):
    return O.exclude(t.pages.select("page_id", "url"), EXCLUDE_PATTERNS)


@query(
    "url_exclude_hits",
    "SELECT p.pattern, count(*) AS hits FROM {pages} JOIN (VALUES "
    + ", ".join(f"('{p}')" for p in EXCLUDE_PATTERNS)
    + ") p(pattern) ON regexp_matches(url, p.pattern) GROUP BY p.pattern",
)
def url_exclude_hits(t: Tables):
    return O.pattern_hits(t.pages, EXCLUDE_PATTERNS)


# Page URLs and the same with a file of a kind that depends on the page.
ASSET_URLS = """
SELECT page_id, url FROM {pages}
UNION ALL SELECT page_id, concat(split_part(split_part(url, '?', 1), '#', 1), '/file.',
  CASE WHEN url LIKE '%/en/%' THEN 'PDF' WHEN url LIKE '%/de/%' THEN 'tar.gz' WHEN url LIKE '%/fr/%' THEN 'jpeg' ELSE 'aspx' END,
  '?v=1.zip') FROM {pages}
"""


@query(
    "download_asset_split",
    f"""WITH v AS ({ASSET_URLS}), p AS (SELECT regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM v),
    e AS (SELECT CASE WHEN path LIKE '%.%' THEN lower(regexp_extract(path, '[.]([^.]*)$', 1)) END AS extension FROM p)
    SELECT CASE WHEN extension IN ('pdf', 'gz', 'jpeg') THEN 'download' ELSE 'page' END AS kind,
      coalesce(extension, '') AS extension, count(*) AS urls FROM e GROUP BY 1, 2""",
)
def download_asset_split(t: Tables):
    return (
        O.split_assets(t.derive(ASSET_URLS))
        .groupBy("kind", F.coalesce("extension", F.lit("")).alias("extension"))
        .agg(F.count("*").alias("urls"))
    )


# Hosts of the pages below a plain, a two-label and an unlisted suffix.
DOMAIN_URLS = """
SELECT url FROM {pages}
UNION ALL SELECT concat('http://', split_part(split_part(url, '/', 3), '.example.', 1), '.shop.co.uk:8080/', page_id) FROM {pages}
UNION ALL SELECT concat('https://www.co.uk/', page_id) FROM {pages}
UNION ALL SELECT concat('https://user:pw@', upper(split_part(url, '/', 3)), '/', page_id) FROM {pages}
"""


@query(
    "domain_rollup",
    f"""WITH v AS ({DOMAIN_URLS}), h AS (SELECT lower(regexp_extract(url, '^[^:]+://(?:[^/?#]*@)?([^/?#:]*)', 1)) AS host FROM v),
    s AS (SELECT host, string_split(host, '.') AS l, CASE WHEN host LIKE '%.co.uk' OR host = 'co.uk' THEN 2 ELSE 1 END AS k FROM h),
    d AS (SELECT CASE WHEN host LIKE 'www.%' AND len(l) > k + 1 THEN substr(host, 5) ELSE host END AS domain,
      CASE WHEN len(l) <= k THEN host ELSE array_to_string(l[len(l) - k:], '.') END AS registrable FROM s)
    SELECT domain, registrable, count(*) AS pages FROM d GROUP BY 1, 2""",
)
def domain_rollup(t: Tables):
    return O.domain_rollup(t.derive(DOMAIN_URLS))


# A suffix list as a relation: plain rules, a wildcard and an exception to it.
SUFFIX_LINES = """
SELECT '// comment' AS line UNION ALL SELECT '' UNION ALL SELECT 'com' UNION ALL SELECT 'org' UNION ALL SELECT 'uk' UNION ALL SELECT '*.uk'
UNION ALL SELECT '!www.uk  // spared' UNION ALL SELECT concat(split_part(split_part(url, '/', 3), '.example.', 1), '.shop.co.uk') FROM {pages} WHERE url LIKE '%//blog.%'
"""
RULED_URLS = DOMAIN_URLS + "UNION ALL SELECT concat('http://a.www.uk/', page_id) FROM {pages} UNION ALL SELECT concat('http://www.uk/', page_id) FROM {pages}"


@query(
    "domain_rollup_rules",
    f"""WITH v AS ({RULED_URLS}), h AS (SELECT lower(regexp_extract(url, '^[^:]+://(?:[^/?#]*@)?([^/?#:]*)', 1)) AS host, count(*) AS n FROM v GROUP BY 1),
    r AS (SELECT DISTINCT split_part(trim(line), ' ', 1) AS rule FROM ({SUFFIX_LINES}) x WHERE trim(line) <> '' AND line NOT LIKE '//%'),
    m AS (SELECT host, max(CASE WHEN rule LIKE '!%' THEN 100 + len(string_split(rule, '.')) - 1 ELSE len(string_split(rule, '.')) END) AS k FROM h JOIN r
      ON (rule NOT LIKE '!%' AND rule NOT LIKE '*%' AND (host = rule OR host LIKE '%.' || rule)) OR (rule LIKE '!%' AND (host = substr(rule, 2) OR host LIKE '%.' || substr(rule, 2)))
      OR (rule LIKE '*%' AND host LIKE '%_.' || substr(rule, 3)) GROUP BY host),
    s AS (SELECT h.host, n, string_split(h.host, '.') AS l, coalesce(k, 1) % 100 AS k FROM h LEFT JOIN m ON m.host = h.host)
    SELECT CASE WHEN host LIKE 'www.%' AND len(l) > k + 1 AND len(l) > 2 THEN substr(host, 5) ELSE host END AS domain,
      CASE WHEN len(l) <= k THEN host ELSE array_to_string(l[len(l) - k:], '.') END AS registrable, CAST(sum(n) AS BIGINT) AS pages FROM s GROUP BY 1, 2""",
)
def domain_rollup_rules(t: Tables):
    return O.domain_rollup(t.derive(RULED_URLS), suffixes=O.suffix_rules(t.derive(SUFFIX_LINES)))


SEED_DOMAINS = ("therst.example.com", "theren.example.net", "blog.theren.example.net", "ththed.example.org")
_DOMAIN = "regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#:]*)', 1)), '^www[.]', '')"


@query(
    "allowed_domain_filter",
    f"""SELECT {_DOMAIN} IN {SEED_DOMAINS} AS kept, count(*) AS urls FROM {{pages}} GROUP BY 1""",
)
def allowed_domain_filter(t: Tables):
    return O.same_domain(t.pages, SEED_DOMAINS).groupBy("kept").agg(F.count("*").alias("urls"))


# Seeds as a relation: the domains of the pages written in German.
SEED_RELATION = "SELECT DISTINCT " + _DOMAIN + " AS domain FROM {pages} WHERE url LIKE '%/de/%'"


@query(
    "cross_domain_drops",
    f"""WITH s AS ({SEED_RELATION}), u AS (SELECT {_DOMAIN} AS domain FROM {{pages}})
    SELECT domain, count(*) AS dropped FROM u WHERE domain NOT IN (SELECT domain FROM s) GROUP BY domain""",
)
def cross_domain_drops(t: Tables):
    seeds = t.pages.where(F.contains("url", F.lit("/de/"))).select(O.U.domain_of("url").alias("domain"))
    judged = O.same_domain_as(t.pages.select("url"), seeds)
    return judged.where(~F.col("kept")).groupBy("domain").agg(F.count("*").alias("dropped"))


@query(
    "origin_list",
    """SELECT lower(regexp_extract(url, '^([^:]+):', 1)) || '://' || regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS origin,
    min(page_id) AS first_page_id, count(*) AS pages FROM {pages} GROUP BY 1""",
)
def origin_list(t: Tables):
    return O.origins(t.pages)


SECRET_URLS = """
SELECT page_id, url FROM {pages}
UNION ALL SELECT page_id, concat(split_part(url, '://', 1), '://bob:s3cret@', split_part(url, '://', 2)) FROM {pages}
UNION ALL SELECT page_id, concat(split_part(split_part(url, '?', 1), '#', 1), '?API_Key=k', page_id, '&monkey=2&sid=9') FROM {pages}
"""


@query(
    "secret_redaction",
    f"""WITH v AS ({SECRET_URLS}), r AS (SELECT page_id, url, regexp_replace(regexp_replace(url,
      '(://[^:@/]+:)([^@/]+)(@)', '\\1***\\3', 'g'),
      '([?&])(password|passwd|token|auth_token|api_key|apikey|key|authorization|secret|client_secret|private_key|signature|sig|csrf_token|sessionid|sid|access_token|refresh_token|jwt|bearer)=[^&]*',
      '\\1\\2=***', 'gi') AS safe FROM v)
    SELECT page_id, safe AS url, safe <> url AS masked FROM r""",
)
def secret_redaction(t: Tables):
    return O.redact(t.derive(SECRET_URLS), ["url"]).select("page_id", "url", "masked")




@query(
    "text_sanitize_controls",
    r"""WITH d AS (SELECT doc_id, lang, text FROM {documents} UNION ALL
      SELECT -1 - doc_id, lang, concat(chr(8238), text, chr(7), CASE WHEN lang = 'de' THEN chr(65529) ELSE '' END) FROM {documents})
    SELECT doc_id, md5(c) AS clean_md5, c <> text AS changed FROM (SELECT doc_id, text,
      regexp_replace(text, '[\x{{202A}}-\x{{202E}}\x{{061C}}\x{{200E}}\x{{200F}}\x{{2066}}-\x{{2069}}\x{{00}}-\x{{08}}\x{{0B}}-\x{{1F}}\x{{7F}}\x{{FFF9}}-\x{{FFFB}}]', '', 'g') AS c FROM d)""",
)
def text_sanitize_controls(t: Tables):
    d = t.documents.select("doc_id", "text")
    marked = t.documents.select(
        (-1 - F.col("doc_id")).alias("doc_id"),
        F.concat(F.lit("‮"), "text", F.lit("\x07"), F.when(F.col("lang") == "de", F.lit("￹")).otherwise("")).alias("text"),
    )
    out = O.sanitize(d.union(marked), "text", "controls")
    return out.select("doc_id", F.md5(F.col("clean").cast("binary")).alias("clean_md5"), "changed")


@query(
    "text_sanitize_printable",
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace('<|im_start|>' || text || chr(8203) || ']]>',
      '[^\p{{L}}\p{{N}}\p{{P}}\p{{S}}\p{{M}}\p{{Zs}}\t\n]', '', 'g'), '<\|im_start\|>|<\|im_end\|>|<!\[CDATA\[|\]\]>', ' ', 'g'),
      '[\s\p{{Z}}]+', ' ', 'g'))) AS clean_md5 FROM {documents}""",
)
def text_sanitize_printable(t: Tables):
    d = t.documents.select("doc_id", F.concat(F.lit("<|im_start|>"), "text", F.lit("​]]>")).alias("text"))
    return O.sanitize(d, "text", "printable").select("doc_id", F.md5(F.col("clean").cast("binary")).alias("clean_md5"))
