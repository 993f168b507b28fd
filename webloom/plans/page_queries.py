"""Pages: text, titles, links, structured data, clean-up and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.operators import pages as O
from webloom.plans.catalog import Tables, query

PAGES_WITH_BLANKS = """
SELECT page_id, url, html FROM {pages}
UNION ALL SELECT -1 - page_id, url, CASE WHEN url LIKE '%/en/%' THEN '' WHEN url LIKE '%/de/%' THEN concat(' ', chr(10), chr(160)) END FROM {pages}
"""


@query(
    "page_scan",
    f"""SELECT page_id, url, html IS NULL OR regexp_matches(html, '^[\\s\\p{{{{Z}}}}]*$') AS is_empty FROM ({PAGES_WITH_BLANKS}) p""",
)
def page_scan(t: Tables):
    return O.page_scan(t.derive(PAGES_WITH_BLANKS))


# Text of the article: raw-text elements and comments away, tags to line breaks, entities read.
# A cut-off entity such as &amp without its semicolon is read as well.
_ENTITIES = "regexp_replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g')"
_LINES = (
    "regexp_replace(regexp_replace({0}, '[\\s\\p{{{{Z}}}}]*\\n[\\s\\p{{{{Z}}}}]*', chr(10), 'g'),"
    " '^[\\s\\p{{{{Z}}}}]+|[\\s\\p{{{{Z}}}}]+$', '', 'g')"
)
TEXT_SQL = (
    "SELECT page_id, url, "
    + _LINES.format(
        _ENTITIES.format("regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<[^>]*>', chr(10), 'g')")
    )
    + " AS full_text FROM {pages}"
)


@query(
    "page_text_corpus",
    f"""WITH x AS ({TEXT_SQL}) SELECT page_id, md5(full_text) AS text_md5, FALSE AS text_truncated, CAST(length(full_text) AS INTEGER) AS original_len FROM x""",
)
def page_text_corpus(t: Tables):
    return O.page_text(O.parse_pages(t.pages)).select(
        "page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "text_truncated", "original_len"
    )


# Pages whose title tag, and for some the heading too, is empty.
UNTITLED_PAGES = """
SELECT page_id, url, html FROM {pages}
UNION ALL SELECT -1 - page_id, url, CASE WHEN url LIKE '%/en/%' THEN replace(html, '<title>', '<title> </title><title>')
  WHEN url LIKE '%/de/%' THEN replace(replace(html, '<title>', '<title></title><title>'), '<h1>', '<h1> </h1><h1>')
  ELSE replace(replace(replace(html, '<title>', '<meta property="og:title" content=" Shared "><title></title><title>'), '<h1>', '<h2>'), '</h1>', '</h2>') END
  FROM {pages}
"""


@query(
    "page_titles",
    f"""WITH p AS ({UNTITLED_PAGES}), c AS (SELECT page_id,
      {_ENTITIES.format("trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1))")} AS tt,
      {_ENTITIES.format("trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'))")} AS h,
      trim(regexp_extract(html, 'og:title" content="([^"]*)"', 1)) AS og FROM p)
    SELECT page_id, CASE WHEN tt <> '' THEN tt WHEN h <> '' THEN h ELSE og END AS title,
      CASE WHEN tt <> '' THEN 'title' WHEN h <> '' THEN 'h1' WHEN og <> '' THEN 'og' ELSE 'none' END AS title_source FROM c""",
)
def page_titles(t: Tables):
    return O.titles(O.parse_pages(t.derive(UNTITLED_PAGES)))


ROBOTS_TAGGED_PAGES = """
SELECT page_id, url, html FROM {pages}
UNION ALL SELECT -1 - page_id, url, replace(html, '<title>', CASE
  WHEN url LIKE '%/en/%' THEN '<META NAME="Robots" CONTENT="NOINDEX, follow"><title>'
  WHEN url LIKE '%/de/%' THEN '<meta content="nofollow" name="robots"><meta name=robots content=noindex><title>'
  WHEN url LIKE '%/fr/%' THEN '<meta name="robots" content="none"><title>'
  ELSE '<meta name="robots" content="noindex,nofollow"/><title>' END) FROM {pages}
"""


@query(
    "meta_robots_gate",
    f"""WITH p AS ({ROBOTS_TAGGED_PAGES}), r AS (SELECT page_id >= 0 OR url LIKE '%/de/%' OR url LIKE '%/fr/%' AS allow_index,
      page_id >= 0 OR url LIKE '%/en/%' OR url LIKE '%/fr/%' AS allow_follow FROM p)
    SELECT allow_index, allow_follow, count(*) AS pages FROM r GROUP BY 1, 2""",
)
def meta_robots_gate(t: Tables):
    return (
        O.meta_robots(O.parse_pages(t.derive(ROBOTS_TAGGED_PAGES)))
        .groupBy("allow_index", "allow_follow")
        .agg(F.count("*").alias("pages"))
    )


# Pages with further links before the navigation: relative, repeated, foreign, download, mail, broken.
LINKED_PAGES = """
SELECT page_id, url, replace(html, '<nav>', concat('<div><a href="../up">u</a><a href="../up#x">u</a>',
  '<a href="https://other.example.net/a?ref=1&amp;b=2" rel="nofollow">o</a><a href="/f/paper.PDF">p</a><a href="mailto:a@b">m</a>',
  '<a href="#frag">f</a><a href="/a|b">i</a><a href="ftp://x.example.com/">g</a><a name="none">n</a></div><nav>')) AS html FROM {pages}
"""

# Targets of the navigation and of the added links, resolved by hand.
LINKS_SQL = f"""
p AS ({LINKED_PAGES.replace("{pages}", "{{pages}}")}),
base AS (SELECT page_id, url AS src_url, html, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS site FROM p),
nav AS (SELECT page_id, src_url, site || regexp_replace({_ENTITIES.format("h")}, '/+$', '') AS dst_url, i + 8 AS position
  FROM (SELECT page_id, src_url, site, unnest(hs) AS h, unnest(range(len(hs))) AS i FROM
    (SELECT page_id, src_url, site, regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)"', 1) AS hs FROM base))),
extra AS (SELECT page_id, src_url, site || CASE WHEN regexp_matches(src_url, '^[^:]+://[^?#]*/([?#]|$)')
    THEN '/' || split_part(src_url, '/', 4) ELSE '' END || '/up' AS dst_url, unnest([0, 1]) AS position FROM base
  UNION ALL SELECT page_id, src_url, 'https://other.example.net/a?b=2', 2 FROM base),
links AS (SELECT * FROM extra UNION ALL SELECT * FROM nav)
""".replace("{{pages}}", "{pages}")


@query(
    "link_graph_edges",
    f"WITH {LINKS_SQL} SELECT page_id, src_url, dst_url, CAST(min(position) AS INTEGER) AS position FROM links GROUP BY 1, 2, 3",
)
def link_graph_edges(t: Tables):
    judged = O.judged_links(O.parse_pages(t.derive(LINKED_PAGES)), keep_containers=True)
    return O.link_edges(judged)


@query(
    "link_drop_stats",
    f"""WITH {LINKS_SQL}, kept AS (SELECT page_id, dst_url, count(*) AS n FROM links
      WHERE dst_url NOT LIKE 'https://other.%' GROUP BY 1, 2), n AS (SELECT count(*) AS pages FROM {{pages}})
    SELECT 'same_page_dup' AS reason, CAST(sum(n - 1) AS BIGINT) AS dropped FROM kept
    UNION ALL SELECT 'nofollow_link', pages FROM n UNION ALL SELECT 'download_candidate', pages FROM n
    UNION ALL SELECT 'invalid_url', pages * 4 FROM n""",
)
def link_drop_stats(t: Tables):
    judged = O.judged_links(O.parse_pages(t.derive(LINKED_PAGES)), keep_containers=True, follow_nofollow=False)
    return O.link_drops(judged)


@query(
    "link_drop_stats_containers",
    """WITH p AS (SELECT regexp_matches(url, '^https?://(www[.])?therst[.]example[.]com/') AS seed FROM {pages})
    SELECT 'invalid_url' AS reason, 4 * count(*) AS dropped FROM p
    UNION ALL SELECT 'download_candidate', count(*) FROM p WHERE TRUE
    UNION ALL SELECT 'same_page_dup', count(*) FROM p WHERE seed HAVING count(*) > 0
    UNION ALL SELECT 'cross_domain', CAST(sum(CASE WHEN seed THEN 1 ELSE 3 END) AS BIGINT) FROM p""",
)
def link_drop_stats_containers(t: Tables):
    judged = O.judged_links(O.parse_pages(t.derive(LINKED_PAGES)), allowed_domains=("therst.example.com",))
    return O.link_drops(judged)


JSONLD_PAGES = """
SELECT page_id, url, replace(html, '<style>', CASE
  WHEN url LIKE '%/en/%' THEN concat('<script type="application/ld+json">{{"@type": "Article", "id": ', page_id, '}}</script><style>')
  WHEN url LIKE '%/de/%' THEN '<SCRIPT data-x=1 type = ''application/ld+json''>[{{"@type": "Person"}}]</SCRIPT><style>'
  WHEN url LIKE '%/fr/%' THEN '<script type="application/ld+json">{{"broken": </script><style>'
  ELSE '<style>' END) AS html FROM {pages}
"""


@query(
    "jsonld_extract",
    """SELECT CASE WHEN url LIKE '%/en/%' THEN 'Article' ELSE 'none' END AS schema_type, count(*) AS pages,
    CAST(sum(CASE WHEN url LIKE '%/en/%' THEN page_id END) AS BIGINT) AS id_sum FROM {pages} GROUP BY 1""",
)
def jsonld_extract(t: Tables):
    return (
        O.jsonld(t.derive(JSONLD_PAGES))
        .groupBy(F.coalesce("schema_type", F.lit("none")).alias("schema_type"))
        .agg(
            F.count("*").alias("pages"),
            F.sum(F.try_variant_get("schema_org", "$.id", "bigint")).alias("id_sum"),
        )
    )


@query("html_cleanup_tiers")
def html_cleanup_tiers(t: Tables):
    out = None
    for tier in ("off", "canonical", "strict"):
        sizes = (
            O.clean_html(t.pages, tier)
            .groupBy(F.lit(tier).alias("tier"))
            .agg(
                F.count("*").alias("pages"),
                F.sum(F.octet_length("html")).alias("bytes_before"),
                F.sum(F.octet_length("cleaned")).alias("bytes_after"),
            )
        )
        out = sizes if out is None else out.union(sizes)
    return out


@query(
    "content_dedup",
    """WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM {documents})
    SELECT doc_id, 'v2:' || md5(text || '{{}}') AS content_hash FROM d WHERE rn = 1 AND text <> ''""",
)
def content_dedup(t: Tables):
    out = O.content_dedup(t.documents.select("doc_id", "text"), "doc_id", "text", [])
    return out.where("is_new").select("doc_id", "content_hash")


_SAMPLED = "md5(trim(regexp_replace(coalesce(text, ''), '[\\s\\p{{Z}}]+', ' ', 'g')))"


@query(
    "sampled_hash_dedup",
    f"""WITH h AS (SELECT doc_id, {_SAMPLED} AS sample_hash FROM {{documents}})
    SELECT sample_hash, min(doc_id) AS doc_id, count(*) AS copies FROM h GROUP BY 1""",
)
def sampled_hash_dedup(t: Tables):
    hashed = t.documents.select("doc_id", O.sampled_hash(F.col("text")).alias("sample_hash"))
    return O.first_per_hash(hashed, "sample_hash", "doc_id", [])


@query(
    "page_outcomes",
    """WITH d AS (SELECT doc_id, source, length(text) AS n, text IS NULL AS failed, lang <> 'es' AS ok_index, text FROM {documents}),
    f AS (SELECT text, min(doc_id) AS first_id FROM d WHERE ok_index GROUP BY text),
    o AS (SELECT doc_id, CASE WHEN failed THEN 'parse_failed' WHEN NOT ok_index THEN 'noindex' WHEN doc_id <> first_id AND d.text <> '' THEN 'duplicate'
      WHEN n > 3000 THEN 'truncated' ELSE 'ok' END AS outcome FROM d LEFT JOIN f USING (text))
    SELECT outcome, count(*) AS pages FROM o GROUP BY outcome""",
)
def page_outcomes(t: Tables):
    # Spanish documents stand for pages that must not be indexed; text is cut at 3000 characters.
    docs = t.documents.select("doc_id", "text", "lang")
    marked = O.content_dedup(docs, "doc_id", "text", [], allow=F.col("lang") != "es")
    outcome = O.page_outcome(
        F.col("text").isNull(), F.col("lang") != "es", F.col("is_new"), F.length("text") > 3000
    )
    return marked.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("pages"))
