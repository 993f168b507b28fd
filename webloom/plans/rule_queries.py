"""Rules: loading, ranking, matching, extraction and quality. Rule tables derive from parts and page hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import pages as P
from webloom.operators import rules as O
from webloom.plans.catalog import Tables, query
from webloom.sources import rules as S
from webloom.sources.pages import spread

# One rule document per part; what is wrong with it depends on the part's type.
RULE_DOCS = """
SELECT p_partkey, CASE WHEN p_brand LIKE '%2' THEN 'user' ELSE 'pip' END AS source, concat('rules/', p_partkey, '.json') AS path,
  CASE p_type
    WHEN 'STANDARD' THEN concat('{{"name": " r', p_partkey, '", "version": ', p_size, ', "match": {{"domains": ["Shop', p_size,
      '.example.com."], "url_pattern": "^/item/[0-9]+"}}, "fields": {{"title": {{"selector": "h1", "transform": {{"strip": true}}}}}}}}')
    WHEN 'ECONOMY' THEN CASE WHEN p_size > 25 THEN '' ELSE concat('{{"name": "r', p_partkey, '"}}') END
    WHEN 'PROMO' THEN concat('{{"name": "r', p_partkey, '", "name": "again", "fields": {{}}}}')
    WHEN 'MEDIUM' THEN concat('{{"name": "r', p_partkey, '", "version": ', p_size - 25, ', "fields": {{"a": {{"selector": "a", "extract": "attr", "attr": "href"}}}}}}')
    WHEN 'SMALL' THEN concat('{{"name": "r', p_partkey, '", "fields": {{')
    ELSE concat('{{"name": "r', p_partkey, '", "match": {{"url_pattern": "', CASE WHEN p_size > 40 THEN '(?=x)' ELSE 'x' END,
      '"}}, "fields": {{"p": {{"selector": "p", "multiple": true}}, "h": {{"selector": "h2", "fallback": ["h3"]}}}}}}') END AS content
FROM {part}
"""


@query(
    "rule_corpus_load",
    """SELECT concat('rules/', p_partkey, '.json') AS path, CASE WHEN p_brand LIKE '%2' THEN 'user' ELSE 'pip' END AS source,
      CASE WHEN p_type = 'ECONOMY' THEN 'skip' WHEN p_type IN ('PROMO', 'SMALL') OR (p_type = 'MEDIUM' AND p_size <= 25)
        OR (p_type = 'LARGE' AND p_size > 40) THEN 'fail' ELSE 'pass' END AS status,
      CASE WHEN p_type = 'STANDARD' OR (p_type = 'MEDIUM' AND p_size > 25) OR (p_type = 'LARGE' AND p_size <= 40) THEN 'r' || p_partkey END AS name,
      CASE WHEN p_type = 'STANDARD' OR (p_type = 'MEDIUM' AND p_size > 25) THEN 1 WHEN p_type = 'LARGE' AND p_size <= 40 THEN 2 END AS fields_count
    FROM {part}""",
)
def rule_corpus_load(t: Tables):
    return S.load_rules(spread(t.derive(RULE_DOCS)))[1].drop("error")


@query(
    "rule_corpus_rules",
    """SELECT 'r' || p_partkey AS name, CASE p_type WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN p_size - 25 ELSE p_size END AS version,
      CASE p_type WHEN 'STANDARD' THEN 'domain_pattern' WHEN 'LARGE' THEN 'global_pattern' ELSE 'any' END AS scope,
      CASE p_type WHEN 'STANDARD' THEN 'shop' || p_size || '.example.com' ELSE '' END AS domains
    FROM {part} WHERE p_type = 'STANDARD' OR (p_type = 'MEDIUM' AND p_size > 25) OR (p_type = 'LARGE' AND p_size <= 40)""",
)
def rule_corpus_rules(t: Tables):
    rules, _ = S.load_rules(spread(t.derive(RULE_DOCS)))
    return rules.select("name", "version", "scope", F.array_join("domains", ",").alias("domains"))


# A rule relation from parts: few names, many versions and sources.
RULES_FROM_PARTS = """
SELECT replace(p_name, ' ', '-') AS name, p_size AS version, concat('rules/', right(concat('00000000', p_partkey), 8)) AS path,
  CASE WHEN p_type IN ('STANDARD', 'SMALL') THEN 'user' WHEN p_type = 'LARGE' THEN 'remote' WHEN p_type = 'PROMO' THEN 'pip' ELSE 'lab' END AS source,
  concat(replace(p_name, ' ', '-'), '-', p_partkey) AS long_name,
  CASE WHEN p_brand LIKE '%1' THEN 'domain_pattern' WHEN p_brand LIKE '%2' THEN 'domain_all' WHEN p_brand LIKE '%3' THEN 'any' ELSE 'global_pattern' END AS scope,
  lower(replace(p_brand, '#', '')) AS brand, concat('^/', split_part(p_name, ' ', 2)) AS url_pattern, p_retailprice > 950 AS enabled
FROM {part}
"""


def rules_from_parts(t: Tables, name: str = "name"):
    base = t.derive(RULES_FROM_PARTS)
    has_domains = F.col("scope").isin("domain_pattern", "domain_all")
    domains = F.when(has_domains, F.array(F.concat("brand", F.lit(".com")), F.concat("brand", F.lit(".biz")))).otherwise(
        F.array().cast("array<string>")
    )
    return base.select(F.col(name).alias("name"), "version", "path", "source", "scope", domains.alias("domains"), "url_pattern", "enabled")


_PRIORITY = "CASE source WHEN 'pip' THEN 0 WHEN 'remote' THEN 1 WHEN 'user' THEN 2 ELSE 99 END"


@query(
    "rule_dedup",
    f"""SELECT name, source, version, path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY {_PRIORITY}, version DESC, path) AS rn
      FROM ({RULES_FROM_PARTS}) r) x WHERE rn = 1""",
)
def rule_dedup(t: Tables):
    return O.rule_dedup(rules_from_parts(t)).select("name", "source", "version", "path")


@query(
    "rule_rank_and_cap",
    f"""WITH o AS (SELECT *, CASE scope WHEN 'domain_pattern' THEN 0 WHEN 'domain_all' THEN 1 WHEN 'global_pattern' THEN 2 ELSE 3 END AS s,
      CASE WHEN scope LIKE '%pattern' THEN length(url_pattern) ELSE 0 END AS l FROM ({RULES_FROM_PARTS}) r),
    a AS (SELECT *, row_number() OVER w AS rn FROM o WINDOW w AS (ORDER BY s, l DESC, version DESC, long_name))
    SELECT long_name AS name, scope, rn AS rank FROM a""",
)
def rule_rank_and_cap(t: Tables):
    return O.rule_rank(rules_from_parts(t, "long_name")).select("name", "scope", F.col("rank").cast("bigint").alias("rank"))


@query(
    "rule_conflicts",
    f"""SELECT scope, CASE WHEN scope LIKE 'domain%' THEN brand || '.biz,' || brand || '.com' ELSE '' END AS domain_key,
      CASE WHEN scope LIKE '%pattern' THEN url_pattern ELSE '' END AS pattern_key, version, count(*) AS n_rules, min(long_name) AS first_name
    FROM ({RULES_FROM_PARTS}) r WHERE enabled GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""",
)
def rule_conflicts(t: Tables):
    return O.rule_conflicts(rules_from_parts(t, "long_name"))


@query(
    "rule_enable_overlay",
    f"""SELECT long_name AS name, enabled AS in_file, long_name NOT IN (SELECT long_name FROM ({RULES_FROM_PARTS}) d WHERE version > 40) AS enabled
    FROM ({RULES_FROM_PARTS}) r""",
)
def rule_enable_overlay(t: Tables):
    rules = rules_from_parts(t, "long_name")
    disabled = rules.where("version > 40").select("name")
    return O.overlay(rules.withColumn("in_file", F.col("enabled")), disabled).select("name", "in_file", "enabled")


# Rules over the page hosts: one per host that is a blog, some for whole domains, some general.
PAGE_RULES = """
SELECT 'blog-exact' AS name, 'domain_all' AS scope, host AS domain, '' AS url_pattern, 1 AS version, 'user' AS source
  FROM (SELECT min(split_part(url, '/', 3)) AS host FROM {pages} WHERE url LIKE '%//blog.%') h
UNION ALL SELECT 'www-exact', 'domain_pattern', host, '/(en|de)/', 2, 'pip' FROM (SELECT max(split_part(url, '/', 3)) AS host FROM {pages} WHERE url LIKE '%//www.%') h
UNION ALL SELECT 'com-de', 'domain_pattern', 'example.com', '^/de/', 1, 'pip'
UNION ALL SELECT 'com-de-num', 'domain_pattern', 'example.com', '^/de/[0-9]+', 1, 'pip'
UNION ALL SELECT 'com-all', 'domain_all', 'example.com', '', 3, 'user'
UNION ALL SELECT 'com-all-old', 'domain_all', 'example.com', '', 2, 'pip'
UNION ALL SELECT 'org-all', 'domain_all', 'example.org', '', 1, 'remote'
UNION ALL SELECT 'org-all-too', 'domain_all', 'example.org', '', 1, 'pip'
UNION ALL SELECT 'paged', 'global_pattern', '', 'page=[0-9]', 1, 'user'
UNION ALL SELECT 'french', 'global_pattern', '', '^/fr/', 5, 'user'
UNION ALL SELECT 'never', 'global_pattern', '', 'no-such-path', 9, 'user'
"""


def page_rules(t: Tables):
    field = "struct<selector:string,extract:string,attr:string,multiple:boolean,fallback:array<struct<selector:string,extract:string,attr:string>>,transform:struct<strip:boolean,strip_currency:boolean,regex:string,replace_from:string,replace_to:string,join:string>>"
    fields = """{"title": {"selector": ".missing", "extract": "text", "attr": "", "multiple": false,
        "fallback": [{"selector": "article > h1", "extract": "text", "attr": ""}], "transform": {"strip": true}},
      "links": {"selector": "nav a[href^='/']", "extract": "attr", "attr": "href", "multiple": true, "fallback": [], "transform": {"join": " "}},
      "absent": {"selector": "table td:nth-child(2)", "extract": "html", "attr": "", "multiple": false, "fallback": [], "transform": {}},
      "paras": {"selector": "article p", "extract": "text", "attr": "", "multiple": true, "fallback": [], "transform": {}}}"""
    only_absent = """{"absent": {"selector": "table td", "extract": "text", "attr": "", "multiple": false, "fallback": [], "transform": {}}}"""
    chosen = F.when(F.col("name") == "french", only_absent).otherwise(fields)
    return t.derive(PAGE_RULES).select(
        "name", "scope", "version", "source", "url_pattern",
        F.when(F.col("domain") != "", F.array("domain")).otherwise(F.array().cast("array<string>")).alias("domains"),
        F.lit(True).alias("enabled"),
        F.from_json(chosen, f"map<string,{field}>").alias("fields"),
        (F.col("name") == "com-all").alias("keep_body_text"),
        (F.col("name") != "org-all-too").alias("follow_links"),
    )


MATCH_SQL = f"""
r AS ({PAGE_RULES}),
u AS (SELECT page_id, url, html, split_part(url, '/', 3) AS host, regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) AS place FROM {{pages}}),
c AS (SELECT page_id, r.name, row_number() OVER (PARTITION BY page_id ORDER BY
    CASE WHEN domain = '' THEN 2 WHEN domain = host THEN 0 ELSE 1 END, CASE WHEN scope LIKE '%pattern' THEN -length(url_pattern) ELSE 0 END, -version, {_PRIORITY}, name) AS rn
  FROM u JOIN r ON (domain = '' OR domain = host OR host LIKE '%.' || domain) AND (scope NOT LIKE '%pattern' OR regexp_matches(place, url_pattern))),
m AS (SELECT u.page_id, coalesce(max(CASE WHEN rn = 1 THEN name END), 'default') AS rule, coalesce(string_agg(name, ',' ORDER BY rn), '') AS candidates
  FROM u LEFT JOIN c USING (page_id) GROUP BY 1)
"""


@query("rule_match", f"WITH {MATCH_SQL} SELECT page_id, rule, candidates FROM m")
def rule_match(t: Tables):
    matched = O.rule_match(t.pages.select("page_id", "url"), page_rules(t))
    return matched.select("page_id", "rule", F.array_join("candidates", ",").alias("candidates"))


_ENT = "regexp_replace(replace(replace(replace({0}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g')"
_H1 = _ENT.format("trim(regexp_replace(regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1), '\\s+', ' ', 'g'))")
_HREFS = _ENT.format("array_to_string(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1), ' ')")

# A paragraph ends where it is closed or the next one opens; paragraphs that are blank give no value.
_PARAS = (
    "array_to_string([p FOR p IN [" + _ENT.format("trim(regexp_replace(regexp_replace(split_part(q, '</p>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))")
    + " FOR q IN string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:]] IF p <> ''], ' ')"
)


@query(
    "field_extract",
    f"""WITH {MATCH_SQL}, x AS (SELECT page_id, rule, html FROM m JOIN u USING (page_id) WHERE rule <> 'default')
    SELECT page_id, 'title' AS field, {_H1} AS joined FROM x WHERE rule <> 'french'
    UNION ALL SELECT page_id, 'paras', {_PARAS} FROM x WHERE rule <> 'french'
    UNION ALL SELECT page_id, 'links', {_HREFS} FROM x WHERE rule <> 'french'
    UNION ALL SELECT page_id, 'absent', NULL FROM x""",
)
def field_extract(t: Tables):
    rules = page_rules(t)
    matched = O.rule_match(t.pages.select("page_id", "url", "html"), rules)
    out = O.field_extract(matched, rules)
    return out.select("page_id", "field", F.array_join("values", " ").alias("joined"))


_TRANSFORM = "struct<strip:boolean,strip_currency:boolean,regex:string,replace_from:string,replace_to:string,join:string>"
# Part names as extracted values with different transforms per part type.
TRANSFORM_SPECS = {
    "STANDARD": '{"strip": true, "regex": "([a-z]+) [a-z]+"}',
    "ECONOMY": '{"strip_currency": true}',
    "PROMO": '{"regex": "ring|bolt"}',
    "MEDIUM": '{"replace_from": "e", "replace_to": "<eeeeeeeeeeeeeeeeeeeeeeeeeeeee>"}',
    "SMALL": '{"strip": true, "replace_from": "red", "replace_to": "blue"}',
    "LARGE": '{"strip": true, "join": " / "}',
}


@query(
    "field_transform",
    """WITH v AS (SELECT p_partkey, p_type, p_name AS n FROM {part})
    SELECT p_partkey, CASE p_type WHEN 'STANDARD' THEN split_part(n, ' ', 1) WHEN 'ECONOMY' THEN n || ' 5'
      WHEN 'PROMO' THEN nullif(regexp_extract(n, 'ring|bolt'), '')
      WHEN 'MEDIUM' THEN '  R$ ' || replace(n, 'e', '<eeeeeeeeeeeeeeeeeeeeeeeeeeeee>') || '5 '
      WHEN 'SMALL' THEN 'R$ ' || replace(n, 'red', 'blue') || '5' ELSE 'R$ ' || n || '5' || ' / ' || n END AS value FROM v""".replace(
        "n || ' 5'", "n || '5'"
    ),
)
def field_transform(t: Tables):
    spec = None
    for kind, text in TRANSFORM_SPECS.items():
        spec = (F if spec is None else spec).when(F.col("p_type") == kind, F.lit(text))
    value = F.concat(F.lit("  R$ "), "p_name", F.lit("5 "))
    multiple = F.col("p_type") == "LARGE"
    df = t.part.select(
        "p_partkey",
        multiple.alias("multiple"),
        F.when(multiple, F.array(value, F.col("p_name"))).otherwise(F.array(value)).alias("values"),
        F.from_json(spec, _TRANSFORM).alias("t"),
    )
    out = df.withColumn("values", O.transform_value(F.col("values"), F.col("multiple"), F.col("t")))
    return out.select("p_partkey", F.get("values", F.lit(0)).alias("value"))


def records(t: Tables):
    from webloom.plans.records import crawl_records

    return crawl_records(t.pages, page_rules(t))


@query(
    "extraction_default_fallback",
    f"""WITH {MATCH_SQL} SELECT CASE WHEN rule IN ('french') THEN 'default' ELSE rule END AS extraction_type, count(*) AS pages,
      count(*) FILTER (WHERE rule IN ('default', 'french', 'com-all')) AS with_text,
      CAST(sum(CASE WHEN rule IN ('default', 'french') THEN 0 ELSE 4 END) AS BIGINT) AS fields FROM m GROUP BY 1""",
)
def extraction_default_fallback(t: Tables):
    return (
        records(t)
        .groupBy("extraction_type")
        .agg(
            F.count("*").alias("pages"),
            F.count_if(F.col("text") != "").alias("with_text"),
            F.sum(F.size("fields")).cast("bigint").alias("fields"),
        )
    )


@query(
    "rule_performance",
    """WITH e AS (SELECT 'rule' || user_id AS rule, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(value AS INTEGER) % 5 END AS filled, value * 10 AS ms FROM {events})
    SELECT rule, count(*) AS hits, CAST(sum(filled) AS BIGINT) AS fields_filled, 4 * count(*) AS fields_total, round(sum(ms), 4) AS total_ms,
      count(*) FILTER (WHERE ms > 1000) AS slow_count, round(sum(filled) / (4.0 * count(*)), 6) AS fill_rate FROM e GROUP BY rule""",
)
def rule_performance(t: Tables):
    filled = F.when(F.col("event_type") == "error", 0).otherwise(F.rint("value").cast("int") % 5)
    runs = t.events.select(
        F.concat(F.lit("rule"), "user_id").alias("rule"),
        filled.alias("fields_filled"),
        F.lit(4).alias("fields_total"),
        (F.col("value") * 10).alias("elapsed_ms"),
    )
    return (
        O.rule_stats(runs)
        .withColumn("total_ms", F.round(F.col("avg_ms") * F.col("hits"), 4))
        .drop("avg_ms")
        .withColumn("fill_rate", F.round("fill_rate", 6))
    )


@query(
    "rule_performance_of_records",
    f"""WITH {MATCH_SQL} SELECT rule, count(*) AS hits, 3 * count(*) AS fields_filled, 4 * count(*) AS fields_total, CAST(0 AS BIGINT) AS slow_count, 0.75 AS fill_rate
    FROM m WHERE rule NOT IN ('default', 'french') GROUP BY rule""",
)
def rule_performance_of_records(t: Tables):
    """Statistics of the rules that served the pages; the field that no page has stays empty."""
    return O.rule_stats(O.rule_runs(records(t))).drop("avg_ms")


@query(
    "rule_field_quality",
    f"""WITH {MATCH_SQL}, f AS (SELECT rule, unnest(CASE rule WHEN 'french' THEN ['absent'] ELSE ['absent', 'links', 'paras', 'title'] END) AS field FROM m WHERE rule <> 'default')
    SELECT rule, field, count(*) AS results, CASE WHEN field = 'absent' THEN count(*) ELSE 0 END AS null_results, CAST(0 AS BIGINT) AS empty_lists, CAST(0 AS BIGINT) AS blank_results,
      field = 'absent' AS failing FROM f GROUP BY rule, field""",
)
def rule_field_quality(t: Tables):
    rules = page_rules(t)
    matched = O.rule_match(t.pages.select("page_id", "url", "html"), rules)
    return O.rule_quality(O.field_extract(matched, rules))


# Two manifests of the parts: a few parts gone, a few new, some with another size.
MANIFESTS = {
    "old": "SELECT p_brand AS source, p_partkey AS rule, concat(p_name, '|', p_size) AS body FROM {part} WHERE p_size > 5",
    "new": "SELECT p_brand AS source, p_partkey AS rule, concat(p_name, '|', CASE WHEN p_type = 'PROMO' THEN p_size + 1 ELSE p_size END) AS body FROM {part} WHERE p_size < 45",
    "sources": "SELECT p_brand AS source, min(p_retailprice) > 905 AS disabled, p_brand LIKE '%7' AS moved, count(*) % 5 AS failures FROM {part} GROUP BY p_brand",
}


@query(
    "rule_catalog_diff",
    f"""WITH o AS ({MANIFESTS["old"]}), n AS ({MANIFESTS["new"]}), s AS ({MANIFESTS["sources"]}),
    j AS (SELECT coalesce(o.source, n.source) AS source, CASE WHEN o.rule IS NULL THEN 'new' WHEN n.rule IS NULL THEN 'removed'
      WHEN o.body <> n.body THEN 'changed' ELSE 'same' END AS change FROM o FULL JOIN n ON o.source = n.source AND o.rule = n.rule)
    SELECT source, change, count(*) AS rules FROM j WHERE source NOT IN (SELECT source FROM s WHERE disabled OR moved OR failures >= 3) GROUP BY 1, 2""",
)
def rule_catalog_diff(t: Tables):
    old, new, sources = (t.derive(MANIFESTS[k]) for k in ("old", "new", "sources"))
    return O.catalog_diff(old, new, sources).groupBy("source", "change").agg(F.count("*").alias("rules"))


# Answers of a model: the rule documents of the parts, some in a fenced block with words around it.
MODEL_ANSWERS = (
    "SELECT p_partkey AS id, CASE WHEN source = 'user' THEN concat('Here it is:', chr(10), '```json', chr(10), content, chr(10), '``` done') ELSE content END AS content FROM ("
    + RULE_DOCS + ") d"
)


@query(
    "ai_rule_ingest",
    """SELECT p_partkey AS id, p_type = 'STANDARD' OR (p_type = 'MEDIUM' AND p_size > 25) OR (p_type = 'LARGE' AND p_size <= 40) AS accepted FROM {part}""",
)
def ai_rule_ingest(t: Tables):
    return S.ingest_answers(spread(t.derive(MODEL_ANSWERS))).select("id", "accepted")
