"""Pages to crawl records: match, parse and extract once, transform, settle, drop copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.functions import urls as U
from webloom.operators import pages as P
from webloom.operators import rules as R
from webloom.session import stored


def crawl_records(pages: DataFrame, snapshot: DataFrame, max_length: int | None = None) -> DataFrame:
    """One row per page: url, text, title, fields, extraction type, robots marks, anchors.

    Markup passes through one Python stage and ends there. The rule definitions
    (a bounded table) are joined by broadcast before and after that stage.
    """
    matched = R.rule_match(pages.select("page_id", "url", "html"), snapshot)
    rules = R.definitions(snapshot)
    tagged = R.with_rule(matched, rules).withColumn("jsonld_text", P.jsonld_text())
    parsed = P.parse_pages(tagged, carry=("rule", "candidates", "jsonld_text"))
    defined = R.with_rule(parsed, rules)

    def settled(e):
        spec = F.try_element_at("rule_fields", e["field"])
        cut = F.transform(e["values"], lambda v: X.cut_bytes(v, max_length))
        return F.struct(e["field"], R.transform_value(cut, spec["multiple"], spec["transform"], max_length))

    lines = X.clean_lines(F.col("raw_text"))
    robots = F.lower(F.coalesce("robots", F.lit("")))
    own, head, og = (F.nullif(X.strip_space(F.col(c)), F.lit("")) for c in ("title_tag", "h1", "og_title"))
    ready = defined.withColumn("full_text", lines).select(
        "page_id",
        U.canonical_url("url").alias("url"),
        F.col("url").alias("page_url"),
        "rule",
        "candidates",
        F.coalesce(own, head, og, F.lit("")).alias("title"),
        (~F.contains(robots, F.lit("noindex"))).alias("allow_index"),
        (~F.contains(robots, F.lit("nofollow"))).alias("allow_follow"),
        X.cut_chars(F.col("full_text"), max_length, X.CUT_MARKER).alias("text"),
        P.is_cut(F.col("full_text"), max_length).alias("text_truncated"),
        F.map_from_entries(F.transform("extracted", settled)).alias("fields"),
        F.try_parse_json("jsonld_text").alias("schema_org"),
        "anchors",
        "keep_body_text",
        "follow_links",
    )
    is_object = F.startswith(F.schema_of_variant("schema_org"), F.lit("OBJECT"))
    return (
        R.finish_extraction(ready)
        .withColumn("anchors", F.when(F.col("allow_follow"), F.col("anchors")).otherwise(F.slice("anchors", 1, 0)))
        .withColumn("schema_org", F.when(is_object, F.col("schema_org")))
        .drop("keep_body_text", "follow_links")
    )


def saved_records(records: DataFrame, order_by: tuple[str, ...] = ()) -> DataFrame:
    """Records with ``is_new`` and ``outcome``; only new ones are written.

    Finding copies reads the records twice (hashes first, then the rows), so
    they are stored once in between: pages are parsed a single time, and the
    first pass reads only the hash, id and row number.
    """
    hashed = records.withColumn("content_hash", P.dedup_hash("text", F.col("fields"), F.col("allow_index")))
    located = stored(hashed.withColumn("_row", F.monotonically_increasing_id()), "records")
    marked = P.mark_new(located, "page_id", list(order_by), F.col("allow_index"))
    outcome = P.page_outcome(F.lit(False), F.col("allow_index"), F.col("is_new"), F.col("text_truncated"))
    return marked.withColumn("outcome", outcome)
