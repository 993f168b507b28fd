"""Sitemaps: following index files, seeding, and splitting new from known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.ranking import ordered_take
from webloom.session import cut_lineage

# Default locations.
DEFAULT_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")


def sitemap_expand(entries: DataFrame, seeds: DataFrame, max_recursion: int | None = None) -> DataFrame:
    """URL entries of all sitemaps within reach of ``seeds(sitemap_url)``, each sitemap once.

    The index files are few next to the entries: the reachable set grows over
    index rows only, level by level until nothing new is found or
    ``max_recursion`` levels are done; the entries are joined once at the end.
    """
    index = cut_lineage(entries.where("kind = 'index'").select("sitemap_url", "loc").distinct())
    reached = level = cut_lineage(seeds.select("sitemap_url").distinct())
    depth = 0
    while max_recursion is None or depth < max_recursion:
        found = level.join(index, "sitemap_url").select(F.col("loc").alias("sitemap_url")).distinct()
        level = cut_lineage(found.join(reached, "sitemap_url", "left_anti"))
        if level.isEmpty():
            break
        reached, depth = reached.union(level), depth + 1
    return entries.where("kind = 'urlset'").join(reached, "sitemap_url", "left_semi")


def sitemap_candidates(origins: DataFrame, robots: DataFrame, paths: tuple[str, ...] = DEFAULT_PATHS) -> DataFrame:
    """Sitemap URLs to try per origin: those of robots, then the default paths."""
    joined = origins.select("origin").distinct().join(robots.select("origin", "sitemaps"), "origin", "left")
    named = F.coalesce("sitemaps", F.array().cast("array<string>"))
    defaults = F.transform(F.array(*[F.lit(p) for p in paths]), lambda p: F.concat(F.col("origin"), p))
    listed = joined.select("origin", F.explode(named).alias("s")).select(
        "origin",
        F.when(U.invalid_reason("s").isNull(), F.col("s")).otherwise(U.resolve("origin", "s")).alias("sitemap_url"),
    )
    return listed.union(joined.select("origin", F.explode(defaults))).distinct()


def sitemap_seed(entries: DataFrame, cap: int | None = None) -> DataFrame:
    """Canonical, valid URLs of the entries; with ``cap`` the first ones in order of sitemap and place."""
    urls = (
        entries.select("sitemap_url", "position", U.canonical_url("loc").alias("url"))
        .where("url IS NOT NULL")
        .where(U.invalid_reason("url").isNull())
    )
    if cap is None:
        return urls
    bucket = F.struct("sitemap_url", F.floor(F.col("position") / 50_000))
    return ordered_take(urls, cap, ["sitemap_url", "position"], bucket)


def known_urls(urls: DataFrame, queue: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Every URL the crawl has met, once."""
    return reduce(DataFrame.union, [d.select("url") for d in (urls, queue, in_flight)]).distinct()


def sitemap_new(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Canonical sitemap URLs with ``known``."""
    urls = entries.select(U.canonical_url("loc").alias("url")).where("url IS NOT NULL").distinct()
    return urls.join(known.withColumn("known", F.lit(True)), "url", "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )
