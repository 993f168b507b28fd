"""Robots verdicts and delays as joins on the origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.ranking import salted_join
from webloom.session import stored
from webloom.sources.robots import robots_rules


# Rules of an origin that travel with its URLs as one list; the rules of longer files are met as rows.
LISTED_RULES = 64


def one_line(path: Column) -> Column:
    """No rule matches a path with a line feed."""
    return ~F.contains(path, F.lit("\n"))


def fits(path: Column, parts: Column) -> Column:
    """Whether a path of one line is matched: every text at its first place after the one before."""
    def after(at: Column, text: Column) -> Column:
        return F.nullif(F.position(text, path, at + 1), F.lit(0)) + F.length(text) - 1

    at = F.aggregate(parts["middle"], F.length(parts["head"]), after)
    tail = parts["tail"]
    return F.startswith(path, parts["head"]) & (
        F.when(~parts["open"], tail.isNull() | (path == parts["head"]))
        .when(tail.isNull(), at.isNotNull())
        .otherwise(F.endswith(path, tail) & F.coalesce(at + F.length(tail) <= F.length(path), F.lit(False)))
    )


def is_allowed(path: Column, rules: Column) -> Column:
    """Longest matching rule wins, allow wins ties, no match allows."""
    hits = F.transform(
        F.filter(rules, lambda r: one_line(path) & fits(path, r["parts"])),
        lambda r: F.struct(r["specificity"].alias("s"), (r["kind"] == "allow").alias("ok")),
    )
    return F.coalesce(F.array_max(hits)["ok"], F.lit(True))


def denied_paths(paths: DataFrame, robots: DataFrame) -> DataFrame:
    """``(origin, path)`` rows that the rules deny, however many rules an origin has.

    A path is cut at the lengths that the beginnings of its origin's rules have;
    the pieces meet the rules by an equal join, so a path sees only the rules
    that begin like it, and the rest of a rule is tested on those alone.
    """
    rules = stored(
        robots_rules(robots)
        .groupBy("origin", "pattern")
        .agg(F.any_value("parts").alias("parts"), F.max("specificity").alias("s"), F.max(F.col("kind") == "allow").alias("ok")),
        "robots_rules",
    )
    lengths = rules.groupBy("origin").agg(F.collect_set(F.length("parts.head")).alias("lengths"))
    distinct = stored(paths.where(one_line(F.col("path"))).distinct(), "paths")
    reached = F.filter("lengths", lambda n: n <= F.length("path"))
    cut = salted_join(distinct, lengths, "origin", F.col("path"), "inner").select("origin", "path", F.explode(reached).alias("n"))
    keyed = cut.select("origin", "path", F.struct("origin", F.left("path", F.col("n")).alias("head")).alias("begin"))
    met = salted_join(
        keyed, rules.select(F.struct("origin", F.col("parts.head").alias("head")).alias("begin"), "parts", "s", "ok"), "begin", F.col("path"), "inner"
    )
    best = met.where(fits(F.col("path"), F.col("parts"))).groupBy("origin", "path").agg(F.max(F.struct("s", "ok")).alias("best"))
    return best.where(~F.col("best.ok")).select("origin", "path")


def robots_verdict(urls: DataFrame, robots: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with ``allowed``. Up to LISTED_RULES rules of an origin travel as one
    array, so a URL stays one row and nothing is grouped afterwards; origins with
    more rules are judged by ``denied_paths``, with the same result. A site or a
    URL with a large share of the rows is spread by salt."""
    path = U.percent_decode(U.split_url(url_col).path)
    left = urls.withColumns(
        {"origin": U.origin_of(url_col), "_path": F.when(path == "", F.lit("/")).otherwise(path)}
    )
    many = F.size("rules") > LISTED_RULES
    lists = robots.select("origin", F.when(~many, F.col("rules")).alias("rules"))
    joined = salted_join(left, lists, "origin", F.col(url_col))
    judged = joined.withColumn("allowed", is_allowed(F.col("_path"), F.col("rules"))).drop("rules")
    long = robots.where(many).select("origin", "rules")
    if long.isEmpty():
        return judged.drop("_path")
    long = stored(long, "long_robots")
    of_long = left.join(long.select("origin"), "origin", "left_semi")
    denied = denied_paths(of_long.select("origin", F.col("_path").alias("path")), long)
    place = F.struct("origin", F.col("_path").alias("path")).alias("_place")
    marked = salted_join(
        judged.select("*", place), denied.select(F.struct("origin", "path").alias("_place"), F.lit(True).alias("_denied")), "_place", F.col(url_col)
    )
    return marked.withColumn("allowed", F.col("allowed") & F.col("_denied").isNull()).drop("_path", "_place", "_denied")


def delay_overlay(domains: DataFrame, robots: DataFrame, minimum: float = 1.0, respect: bool = True) -> DataFrame:
    """Seconds between requests per domain: the robots delay if there is one, else the minimum.

    Of several origins of one domain the longest delay holds.
    """
    delays = robots.groupBy(U.domain_of("origin").alias("domain")).agg(F.max("crawl_delay").alias("robots_delay"))
    joined = domains.join(delays, "domain", "left")
    chosen = F.coalesce("robots_delay", F.lit(minimum)) if respect else F.lit(minimum)
    return joined.withColumn("delay", chosen)


def robots_status(df: DataFrame) -> DataFrame:
    """Origins per state; every HTTP answer counts as ok."""
    state = (
        F.when((F.col("fetch_status") == "ok") | F.startswith("fetch_status", F.lit("http_")), "ok")
        .when(F.col("fetch_status") == "not_checked", "not_checked")
        .otherwise("failed")
    )
    return df.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("origins"))
