"""Robots bodies as relations, with array expressions only: one narrow stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.functions.urls import let


def _lines(body: Column) -> Column:
    """Trimmed lines without blanks and comment lines."""
    raw = F.transform(F.split(body, r"\R|[\x1c-\x1e]", -1), X.strip_space)
    return F.filter(raw, lambda s: (s != "") & ~F.startswith(s, F.lit("#")))


def _value(line: Column) -> Column:
    return X.strip_space(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1))


def _is(line: Column, name: str) -> Column:
    return F.startswith(F.lower(line), F.lit(name + ":"))


def rule_parts(pattern: Column) -> Column:
    """A pattern as literal texts: ``*`` is any text, a last ``$`` the end.

    ``head`` begins the path, the texts of ``middle`` follow in order, ``tail``
    (NULL: none asked) ends it. Without ``open``, a ``*`` in the pattern, the
    whole path is given.
    """
    ends = F.endswith(pattern, F.lit("$"))
    body = F.when(ends, F.left(pattern, F.length(pattern) - 1)).otherwise(pattern)

    def of(pieces: Column) -> Column:
        rest = F.slice(pieces, 2, F.size(pieces))
        open_ = F.size(pieces) > 1
        middle = F.when(ends & open_, F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest)
        return F.struct(
            pieces[0].alias("head"),
            F.filter(middle, lambda p: p != "").alias("middle"),
            F.when(ends, F.when(open_, F.element_at(pieces, -1)).otherwise("")).alias("tail"),
            open_.alias("open"),
        )

    return let(F.split(body, "[*]", -1), of)


def parse_robots(bodies: DataFrame, agent: str, rfc: bool = False) -> DataFrame:
    """One row per origin: ``rules``, ``crawl_delay``, ``sitemaps``, ``fetch_status``.

    ``bodies`` has origin, body, status (NULL: never asked, 0: failed). Of
    several agent lines in a row only the last one owns the rules that follow;
    with ``rfc`` they share them. ``rules`` is NULL when everything is allowed.
    """
    body = F.when(F.col("status") == 200, F.col("body"))
    joined = F.concat(F.lit("\n"), F.array_join(_lines(body), "\n"))
    if rfc:
        joined = F.regexp_replace(joined, r"(?i)\n(user-agent:[^\n]*)(?=\nuser-agent:)", "\n$1\u0001")
        joined = F.replace(joined, F.lit("\u0001\n"), F.lit("\u0001"))
    # Text before the first agent line belongs to nobody.
    pieces = F.split(joined, r"(?i)\n(?=user-agent:)", -1)
    blocks = F.transform(
        F.slice(pieces, 2, F.size(pieces)),
        lambda b: let(
            F.split(b, "\n", -1),
            lambda lines: F.struct(
                F.transform(F.split(lines[0], "\u0001"), lambda h: F.lower(_value(h))).alias("agents"),
                F.slice(lines, 2, F.size(lines)).alias("lines"),
            ),
        ),
    )
    mine = agent.lower()

    def owned(blocks: Column, name: str) -> Column:
        return F.filter(blocks, lambda b: F.array_contains(b["agents"], name))

    def of_group(blocks: Column) -> Column:
        own, rest = owned(blocks, mine), owned(blocks, "*")
        group = F.when(F.size(own) > 0, own).when(F.size(rest) > 0, rest)
        return F.struct(
            F.flatten(F.transform(group, lambda b: b["lines"])).alias("lines"),
            F.filter(
                F.transform(
                    F.filter(F.flatten(F.transform(blocks, lambda b: b["lines"])), lambda s: _is(s, "sitemap")), _value
                ),
                lambda s: s != "",
            ).alias("sitemaps"),
        )

    def rule(line: Column) -> Column:
        pattern = _value(line)
        return F.struct(
            F.when(_is(line, "allow"), "allow").otherwise("disallow").alias("kind"),
            pattern.alias("pattern"),
            F.length(pattern).alias("specificity"),
            rule_parts(pattern).alias("parts"),
        )

    def delay(line: Column) -> Column:
        plain = F.when(_is(line, "crawl-delay"), _value(line).try_cast("double"))
        rate = F.split(_value(line), "/", 2)
        requests, seconds = (X.strip_space(F.get(rate, i)).try_cast("double") for i in (0, 1))
        spaced = F.when(_is(line, "request-rate") & (requests > 0) & (seconds > 0), seconds / requests)
        return F.coalesce(plain, spaced)

    parsed = bodies.select("origin", "status", let(blocks, of_group).alias("g"))
    rule_lines = F.filter(F.col("g.lines"), lambda s: (_is(s, "allow") | _is(s, "disallow")) & (_value(s) != ""))
    delays = F.filter(
        F.transform(F.col("g.lines"), delay), lambda d: d.isNotNull() & ~F.isnan(d) & (d > 0)
    )
    status = (
        F.when(F.col("status").isNull(), "not_checked")
        .when(F.col("status") == 200, "ok")
        .when(F.col("status") > 0, F.concat(F.lit("http_"), F.col("status").cast("string")))
        .otherwise("fetch_failed")
    )
    return parsed.select(
        "origin",
        F.transform(rule_lines, rule).alias("rules"),
        F.get(delays, F.size(delays) - 1).alias("crawl_delay"),
        F.col("g.sitemaps").alias("sitemaps"),
        status.alias("fetch_status"),
    )


def robots_rules(parsed: DataFrame) -> DataFrame:
    """One row per origin and rule."""
    return parsed.select("origin", F.posexplode("rules").alias("position", "r")).select("origin", "position", "r.*")
