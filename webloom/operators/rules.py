"""Rule corpus jobs: which rule applies to a page, what it extracts, how well it works.

Rules meet pages through the hosts of the pages; a side of a join is broadcast
only after its rows were counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.functions import urls as U
from webloom.functions.urls import let
from webloom.operators import pages as P
from webloom.operators.ranking import checked_side, numbered, running_sum
from webloom.session import stored
from webloom.sources.rules import DEFAULT_RULE, java_pattern

# Order of sources and scopes.
SOURCE_ORDER = ("pip", "remote", "user")
UNKNOWN_SOURCE_RANK = 99
SCOPE_ORDER = ("domain_pattern", "domain_all", "global_pattern", "any")
# Currency signs, longest first.
CURRENCY_SIGNS = ("R$", "¥", "$", "€", "£", "₹", "₩", "₽", "₺")
# Fixed value: a rule slower than this is marked, in milliseconds.
SLOW_MS = 1000


def _rank(value: Column, order: tuple[str, ...], other: int) -> Column:
    out = F.when(value == order[0], 0)
    for n, name in enumerate(order[1:], 1):
        out = out.when(value == name, n)
    return out.otherwise(other)


def source_rank(source: Column) -> Column:
    return _rank(source, SOURCE_ORDER, UNKNOWN_SOURCE_RANK)


def is_generic() -> Column:
    return F.col("scope").isin("global_pattern", "any")


def _pattern_length() -> Column:
    return F.when(F.col("scope").isin("domain_pattern", "global_pattern"), F.length("url_pattern")).otherwise(0)


def rule_dedup(rules: DataFrame) -> DataFrame:
    """One rule per name. The row limit per name is applied before the shuffle too."""
    order = Window.partitionBy("name").orderBy(source_rank(F.col("source")), F.desc("version"), "path")
    return rules.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def rule_rank(rules: DataFrame, max_total: int | None = None, max_generic: int | None = None) -> DataFrame:
    """Rules in order of precision with ``rank``; names are unique.

    With limits, the first ``max_total`` stay, and of the general ones among
    them the first ``max_generic``. Ranks are counted bucket by bucket.
    """
    keys = {"_s": _rank(F.col("scope"), SCOPE_ORDER, 3), "_l": -_pattern_length(), "_v": -F.col("version")}
    order, bucket = [*keys, "name"], F.struct(*keys)
    kept = rules.withColumns(keys)
    if max_total is not None:
        kept = kept.orderBy(*order).limit(max_total)
    if max_generic is not None:
        counted = running_sum(kept, is_generic().cast("bigint"), order, bucket, "_generic")
        kept = counted.where(~is_generic() | (F.col("_generic") <= max_generic)).drop("_generic")
    return numbered(kept, order, bucket, "rank").withColumn("rank", F.col("rank").cast("int")).drop(*keys)


def rule_conflicts(rules: DataFrame) -> DataFrame:
    """Keys that several enabled rules share, with their number and first name."""
    has_domains = F.col("scope").isin("domain_pattern", "domain_all")
    has_pattern = F.col("scope").isin("domain_pattern", "global_pattern")
    return (
        rules.where("enabled")
        .groupBy(
            "scope",
            F.when(has_domains, F.array_join(F.array_sort("domains"), ",")).otherwise("").alias("domain_key"),
            F.when(has_pattern, F.col("url_pattern")).otherwise("").alias("pattern_key"),
            "version",
        )
        .agg(F.count(F.lit(1)).alias("n_rules"), F.min("name").alias("first_name"))
        .where("n_rules > 1")
    )


def overlay(rules: DataFrame, disabled: DataFrame | None) -> DataFrame:
    """``enabled`` by the list of disabled names when there is one, else as stored."""
    if disabled is None:
        return rules
    names = disabled.select("name").distinct().withColumn("_off", F.lit(True))
    return rules.join(names, "name", "left").withColumn("enabled", F.col("_off").isNull()).drop("_off")


def rule_snapshot(rules: DataFrame, disabled: DataFrame | None = None) -> DataFrame:
    """The rules a run works with: one per name, ranked, switched on or off."""
    return overlay(rule_rank(rule_dedup(rules)), disabled)


# Patterns of one fixed beginning: an anchored text without signs of the pattern language, and what follows it.
_PLAIN_START = r"^\^((?:[A-Za-z0-9/_~%=&,;:@ -]|\\[./-])+)(?![*+?{])(.*)$"


def _entries(snapshot: DataFrame) -> DataFrame:
    """(key, e) of every enabled rule and domain; general rules have the key ``*``.

    A pattern that begins with fixed text is kept as that text and, if more
    follows, the pattern: the text is compared first.
    """
    pattern = F.when(F.col("scope").isin("domain_pattern", "global_pattern"), java_pattern(F.col("url_pattern")))
    has_start = pattern.rlike(_PLAIN_START) & ~F.contains(pattern, F.lit("|"))
    start = F.when(has_start, F.replace(F.regexp_extract(pattern, _PLAIN_START, 1), F.lit("\\"), F.lit("")))
    rest = F.when(has_start & (F.regexp_extract(pattern, _PLAIN_START, 2) == ""), F.lit(None)).otherwise(pattern)
    entry = F.struct(
        (-_pattern_length()).cast("int").alias("length"),
        (-F.col("version")).cast("int").alias("version"),
        source_rank(F.col("source")).alias("source"),
        F.col("name").alias("name"),
        start.alias("start"),
        rest.alias("pattern"),
    )
    keys = F.when(F.size("domains") > 0, F.transform("domains", lambda d: F.rtrim(F.lower(d), F.lit(".")))).otherwise(F.array(F.lit("*")))
    return snapshot.where("enabled").select(F.explode(F.array_distinct(keys)).alias("key"), entry.alias("e"))


# Signs that stand for a dot, question mark or plus while a pattern is taken apart, and for what is no fixed text.
_HELD, _GAP = "\ue001\ue002\ue003", "\ue000"
GRAM = 3


def required_text(pattern: Column) -> Column:
    """The longest text that every match of a pattern holds, as far as plain steps tell; '' if they tell none."""
    steps = (
        (r"\\([./?+-])", None),
        (r"\\.", _GAP),
        (r"\[\^?\]?[^\]]*\]", _GAP),
        # Groups, two deep; what stands in them may be left out.
        (r"\([^()]*\)", _GAP),
        (r"\([^()]*\)", _GAP),
        (r"(?s).[*?]|.\{[^}]*\}", _GAP),
        (r"(?s)(.)\+", "$1" + _GAP),
        (r"[.^$]", _GAP),
    )
    text = pattern
    for search, put in steps:
        if put is None:
            for sign, held in zip(".?+", _HELD, strict=True):
                text = F.replace(text, F.lit("\\" + sign), F.lit(held))
            put = "$1"
        text = F.regexp_replace(text, search, put)
    pieces = F.split(text, _GAP, -1)
    longest = F.array_max(F.transform(pieces, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    # Flags, lookaround, codes and choices are not taken apart.
    odd = pattern.rlike(r"\(\?|\+\+|\\[xupPcQkN0-9]") | text.rlike(r"[|()]")
    return F.when(odd, "").otherwise(F.translate(longest, _HELD, ".?+"))


def _grams(text: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.when(F.length(text) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM)))))


# Parts into which paths are dealt for patterns without fixed text.
WILD_PARTS = 32


def _fits(e: Column, at: Column) -> Column:
    begins = e["start"].isNull() | F.startswith(at, e["start"])
    return begins & F.when(begins, e["pattern"].isNull() | F.rlike(at, e["pattern"]))


def general_hits(paths: DataFrame, general: DataFrame) -> DataFrame:
    """(_at, _hits): rules of ``general(e)`` with patterns that fit the distinct ``paths(_at)``.

    A rule is a row keyed by one gram of the text its pattern requires; a path
    meets the rules of its own grams, and only those with the text are tested
    against the pattern. Rules without such text meet the paths in parts.
    """
    needed = F.coalesce("e.start", required_text(F.col("e.pattern")))
    keyed = stored(general.select("e", needed.alias("text")).withColumn("grams", _grams(F.col("text"))), "general_rules")
    # Of the grams of a text one is taken, by its hash, so that like beginnings do not share a list.
    gram = F.array_min(F.transform("grams", lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))["g"]
    index = keyed.where("grams IS NOT NULL").select(gram.alias("gram"), "text", "e")
    with_text = paths.select("_at", F.explode(_grams(F.col("_at"))).alias("gram")).join(checked_side(index), "gram").where(F.contains("_at", F.col("text")))
    wild = keyed.where("grams IS NULL").select("e", F.explode(F.array(*map(F.lit, range(WILD_PARTS)))).alias("part"))
    without = paths.withColumn("part", F.pmod(F.xxhash64("_at"), F.lit(WILD_PARTS)).cast("int")).join(wild, "part")
    met = with_text.select("_at", "e").unionByName(without.select("_at", "e")).where(_fits(F.col("e"), F.col("_at")))
    return met.groupBy("_at").agg(F.collect_list(F.struct(F.lit(2).alias("score"), "e")).alias("_hits"))


# Rules, counted by their domains, and bytes of them as JSON, that are gone through for every page.
FEW_RULES, FEW_BYTES = 256, 1 << 20


def _is_short(entries: DataFrame, few: int) -> bool:
    rows, size = entries.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json("e")))).first()
    return rows <= few and (size or 0) <= FEW_BYTES


def _listed_hits(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """``pages(url, _host)`` with ``_hits`` out of a short list of rules."""
    listed = entries.agg(F.collect_list(F.struct("key", "e"))).scalar()
    suffixes = F.when(F.col("_host") != "", U.host_suffixes(F.col("_host")))
    met = pages.withColumn("_listed", listed).withColumn("_suffixes", suffixes).withColumn("_at", U.path_and_query("url"))

    def meets(r: Column) -> Column:
        return ((r["key"] == "*") | F.array_contains("_suffixes", r["key"])) & _fits(r["e"], F.col("_at"))

    score = lambda r: F.when(r["key"] == "*", 2).when(r["key"] == F.col("_host"), 0).otherwise(1)
    return met.withColumn("_hits", F.transform(F.filter("_listed", meets), lambda r: F.struct(score(r).alias("score"), r["e"].alias("e"))))


def _ranked(met: DataFrame, columns: list[str]) -> DataFrame:
    """``candidates`` and ``rule`` from ``_hits``."""
    ordered = F.array_distinct(F.transform(F.array_sort("_hits"), lambda r: r["e"]["name"]))
    return met.withColumn("candidates", ordered).withColumn("rule", F.coalesce(F.get("candidates", F.lit(0)), F.lit(DEFAULT_RULE))).select(
        *columns, "candidates", "rule"
    )


def rule_match(pages: DataFrame, snapshot: DataFrame, few: int = FEW_RULES) -> DataFrame:
    """``pages`` with ``rule`` and ``candidates`` (names, best first).

    Rules of domains are joined to the distinct suffixes of the pages' hosts,
    however many there are, and give one list per host; general rules with a
    pattern meet the distinct paths by their required text. Rules for every page
    are candidates of every row, so they are one list. Pages meet the lists of
    their host and path, which are broadcast if they are small, and rank the hits
    within the row. The fixed beginning of a pattern is compared before it. Up to
    ``few`` rules, counted by their domains, are one short list that every row
    goes through, with the same result and without the joins.
    """
    entries = stored(_entries(snapshot), "rule_entries")
    host = F.rtrim(U.split_url("url").host, F.lit("."))
    if _is_short(entries, few):
        return _ranked(_listed_hits(pages.withColumn("_host", host), entries), pages.columns)
    hosts = pages.select(host.alias("_host")).where("_host <> ''").distinct()
    suffixes = hosts.select("_host", F.posexplode(U.host_suffixes(F.col("_host"))).alias("_i", "key"))
    scored = F.struct(F.when(F.col("_i") == 0, 0).otherwise(1).alias("score"), "e")
    lists = suffixes.join(entries.where("key <> '*'"), "key").groupBy("_host").agg(F.collect_list(scored).alias("_own"))
    general = entries.where("key = '*'")
    patterned = F.col("e.start").isNotNull() | F.col("e.pattern").isNotNull()
    for_all = general.where(~patterned).agg(F.collect_list(F.struct(F.lit(2).alias("score"), "e"))).scalar()
    met = pages.withColumn("_host", host).join(checked_side(stored(lists, "rule_hosts")), "_host", "left")
    met = met.withColumn("_at", U.path_and_query("url")).withColumn("_all", for_all)
    none = F.slice("_all", 1, 0)
    own = F.filter(F.coalesce("_own", none), lambda r: _fits(r["e"], F.col("_at")))
    hits = F.concat(own, "_all")
    if not general.where(patterned).isEmpty():
        paths = pages.select(U.path_and_query("url").alias("_at")).distinct()
        found = stored(general_hits(paths, general.where(patterned).select("e")), "rule_paths")
        met = met.join(checked_side(found), "_at", "left")
        hits = F.concat(hits, F.coalesce("_hits", none))
    return _ranked(met.withColumn("_hits", hits), pages.columns)


def definitions(snapshot: DataFrame) -> DataFrame:
    """What the rules extract, stored once and broadcast if that is small."""
    defs = snapshot.select(
        F.col("name").alias("rule"),
        F.col("fields").alias("rule_fields"),
        F.to_json("fields").alias("fields_spec"),
        "keep_body_text",
        "follow_links",
    )
    return checked_side(stored(defs, "rule_definitions"))


def with_rule(matched: DataFrame, defined: DataFrame) -> DataFrame:
    """Matched pages with the definition of their rule, from ``definitions``."""
    return matched.join(defined, "rule", "left")


def field_extract(pages: DataFrame, snapshot: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row per page and field of the winning rule: ``values`` is NULL when nothing was found.

    ``pages`` has page_id, url, html and rule. Every page is parsed once.
    """
    parsed = P.parse_pages(with_rule(pages, definitions(snapshot)), facts=False, carry=("rule",))
    return parsed.select("page_id", "rule", F.explode("extracted").alias("e")).select(
        "page_id",
        "rule",
        F.col("e.field").alias("field"),
        F.transform("e.values", lambda v: X.cut_bytes(v, max_bytes)).alias("values"),
    )


def _has_group(pattern: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"\[\^?\]?[^\]]*\]", "")
    return bare.rlike(r"\((?!\?)|\(\?P?<[A-Za-z]")


def transform_value(values: Column, multiple: Column, t: Column, max_bytes: int | None = None) -> Column:
    """``values`` after the steps of ``t`` in their fixed order; lists skip regex and replace."""
    quoted = "|".join(f"\\Q{sign}\\E" for sign in CURRENCY_SIGNS)

    def each(on: Column, step):
        return lambda vs: F.when(on, F.transform(vs, step)).otherwise(vs)

    def by_regex(v: Column) -> Column:
        pattern = java_pattern(t["regex"])
        group = F.when(_has_group(t["regex"]), 1).otherwise(0)
        return F.when(F.rlike(v, pattern), F.call_function("regexp_extract", v, pattern, group))

    def by_replace(v: Column) -> Column:
        return F.replace(v, t["replace_from"], t["replace_to"])

    stripped = let(values, each(F.coalesce(t["strip"], F.lit(False)), X.strip_space))
    clean = let(
        stripped,
        each(
            F.coalesce(t["strip_currency"], F.lit(False)),
            lambda v: X.strip_space(F.regexp_replace(v, quoted, "")),
        ),
    )
    found = let(clean, each(~multiple & t["regex"].isNotNull(), by_regex))
    found = let(found, lambda vs: F.when(~F.exists(vs, lambda v: v.isNull()), vs))
    usable = t["replace_to"].isNotNull() & (F.coalesce(t["replace_from"], F.lit("")) != "")
    replaced = let(found, each(~multiple & usable, by_replace))
    return let(
        replaced,
        lambda vs: F.when(
            multiple & t["join"].isNotNull() & vs.isNotNull(), F.array(X.cut_bytes(F.call_function("array_join", vs, t["join"]), max_bytes))
        ).otherwise(vs),
    )


def finish_extraction(df: DataFrame) -> DataFrame:
    """Settle extraction type, fields, text and anchors of matched pages.

    ``df`` has rule, fields (map, NULL values: not found), text, anchors,
    keep_body_text and follow_links. A page whose fields are all NULL falls back
    to the default type with its text; such pages have no fields, filled or in
    all (``fields_filled``, ``fields_total``).
    """
    default = F.col("rule") == DEFAULT_RULE
    all_null = ~default & (F.size("fields") > 0) & F.forall(F.map_values("fields"), lambda v: v.isNull())
    to_default = default | all_null
    no_fields = F.create_map().cast("map<string,array<string>>")
    keep_text = to_default | F.coalesce("keep_body_text", F.lit(False))
    follow = default | F.coalesce("follow_links", F.lit(True))
    return df.withColumns(
        {
            "extraction_type": F.when(to_default, DEFAULT_RULE).otherwise(F.col("rule")),
            "fields": F.when(to_default, no_fields).otherwise(F.col("fields")),
            "fields_filled": F.when(to_default, 0).otherwise(F.size(F.filter(F.map_values("fields"), lambda v: v.isNotNull()))),
            "fields_total": F.when(to_default, 0).otherwise(F.size("fields")),
            "text": F.when(keep_text, F.col("text")).otherwise(""),
            "text_truncated": keep_text & F.col("text_truncated"),
            "anchors": F.when(follow, F.col("anchors")).otherwise(F.slice("anchors", 1, 0)),
        }
    )


def rule_stats(df: DataFrame) -> DataFrame:
    """Per rule: hits, filled and total fields, fill rate, average time, slow runs."""
    return (
        df.groupBy("rule")
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.sum("fields_filled").alias("fields_filled"),
            F.sum("fields_total").alias("fields_total"),
            F.avg("elapsed_ms").alias("avg_ms"),
            F.count_if(F.col("elapsed_ms") > SLOW_MS).alias("slow_count"),
        )
        .withColumn("fill_rate", F.col("fields_filled") / F.greatest(F.col("fields_total"), F.lit(1)))
    )


def rule_runs(records: DataFrame, elapsed_ms: Column | None = None) -> DataFrame:
    """Runs for ``rule_stats`` out of crawl records: one per page that a rule served, none for pages of the default type.

    Stored pages carry no timing, so the times are NULL unless a column is named.
    """
    elapsed = F.lit(None) if elapsed_ms is None else elapsed_ms
    served = records.where(F.col("extraction_type") != DEFAULT_RULE)
    return served.select(F.col("extraction_type").alias("rule"), "fields_filled", "fields_total", elapsed.cast("double").alias("elapsed_ms"))


def rule_quality(extracted: DataFrame) -> DataFrame:
    """Per rule and field: results that are NULL, empty lists or blank; ``failing`` when there are any."""
    single_blank = (F.size("values") == 1) & (X.strip_space(F.get("values", F.lit(0))) == "")
    return (
        extracted.groupBy("rule", "field")
        .agg(
            F.count(F.lit(1)).alias("results"),
            F.count_if(F.col("values").isNull()).alias("null_results"),
            F.count_if(F.size("values") == 0).alias("empty_lists"),
            F.count_if(single_blank).alias("blank_results"),
        )
        .withColumn("failing", (F.col("null_results") + F.col("empty_lists") + F.col("blank_results")) > 0)
    )


def catalog_diff(old: DataFrame, new: DataFrame, sources: DataFrame, max_failures: int = 3) -> DataFrame:
    """Rules of ``(source, rule, body)`` that are new, removed, changed or the same.

    Sources that are disabled, moved or failed ``max_failures`` times are left out.
    """
    out_of_use = sources.where(
        F.col("disabled") | F.col("moved") | (F.col("failures") >= max_failures)
    ).select("source")

    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select("source", "rule", F.sha2(F.col("body").cast("binary"), 256).alias(name))

    change = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .otherwise("same")
    )
    return (
        hashed(old, "old_hash")
        .join(hashed(new, "new_hash"), ["source", "rule"], "full_outer")
        .withColumn("change", change)
        .join(out_of_use, "source", "left_anti")
    )
