"""Jobs over URL tables. Settings (patterns, suffixes, seed domains) are short
lists given by the caller; they become literals, so none of these jobs joins."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.functions import urls as U
from webloom.operators.ranking import salted_join


def canonical_groups(df: DataFrame, id_col: str = "page_id", url_col: str = "url", tracking: Iterable[str] = U.TRACKING_PARAMS) -> DataFrame:
    """URLs that share a canonical form."""
    return (
        df.select(id_col, U.canonical_url(url_col, tracking).alias("canonical"))
        .groupBy("canonical")
        .agg(F.count(F.lit(1)).alias("n_variants"), F.min(id_col).alias("first_page_id"))
    )


def url_validity(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.withColumn("reason", F.coalesce(U.invalid_reason(url_col), F.lit("valid")))


def matching_patterns(url: Column | str, patterns: Sequence[str]) -> Column:
    """The patterns found anywhere in the URL; each is a constant, so it is compiled once."""
    url = F.col(url) if isinstance(url, str) else url
    hits = F.array(*[F.when(url.rlike(p), F.lit(p)) for p in patterns]) if patterns else F.array().cast("array<string>")
    return F.array_compact(hits)


def is_excluded(url: Column | str, patterns: Sequence[str]) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    hit = F.lit(False)
    for p in patterns:
        hit = hit | url.rlike(p)
    return hit


def exclude(df: DataFrame, patterns: Sequence[str], url_col: str = "url") -> DataFrame:
    return df.where(~is_excluded(url_col, patterns))


def pattern_hits(df: DataFrame, patterns: Sequence[str], url_col: str = "url") -> DataFrame:
    return (
        df.select(F.explode(matching_patterns(url_col, patterns)).alias("pattern"))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def split_assets(df: DataFrame, url_col: str = "url") -> DataFrame:
    return df.withColumn("extension", U.path_extension(url_col)).withColumn(
        "kind", F.when(F.col("extension").isin(*U.DOWNLOAD_EXTENSIONS), "download").otherwise("page")
    )


def suffix_rules(lines: DataFrame) -> DataFrame:
    """(suffix, extra) of the lines of a public suffix list (column ``line``): comments and blanks are left out.

    ``extra`` is what a rule adds to the labels of its suffix: 1 for a wildcard,
    -1 for an exception.
    """
    rule = F.lower(F.regexp_extract(F.trim("line"), r"^(\S*)", 1))
    kind = F.when(F.startswith(rule, F.lit("*.")), 1).when(F.startswith(rule, F.lit("!")), -1).otherwise(0)
    rows = lines.select(rule.alias("rule"), kind.alias("extra")).where((F.col("rule") != "") & ~F.startswith("rule", F.lit("//")))
    return rows.select(F.regexp_replace("rule", r"^([*][.]|!)", "").alias("suffix"), "extra").distinct()


def with_suffix(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``hosts(host, ...)`` with ``labels``, the size of their public suffix by ``rules(suffix, extra)`` of any number.

    The suffixes of a host meet the rules by an equi-join: an exception holds
    before the longest rule, and without a rule the last label is the suffix.
    """
    parts = hosts.select("host", F.posexplode(U.host_suffixes(F.col("host"))).alias("_at", "suffix"))
    labels = F.size(F.split("suffix", r"\.")) + F.col("extra")
    # A wildcard needs a label before its own.
    found = parts.join(rules, "suffix").where("extra < 1 OR _at > 0").select("host", F.struct((F.col("extra") < 0).alias("spared"), labels.alias("labels")).alias("_s"))
    best = found.groupBy("host").agg(F.max("_s")["labels"].alias("labels"))
    return hosts.join(best, "host", "left").withColumn("labels", F.coalesce("labels", F.lit(1)))


def domain_rollup(df: DataFrame, url_col: str = "url", suffixes: Iterable[str] | DataFrame = U.PUBLIC_SUFFIXES) -> DataFrame:
    """Pages per domain. Hosts are counted first; the suffix work runs once per host.

    ``suffixes``: a short list of rules, or the relation of ``suffix_rules`` for a
    full one.
    """
    hosts = df.groupBy(U.split_url(url_col).host.alias("host")).agg(F.count(F.lit(1)).alias("n"))
    host = F.col("host")
    if isinstance(suffixes, DataFrame):
        hosts = with_suffix(hosts, suffixes)
    else:
        hosts = hosts.withColumn("labels", U.suffix_labels(host, tuple(suffixes)))
    named = hosts.select(U.without_www(host, F.col("labels")).alias("domain"), U.registrable_of(host, F.col("labels")).alias("registrable"), "n")
    return named.groupBy("domain", "registrable").agg(F.sum("n").alias("pages"))


def same_domain(df: DataFrame, seeds: Iterable[str], url_col: str = "url") -> DataFrame:
    """``df`` with ``kept``; an empty seed set keeps everything."""
    seeds = tuple(seeds)
    return df.withColumn("kept", U.domain_of(url_col).isin(*seeds) if seeds else F.lit(True))


def same_domain_as(df: DataFrame, seeds: DataFrame, url_col: str = "url") -> DataFrame:
    """As ``same_domain`` for a seed relation of any size (column ``domain``)."""
    known = seeds.select("domain").distinct().withColumn("kept", F.lit(True))
    joined = salted_join(df.withColumn("domain", U.domain_of(url_col)), known, "domain", F.col(url_col))
    return joined.withColumn("kept", F.coalesce("kept", F.lit(False)))


def origins(df: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    return df.groupBy(U.origin_of(url_col).alias("origin")).agg(
        F.min(id_col).alias("first_page_id"), F.count(F.lit(1)).alias("pages")
    )


def redact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Masked columns and ``masked``: whether any of them changed."""
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(U.redact(F.col(c)))
    out = df.withColumn("masked", changed)
    return out.withColumns({c: U.redact(F.col(c)) for c in columns})


def sanitize(df: DataFrame, column: str, mode: str = "controls") -> DataFrame:
    """``clean`` and ``changed`` for one text column; mode ``controls`` or ``printable``."""
    clean = X.remove_hidden_controls(F.col(column)) if mode == "controls" else X.printable(F.col(column))
    return df.withColumn("clean", clean).withColumn("changed", ~F.col("clean").eqNullSafe(F.col(column)))
