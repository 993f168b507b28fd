"""Outcome, error and progress statistics. Everything is a grouped sum; hot keys
are reduced on the map side, and maps are only built over fixed sets of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.operators.rules import SLOW_MS

# Outcomes that are a handled page and outcomes that are a fault.
SUCCESS_OUTCOMES = ("ok", "truncated", "duplicate", "noindex", "parse_failed", "robots_denied")
FAILURE_OUTCOMES = ("fetch_error", "internal_error", "stopped")

# Categories of browser error codes, most specific first. A pattern that ends in _ is a prefix.
CODE_CATEGORIES = (
    ("net::ERR_NAME_NOT_RESOLVED", "dns"),
    ("net::ERR_ADDRESS_UNREACHABLE", "dns"),
    ("net::ERR_ADDRESS_INVALID", "dns"),
    ("net::ERR_INTERNET_DISCONNECTED", "dns"),
    ("net::ERR_HOST_RESOLVER_QUEUE_TOO_LARGE", "dns"),
    ("net::ERR_SSL_", "ssl"),
    ("net::ERR_CERT_", "ssl"),
    ("net::ERR_CONNECTION_TIMED_OUT", "timeout"),
    ("net::ERR_TIMED_OUT", "timeout"),
    ("net::ERR_CONNECTION_REFUSED", "connection_refused"),
    ("net::ERR_NETWORK_ACCESS_DENIED", "connection_refused"),
    ("net::ERR_CONNECTION_RESET", "connection_reset"),
    ("net::ERR_CONNECTION_CLOSED", "connection_reset"),
    ("net::ERR_CONNECTION_ABORTED", "connection_reset"),
    ("net::ERR_CONNECTION_FAILED", "connection_reset"),
    ("net::ERR_NETWORK_IO_SUSPENDED", "connection_reset"),
    ("net::ERR_NETWORK_CHANGED", "connection_reset"),
    ("net::ERR_PROXY_", "proxy"),
    ("net::ERR_TUNNEL_", "proxy"),
    ("net::ERR_SOCKS_", "proxy"),
    ("net::ERR_ABORTED", "aborted"),
    ("net::ERR_BLOCKED_BY_", "aborted"),
    ("net::ERR_TOO_MANY_REDIRECTS", "too_many_redirects"),
    ("net::HTTP_403", "http_4xx"),
    ("net::HTTP_404", "http_4xx"),
    ("net::HTTP_410", "http_4xx"),
    ("net::HTTP_429", "http_4xx"),
    ("net::HTTP_451", "http_4xx"),
    ("net::HTTP_502", "http_5xx"),
    ("net::HTTP_503", "http_5xx"),
    ("net::HTTP_500", "http_5xx"),
    ("net::HTTP_", "generic"),
    ("net::ERR_", "generic"),
)
# Categories of messages without a code, in order.
MESSAGE_CATEGORIES = (
    ("Download is starting", "download"),
    ("Timeout exceeded (asyncio safety net)", "timeout"),
    ("Page.goto: Timeout", "timeout"),
    ("Navigation timeout", "timeout"),
    ("Target page, context or browser has been closed", "target_closed"),
    ("Target closed", "target_closed"),
    ("Session closed", "target_closed"),
    ("Browser closed", "target_closed"),
    ("Page crashed", "target_closed"),
    ("Execution context was destroyed", "target_closed"),
    ("上下文恢复失败", "context_failure"),
    ("上下文槽位修复失败", "context_failure"),
    ("代理轮换失败", "proxy_exhausted"),
)
# What is done after an error of a category; others are tried again.
STRATEGIES = {
    "fatal": ("dns", "ssl", "connection_refused", "download", "too_many_redirects", "http_4xx"),
    "rotate": ("proxy",),
    "replace": ("target_closed",),
}
ROTATED_BEHIND_PROXY = ("timeout", "connection_refused", "dns")


def error_category(error: Column) -> Column:
    """First matching category of an error text, in table order."""
    code = F.regexp_extract(error, r"net::(?:ERR_|HTTP_)\w+", 0)

    def by_code(pattern: str) -> Column:
        return F.startswith(code, F.lit(pattern)) if pattern.endswith("_") else code == pattern

    out = F.when(F.coalesce(error, F.lit("")) == "", "generic")
    for pattern, category in CODE_CATEGORIES:
        out = out.when(by_code(pattern), category)
    for text, category in MESSAGE_CATEGORIES:
        out = out.when((code == "") & F.contains(error, F.lit(text)), category)
    return out.otherwise("generic")


def retry_strategy(category: Column, has_proxy: Column) -> Column:
    out = F.when(has_proxy & category.isin(*ROTATED_BEHIND_PROXY), "rotate")
    for strategy, categories in STRATEGIES.items():
        out = out.when(category.isin(*categories), strategy)
    return out.otherwise("transient")


def classify_errors(df: DataFrame) -> DataFrame:
    """``df(error, has_proxy)`` with ``category`` and ``strategy``."""
    return df.withColumn("category", error_category(F.col("error"))).withColumn(
        "strategy", retry_strategy(F.col("category"), F.col("has_proxy"))
    )


def outcome_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def outcome_totals(counts: DataFrame, drops: DataFrame) -> DataFrame:
    """One row: ok, fail, dropped, all. ``all`` adds dropped links to pages, as the report always did."""
    ok = F.sum(F.when(F.col("outcome").isin(*SUCCESS_OUTCOMES), F.col("n")).otherwise(0))
    fail = F.sum(F.when(F.col("outcome").isin(*FAILURE_OUTCOMES), F.col("n")).otherwise(0))
    dropped = drops.agg(F.coalesce(F.sum("dropped"), F.lit(0))).scalar()
    return (
        counts.agg(F.coalesce(ok, F.lit(0)).alias("ok"), F.coalesce(fail, F.lit(0)).alias("fail"))
        .withColumn("dropped", dropped)
        .withColumn("all", F.col("ok") + F.col("fail") + F.col("dropped"))
    )


def outcome_summary(df: DataFrame, drops: DataFrame) -> DataFrame:
    """(metric, n): one row per outcome and the four totals."""
    counts = outcome_counts(df)
    totals = outcome_totals(counts, drops).select(
        F.explode(
            F.array(*[F.struct(F.lit(f"total_{c}").alias("metric"), F.col(c).alias("n")) for c in ("ok", "fail", "dropped", "all")])
        ).alias("t")
    )
    return counts.select(F.col("outcome").alias("metric"), "n").union(totals.select("t.*"))


def domain_stats(df: DataFrame) -> DataFrame:
    """Per domain of ``(domain, outcome, elapsed_ms)``: ok, fail, average time, outcome map.

    Rows are first reduced to one per domain and outcome; the map then holds at
    most one entry per known outcome.
    """
    parts = df.groupBy("domain", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed_ms").alias("ms"))

    def of(names: tuple[str, ...]) -> Column:
        return F.sum(F.when(F.col("outcome").isin(*names), F.col("n")).otherwise(0))

    return parts.groupBy("domain").agg(
        of(SUCCESS_OUTCOMES).alias("ok"),
        of(FAILURE_OUTCOMES).alias("fail"),
        (F.sum("ms") / F.sum("n")).alias("avg_ms"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"),
    )


def drop_summary(*drops: DataFrame) -> DataFrame:
    """Dropped links per reason over all channels of ``(reason, dropped)``."""
    parts = [d.select("reason", "dropped") for d in drops]
    return reduce(DataFrame.unionByName, parts).groupBy("reason").agg(F.sum("dropped").alias("dropped"))


def reason_counts(judged: DataFrame) -> DataFrame:
    """``(reason, dropped)`` of rows with a reason."""
    return judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("dropped"))


def depth_progress(urls: DataFrame, queue: DataFrame, failures: DataFrame, saved: DataFrame, max_requeue: int = 1) -> DataFrame:
    """Per depth: processed, queued, planned. ``saved(depth, processed, planned)`` are stored counters."""

    def tagged(df: DataFrame, **columns: Column) -> DataFrame:
        zero = {"done": F.lit(0), "queued": F.lit(0), "saved_done": F.lit(0), "saved_plan": F.lit(0)} | columns
        return df.select("depth", *[c.cast("bigint").alias(name) for name, c in zero.items()])

    one = F.lit(1)
    rows = reduce(
        DataFrame.union,
        [
            tagged(urls.where("status = 'completed'"), done=one),
            tagged(failures.where(F.col("requeue_count") >= max_requeue), done=one),
            tagged(queue, queued=one),
            tagged(saved, saved_done=F.col("processed"), saved_plan=F.col("planned")),
        ],
    )
    return depth_totals(rows)


def depth_totals(rows: DataFrame) -> DataFrame:
    """Per depth of ``(depth, done, queued, saved_done, saved_plan)``: processed, queued, planned."""
    sums = rows.groupBy("depth").agg(
        F.sum("done").alias("done"),
        F.sum("queued").alias("queued"),
        F.max("saved_done").alias("saved_done"),
        F.max("saved_plan").alias("saved_plan"),
    )
    processed = F.greatest("saved_done", "done")
    return sums.select(
        "depth",
        processed.alias("processed"),
        "queued",
        F.greatest(F.col("saved_plan"), processed + F.col("queued")).alias("planned"),
    )


def discovery_summary(found: DataFrame, robots: DataFrame) -> DataFrame:
    """Sitemap URLs of ``found(origin, url)`` per origin with the robots status, and a total row (origin NULL).

    Origins are counted before the join, so each is one row in it.
    """
    counts = found.groupBy("origin").agg(F.count("url").alias("sitemap_urls"))
    status = robots.select("origin", F.col("fetch_status").alias("robots_status"))
    return (
        counts.join(status, "origin", "left")
        .rollup("origin")
        .agg(
            F.max("robots_status").alias("robots_status"),
            F.sum("sitemap_urls").alias("sitemap_urls"),
            F.grouping("origin").cast("int").alias("is_total"),
        )
        .withColumn("robots_status", F.when(F.col("is_total") == 0, F.col("robots_status")))
    )


def redirect_stats(df: DataFrame) -> DataFrame:
    """Per domain of ``(domain, url, final_url)``: results under another URL than asked."""
    return df.groupBy("domain").agg(
        F.count_if(F.col("url") != F.col("final_url")).alias("redirects"), F.count(F.lit(1)).alias("results")
    )


def stats_merge(*snapshots: DataFrame) -> DataFrame:
    """Counters ``(metric, key, value)`` of several sessions added up."""
    parts = [s.select("metric", "key", "value") for s in snapshots]
    return reduce(DataFrame.unionByName, parts).groupBy("metric", "key").agg(F.sum("value").alias("value"))


def failure_counts(failures: DataFrame, max_requeue: int = 1) -> DataFrame:
    """Per depth: all failures, those that may be tried again, permanent ones."""
    again = F.col("requeue_count") < max_requeue
    return failures.groupBy("depth").agg(
        F.count(F.lit(1)).alias("failures"), F.count_if(again).alias("retryable"), F.count_if(~again).alias("permanent")
    )


def health_rollup(df: DataFrame, names: int) -> DataFrame:
    """Components per state of ``(component, state)`` with their first ``names`` names, and the worst state.

    The names come from a row limit per state, applied before the shuffle.
    """
    order = Window.partitionBy("state").orderBy("component")
    named = (
        df.withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= names)
        .groupBy("state")
        .agg(F.array_join(F.array_sort(F.collect_list("component")), ", ").alias("first_names"))
    )
    counts = df.groupBy("state").agg(F.count(F.lit(1)).alias("components"))
    severity = F.when(F.col("state") == "DOWN", 2).when(F.col("state") == "DEGRADED", 1).otherwise(0)
    worst = F.max_by("state", severity).over(Window.partitionBy())
    # At most one row per state is left here.
    return counts.join(named, "state").withColumn("overall", worst)


def token_usage(df: DataFrame) -> DataFrame:
    """Token sums of ``(conv_id, role, prompt_tokens, completion_tokens)`` per conversation and role, and over all."""
    df = df.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    sums = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    return df.groupingSets([["conv_id", "role"], []], "conv_id", "role").agg(*sums)


def ai_calls(df: DataFrame) -> DataFrame:
    """Per operation, provider and model: calls, errors, retries, average and longest time."""
    return df.groupBy("operation", "provider", "model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum("retry_count").alias("retries"),
        F.avg("duration_ms").alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
    )


def state_counts(urls: DataFrame, queue: DataFrame, failures: DataFrame, in_flight: DataFrame, boundary: DataFrame) -> DataFrame:
    """(metric, key, n): relation sizes, active domains, outcomes and depths of completed URLs."""
    done = urls.where("status = 'completed'")

    def size(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("metric"), F.lit(name).alias("key"), "n")

    def grouped(metric: str, df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(metric).alias("metric"), "key", "n"
        )

    domains = queue.select("domain").distinct().agg(F.count(F.lit(1)).alias("n"))
    parts = [
        size("urls", urls),
        size("queue", queue),
        size("failures", failures),
        size("in_flight", in_flight),
        size("boundary", boundary),
        domains.select(F.lit("active_domains").alias("metric"), F.lit("").alias("key"), "n"),
        grouped("outcome", done.where("outcome <> ''"), "outcome"),
        grouped("completed_at_depth", done, "depth"),
        grouped("queued_at_depth", queue, "depth"),
    ]
    return reduce(DataFrame.union, parts)


# The names of a log that a report counts by, and the part of the report each is.
REPORT_PARTS = {"outcome": "outcome_summary", "category": "fetch_errors", "reason": "drops", "rule": "rule_stats"}


def report_counts(log: DataFrame) -> DataFrame:
    """Typed rows ``(part, key, n, ...)`` of a log in one pass: counts by outcome, error category, drop reason
    and rule, and a row ``all`` with the time span. NULL names count nowhere."""
    names = list(REPORT_PARTS)
    part = F.lit("all")
    for name, of in REPORT_PARTS.items():
        part = F.when(F.grouping(name) == 0, of).otherwise(part)
    sums = [F.sum(c).alias(c) for c in ("fields_filled", "fields_total")]
    slow = F.count_if(F.col("elapsed_ms") > SLOW_MS).alias("slow_count")
    return (
        log.groupingSets([[n] for n in names] + [[]], *names)
        .agg(part.alias("part"), F.count(F.lit(1)).alias("n"), *sums, slow, F.min("us").alias("first_us"), F.max("us").alias("last_us"))
        .withColumn("key", F.coalesce(*names))
        .where("part = 'all' OR key IS NOT NULL")
        .drop(*names)
    )


def as_map(where: Column, key: str, value: Column) -> Column:
    """Rows of a small relation as one map; for key sets that a setting or the code bounds."""
    pairs = F.collect_list(F.when(where, F.struct(F.col(key).cast("string"), value.alias("v"))))
    return F.map_from_entries(F.array_sort(pairs))


def crawl_report(spark: SparkSession, log: DataFrame, depths: DataFrame, found: DataFrame) -> DataFrame:
    """One row with the nested report, each input read once.

    ``log`` has outcome, category, reason, rule (NULL where a row has none),
    fields_filled, fields_total, elapsed_ms, us; ``depths`` is ``depth_progress``,
    ``found(origin, urls, redirects)`` the sitemap URLs. The maps range over
    outcomes, categories, reasons, depths and rules, all bounded; figures per
    domain stay a relation of their own (``domain_stats``), since domains grow
    with the crawl.
    """

    def of(part: str, names: tuple[str, ...] | None = None) -> Column:
        return (F.col("part") == part) & (F.lit(True) if names is None else F.col("key").isin(*names))

    def total(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))

    ok, fail = (total(of("outcome_summary", names)) for names in (SUCCESS_OUTCOMES, FAILURE_OUTCOMES))
    dropped = total(of("drops"))
    values = {part: F.col("n") for part in REPORT_PARTS.values()} | {
        "rule_stats": F.struct(F.col("n").alias("hits"), "fields_filled", "fields_total", "slow_count")
    }
    parts = [as_map(of(part), "key", value).alias(part) for part, value in values.items()]
    totals = F.struct(ok.alias("ok"), fail.alias("fail"), dropped.alias("dropped"), (ok + fail + dropped).alias("all")).alias("totals")
    span = F.expr("(max(last_us) - min(first_us)) div 1000000").alias("duration_s")
    layers = as_map(F.lit(True), "depth", F.struct("processed", "queued", "planned"))
    sites = F.struct(F.count("origin").alias("origins"), F.sum("urls").alias("sitemap_urls"), F.coalesce(F.sum("redirects"), F.lit(0)).alias("redirects"))
    counted = report_counts(log).agg(F.struct(*parts, totals, span)).scalar()
    return (
        spark.range(1)
        .select(counted.alias("c"), depths.agg(layers).scalar().alias("depth_layers"), found.agg(sites).scalar().alias("s"))
        .select(
            F.struct(
                "c.*",
                "depth_layers",
                F.struct("s.origins", "s.sitemap_urls").alias("discovery"),
                F.col("s.redirects").alias("redirects"),
            ).alias("report")
        )
    )
