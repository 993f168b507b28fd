"""The crawl frontier as relations: admission, scheduling, retries, depth limits, recovery.

Relations: ``urls(url, depth, status, added_time, completed_time, outcome)``,
``queue(id, url, depth, added_time, domain)``, ``failures(url, depth, error, ts,
requeue_count)``, ``in_flight(url, depth, started_at)``, ``boundary(parent_url,
child_url, parent_depth)``. Each function maps relations to relations; joins are
on the URL, which is unique per relation, so they spread evenly.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import urls as U
from webloom.operators.ranking import BUCKET_ROWS, hot_keys, id_bucket, in_ranges, numbered, ordered_take, running_sum, salted_join
from webloom.operators.urls import is_excluded
from webloom.session import cut_lineage

# Retries, age of a stuck request.
MAX_REQUEUE = 1
STUCK_SECONDS = 300


def known_urls(*relations: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [r.select("url") for r in relations]).distinct()


def admit(
    candidates: DataFrame,
    urls: DataFrame,
    queue: DataFrame,
    in_flight: DataFrame,
    patterns: Sequence[str] = (),
    max_depth: int = 3,
    cap: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``candidates(seq, url, depth)`` with ``verdict``, in order of ``seq``.

    Tests in order: invalid_url, excluded, boundary, queue_full, duplicate,
    enqueued. A candidate is new when its URL is unknown and it is the first of
    the batch. With a ``cap`` the queue is full for all rows after the free places
    are used up, a running count over ``seq`` split into ordered buckets.
    """
    early = (
        F.when(U.invalid_reason("url").isNotNull(), "invalid_url")
        .when(is_excluded("url", patterns), "excluded")
        .when(F.col("depth") >= max_depth, "boundary")
    )
    judged = candidates.withColumn("_early", early)
    first = (
        judged.where("_early IS NULL")
        .groupBy("url")
        .agg(F.min("seq").alias("seq"))
        .join(known_urls(urls, queue, in_flight), "url", "left_anti")
        .select("seq", F.lit(1).alias("_new"))
    )
    flagged = judged.join(first, "seq", "left").withColumn("_new", F.coalesce("_new", F.lit(0)))
    late = F.when(F.col("_new") == 0, "duplicate").otherwise("enqueued")
    if cap is None:
        return flagged.withColumn("verdict", F.coalesce("_early", late)).drop("_early", "_new")
    size = queue.agg(F.count(F.lit(1))).scalar()
    # Bucket totals need the new rows and the list of buckets, not the joined candidates.
    sparse = first.unionByName(candidates.select("seq", F.lit(0).alias("_new")))
    counted = running_sum(
        flagged, F.col("_new").cast("bigint"), ["seq"], id_bucket("seq", bucket_rows), "_before", include_current=False, totals_of=sparse
    ).withColumn("_free", F.lit(cap) - size)
    late = F.when(F.col("_before") >= F.col("_free"), "queue_full").otherwise(late)
    return counted.withColumn("verdict", F.coalesce("_early", late)).drop("_early", "_new", "_before", "_free")


# The drop reason of a verdict; links beyond the depth limit are kept for later, and so are no drops.
VERDICT_REASONS = {"invalid_url": "invalid_url", "excluded": "exclude_pattern", "queue_full": "queue_full", "duplicate": "already_visited"}


def admission_reason(verdict: Column) -> Column:
    """The drop reason of a verdict of ``admit``; NULL when the link was queued or lies beyond the depth limit."""
    reason = F.lit(None).cast("string")
    for name, dropped in VERDICT_REASONS.items():
        reason = F.when(verdict == name, dropped).otherwise(reason)
    return reason


def discover(**channels: DataFrame) -> DataFrame:
    """One row per URL over all channels of ``(url, depth)``: least depth and the channels."""
    tagged = [df.select("url", "depth", F.lit(name).alias("channel")) for name, df in channels.items()]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("url")
        .agg(F.min("depth").alias("depth"), F.array_sort(F.collect_set("channel")).alias("channels"))
    )


def round_robin(queue: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Queue rows with their ``turn``: domains alternate by name, inside a domain by depth, then id.

    Crawl order is (turn, domain). A domain with many rows is numbered in
    buckets of (depth, id), so it never meets in one task.
    """
    bucket = F.struct("depth", id_bucket("id", bucket_rows))
    return numbered(queue, ["depth", "id"], bucket, "turn", ["domain"])


def politeness(
    df: DataFrame, delay_us: int, mode: str = "as_run", bucket_us: int = 3_600_000_000, key: str = "domain"
) -> DataFrame:
    """Requests ``(key, event_id, us)`` with ``slot_us``, the earliest fetch time.

    ``as_run``: the time of the request, or the one before plus the delay.
    ``strict``: requests of a domain are ``delay_us`` apart, whatever the burst:
    with row number n, the running maximum of ``us - n*delay`` plus ``n*delay``.
    Each domain is cut into time buckets; a bucket needs only one carried value
    from the buckets before it.
    """
    marked = df.withColumn("_bucket", F.floor(F.col("us") / bucket_us).cast("bigint"))
    inside = Window.partitionBy(key, "_bucket").orderBy("us", "event_id")
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    if mode == "as_run":
        last = marked.groupBy(key, "_bucket").agg(F.max("us").alias("_last"))
        carried = last.select(key, "_bucket", F.max("_last").over(before).alias("_carry"))
        joined = marked.join(carried, [key, "_bucket"])
        previous = F.coalesce(F.lag("us").over(inside), F.col("_carry"))
        out = joined.withColumn("slot_us", F.greatest(F.col("us"), F.coalesce(previous + delay_us, F.col("us"))))
        return out.drop("_bucket", "_carry")
    rows = numbered(df, ["us", "event_id"], F.floor(F.col("us") / bucket_us).cast("bigint"), "_n", [key])
    slack = rows.withColumn("_bucket", F.floor(F.col("us") / bucket_us).cast("bigint")).withColumn(
        "_slack", F.col("us") - F.col("_n") * delay_us
    )
    most = slack.groupBy(key, "_bucket").agg(F.max("_slack").alias("_most"))
    carried = most.select(key, "_bucket", F.max("_most").over(before).alias("_carry"))
    running = F.max("_slack").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        slack.join(carried, [key, "_bucket"])
        .withColumn("slot_us", F.greatest(running, F.coalesce("_carry", running)) + F.col("_n") * delay_us)
        .drop("_bucket", "_carry", "_slack", "_n")
    )


def domain_cap(queue: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows per domain. Spark applies the limit per task before the shuffle."""
    order = Window.partitionBy("domain").orderBy("depth", "id")
    return queue.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def promote(boundary: DataFrame, new_depth: int) -> tuple[DataFrame, DataFrame]:
    """URLs that fit under a larger depth limit, and the edges that remain."""
    fits = F.col("parent_depth") + 1 < new_depth
    promoted = boundary.where(fits).groupBy(F.col("child_url").alias("url")).agg((F.min("parent_depth") + 1).alias("depth"))
    return promoted, boundary.where(~fits)


def lost_children(boundary: DataFrame, urls: DataFrame, queue: DataFrame, in_flight: DataFrame, depth: int) -> DataFrame:
    """Children at a parent depth that no relation knows."""
    children = boundary.where(F.col("parent_depth") == depth).select(F.col("child_url").alias("url")).distinct()
    for relation in (urls, queue, in_flight):
        children = children.join(relation.select("url"), "url", "left_anti")
    return children


def depth_trim(queue: DataFrame, failures: DataFrame, boundary: DataFrame, limit: int):
    """(queue, failures, boundary) under a smaller depth limit."""
    beyond = queue.where(F.col("depth") >= limit)
    moved = beyond.where("depth > 0").select(
        F.lit("").alias("parent_url"), F.col("url").alias("child_url"), (F.col("depth") - 1).alias("parent_depth")
    )
    # The pair is the key; an edge that is already stored keeps its depth.
    stored = boundary.select("parent_url", "child_url").distinct()
    added = moved.dropDuplicates(["parent_url", "child_url"]).join(stored, ["parent_url", "child_url"], "left_anti")
    return (
        queue.where(F.col("depth") < limit),
        failures.where(F.col("depth") < limit),
        boundary.unionByName(added.select("parent_url", "child_url", "parent_depth")),
    )


def recover(in_flight: DataFrame, urls: DataFrame, queue: DataFrame) -> DataFrame:
    """In-flight URLs with ``action``: skipped when completed, queued when waiting already, else recovered."""
    done = urls.where("status = 'completed'").select("url", F.lit(True).alias("_done"))
    waiting = queue.select("url", F.lit(True).alias("_waiting"))
    action = F.when(F.col("_done"), "skipped").when(F.col("_waiting"), "queued").otherwise("recovered")
    return (
        in_flight.join(done, "url", "left").join(waiting, "url", "left").withColumn("action", action).drop("_done", "_waiting")
    )


def retry_reclaim(
    failures: DataFrame, queue: DataFrame, in_flight: DataFrame, urls: DataFrame, max_requeue: int = MAX_REQUEUE, n: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """The failed URLs to queue again (with ``n`` the next ones only), and the failures with their counters raised."""
    ready = failures.where(F.col("requeue_count") < max_requeue)
    for known in (queue, in_flight, urls.where("status = 'completed'")):
        ready = ready.join(known.select("url"), "url", "left_anti")
    taken = (ready if n is None else ready.orderBy("depth", "url").limit(n)).select("url", "depth")
    raised = failures.join(taken.select("url", F.lit(1).alias("_up")), "url", "left").withColumn(
        "requeue_count", F.col("requeue_count") + F.coalesce("_up", F.lit(0))
    )
    return taken.withColumn("domain", U.domain_of("url")), raised.drop("_up")


def apply_attempts(failures: DataFrame, attempts: DataFrame, max_requeue: int = MAX_REQUEUE) -> DataFrame:
    """Ledger after ``attempts(url, kind)``; kind is success, error, infra or shutdown.

    Any success removes the failure. Errors are counted up to the limit, then
    the failure is permanent; infrastructure errors are free; a shutdown makes
    it permanent.
    """
    totals = attempts.groupBy("url").agg(
        F.count_if(F.col("kind") == "success").alias("_ok"),
        F.count_if(F.col("kind") == "error").alias("_errors"),
        F.count_if(F.col("kind") == "shutdown").alias("_stops"),
    )
    merged = failures.select("url", "requeue_count").join(totals, "url", "full_outer").na.fill(
        0, ["requeue_count", "_ok", "_errors", "_stops"]
    )
    count = F.when(F.col("_stops") > 0, max_requeue).otherwise(
        F.least(F.lit(max_requeue), F.col("requeue_count") + F.col("_errors"))
    )
    touched = (F.col("_errors") > 0) | (F.col("_stops") > 0)
    stored = failures.select("url", F.lit(True).alias("_stored"))
    return (
        merged.join(stored, "url", "left")
        .where((F.col("_ok") == 0) & (F.coalesce("_stored", F.lit(False)) | touched))
        .select("url", count.cast("int").alias("requeue_count"), (count >= max_requeue).alias("permanent"))
    )


def requeued(attempts: DataFrame, urls: DataFrame, queue: DataFrame) -> DataFrame:
    """Queue rows ``(id, url, depth, domain)`` of ``attempts(id, url, depth, kind)`` that infrastructure errors ended.

    They are free: no failure is counted, and a request in flight does not keep
    them out. A URL that succeeded, is known or waits already does not come
    back; of several attempts the first gives place and depth, so rows keep the
    order of the attempts.
    """
    totals = attempts.groupBy("url").agg(
        F.count_if(F.col("kind") == "success").alias("_ok"), F.min(F.when(F.col("kind") == "infra", F.struct("id", "depth"))).alias("_first")
    )
    back = totals.where("_ok = 0 AND _first IS NOT NULL").select("_first.id", "url", "_first.depth")
    for known in (urls, queue):
        back = back.join(known.select("url"), "url", "left_anti")
    return back.select("id", "url", "depth", U.domain_of("url").alias("domain"))


def fix_orphans(queue: DataFrame) -> DataFrame:
    """Queue rows with domains filled from the URL; ``removed`` marks those that stay without one."""
    domain = F.when(F.coalesce("domain", F.lit("")) != "", F.col("domain")).otherwise(U.domain_of("url"))
    return queue.withColumn("domain", domain).withColumn("removed", F.coalesce("domain", F.lit("")) == "")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Least depth of each URL reached from the seeds, and the edges that stop at the limit.

    URLs of depth 0 .. max_depth-1 are visited; links found at the last depth
    are boundary edges. One join per level, lineage cut by reliable checkpoints; the
    links of a page with very many are split.
    """
    hot = cut_lineage(hot_keys(edges, "src_url"))
    reached = cut_lineage(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    level = reached
    for depth in range(1, max_depth):
        sources = level.select(F.col("url").alias("src_url"))
        targets = salted_join(edges, sources, "src_url", F.col("dst_url"), "left_semi", hot).select(F.col("dst_url").alias("url"))
        level = cut_lineage(
            targets.distinct().join(reached.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))
        )
        if level.isEmpty():
            break
        reached = reached.union(level)
    last = reached.where(F.col("depth") == max_depth - 1).select(F.col("url").alias("src_url"))
    boundary = salted_join(edges, last, "src_url", F.col("dst_url"), "left_semi", hot).select(
        F.col("src_url").alias("parent_url"), F.col("dst_url").alias("child_url"), F.lit(max_depth - 1).alias("parent_depth")
    )
    return reached, boundary.distinct()


def budget(df: DataFrame, max_pages: int = 0, until_us: int | None = None) -> DataFrame:
    """Rows ``(event_id, us, success)`` handled before a page or time budget is used up.

    Successes are counted along ranges of equal size, so a busy hour is no task
    of its own.
    """
    kept = df if until_us is None else df.where(F.col("us") < until_us)
    if not max_pages:
        return kept
    order = ["us", "event_id"]
    laid = in_ranges(kept, order)
    counted = running_sum(laid, F.col("success").cast("bigint"), order, F.col("_part"), "_done", include_current=False)
    return counted.where(F.col("_done") < max_pages).drop("_done", "_at", "_part")


def complete(urls: DataFrame, failures: DataFrame, in_flight: DataFrame, done: DataFrame):
    """(urls, failures, in_flight) after ``done(url, original_url, depth, ts, outcome)``."""
    news = done.select("url", F.struct("depth", "ts", "outcome").alias("_d"))
    merged = urls.join(news, "url", "full_outer").select(
        "url",
        F.coalesce("_d.depth", "depth").alias("depth"),
        F.when(F.col("_d").isNotNull(), "completed").otherwise(F.col("status")).alias("status"),
        F.coalesce("added_time", "_d.ts").alias("added_time"),
        F.coalesce("_d.ts", "completed_time").alias("completed_time"),
        F.coalesce("_d.outcome", "outcome").alias("outcome"),
    )
    settled = done.select(F.explode(F.array("url", F.coalesce("original_url", "url"))).alias("url")).distinct()
    return merged, failures.join(settled, "url", "left_anti"), in_flight.join(settled, "url", "left_anti")


def merge_legacy(visited: DataFrame, completed: DataFrame) -> DataFrame:
    """One ledger from the two old tables; a completed URL stays completed."""
    v = visited.select("url", "depth", "added_time", F.lit(True).alias("_v"))
    c = completed.select("url", "completed_time", F.lit(True).alias("_c"))
    joined = v.join(c, "url", "full_outer")
    # A URL of both tables keeps its visited row, which has no completion time.
    return joined.select(
        "url",
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.when(F.col("_c"), "completed").otherwise("visited").alias("status"),
        "added_time",
        F.when(F.col("_v").isNull(), F.col("completed_time")).alias("completed_time"),
    )


def stale(in_flight: DataFrame, now_us: int, seconds: int = STUCK_SECONDS) -> DataFrame:
    """In-flight rows ``(url, us)`` older than ``seconds``, with their age."""
    age = (F.lit(now_us) - F.col("us")) / 1_000_000
    return in_flight.withColumn("age_s", age).where(F.col("age_s") > seconds)


def queue_page(queue: DataFrame, n: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The next ``n`` queue rows in crawl order; ranges behind row ``n`` are never sorted again."""
    order = ["turn", "domain"]
    return ordered_take(in_ranges(round_robin(queue, bucket_rows), order), n, order, F.col("_part")).drop("_at", "_part")
