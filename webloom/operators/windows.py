"""Time windows per key. Bounded look-back frames run on (key, time bucket), so a
busy key is split over time; see ``ranking.with_lookback``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.ranking import checked_side, in_ranges, numbered, with_lookback
from webloom.session import stored

# Burst size and span; parts of the endpoint score; weights of the running mean.
BURST_FAILURES = 10
BURST_SECONDS = 60
FAILURE_WINDOW_S = 15.0
FAILURE_PENALTY = 0.15
MAX_LATENCY_PENALTY = 0.15
LATENCY_SCALE_MS = 2000.0
SUCCESS_BONUS = 0.15
SUCCESS_DECAY_S = 30.0
HALF_OPEN_BASE = 0.3
OLD_WEIGHT = 0.7
ROUTE_TTL_S = 3600
HASH_TTL_S = 86_400


def trailing_counts(df: DataFrame, key: str, span_us: int, name: str = "recent") -> DataFrame:
    """``df(key, us)`` with the number of rows of the key in the last ``span_us``, the start excluded.

    Every row counts +1 at its time and -1 when the span has passed: one
    running sum in each time bucket, whatever the number of rows in a span.
    """
    width = span_us * 4
    own, end = F.floor(F.col("us") / width).cast("bigint"), F.col("us") + span_us
    step = lambda bucket, at, value, is_own: F.struct(
        bucket.alias("_bucket"), at.alias("_at"), F.lit(value).alias("_step"), F.lit(is_own).alias("_own")
    )
    here = step(own, F.col("us"), 1, True)
    # A row that expires in the next bucket is counted from that bucket's start until then.
    later = [step(own + 1, (own + 1) * width, 1, False), step(own + 1, end, -1, False)]
    ends_here = F.floor(end / width).cast("bigint") == own
    steps = df.select("*", F.inline(F.when(ends_here, F.array(here, step(own, end, -1, False))).otherwise(F.array(here, *later))))
    frame = Window.partitionBy(key, "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return steps.withColumn(name, F.sum("_step").over(frame)).where("_own").drop("_bucket", "_at", "_step", "_own")


def bursts(df: DataFrame, key: str, n: int = BURST_FAILURES, seconds: int = BURST_SECONDS) -> DataFrame:
    """First time per key with more than ``n`` failures in ``seconds``; open from then on."""
    counted = trailing_counts(df, key, seconds * 1_000_000)
    return counted.where(F.col("recent") > n).groupBy(key).agg(F.min("us").alias("opened_us"))


def rate_audit(df: DataFrame, key: str, rpm: int) -> DataFrame:
    """Requests that are above ``rpm`` in the minute that ends with them."""
    return trailing_counts(df, key, 60_000_000).where(F.col("recent") > rpm)


def ewma(df: DataFrame, key: str, value: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """Running mean, 0.7 old + 0.3 new from 0, after the last row of ``(key, id, us, value)``.

    That is the sum of 0.3 * 0.7^r * value over the rows counted from the end,
    so it needs only a row number and a plain sum.
    """
    bucket = -F.floor(F.col("us") / bucket_us).cast("bigint")
    ranked = numbered(df, [F.desc("us"), F.desc("id")], bucket, "_r", [key])
    weight = (1 - OLD_WEIGHT) * F.pow(F.lit(OLD_WEIGHT), F.col("_r") - 1)
    return ranked.groupBy(key).agg(F.sum(weight * F.col(value)).alias("ewma"), F.count(F.lit(1)).alias("samples"))


def health_score(df: DataFrame, at_us: int, states: DataFrame | None = None) -> DataFrame:
    """Score 0 to 1 per endpoint at a time, from ``(endpoint, id, us, kind, latency_ms)``.

    ``states(endpoint, state)`` holds open and half_open endpoints; others are closed.
    """
    past = df.where(F.col("us") <= at_us)
    parts = past.groupBy("endpoint").agg(
        F.count_if((F.col("kind") == "failure") & (F.lit(at_us) - F.col("us") <= int(FAILURE_WINDOW_S * 1e6))).alias("recent"),
        F.max(F.when(F.col("kind") == "success", F.col("us"))).alias("last_success_us"),
    )
    latency = ewma(past.where("latency_ms IS NOT NULL"), "endpoint", "latency_ms").select("endpoint", "ewma")
    joined = parts.join(latency, "endpoint", "left")
    if states is None:
        joined = joined.withColumn("state", F.lit("closed"))
    else:
        joined = joined.join(states, "endpoint", "left").withColumn("state", F.coalesce("state", F.lit("closed")))
    base = F.when(F.col("state") == "half_open", HALF_OPEN_BASE).otherwise(1.0)
    after_failures = F.greatest(F.lit(0.0), base - F.col("recent") * FAILURE_PENALTY)
    # least() passes over NULL, so an endpoint without samples is asked for first.
    scaled = F.least(F.lit(MAX_LATENCY_PENALTY), F.col("ewma") / LATENCY_SCALE_MS * MAX_LATENCY_PENALTY)
    penalty = F.when(F.col("ewma").isNull(), 0.0).otherwise(scaled)
    since = (F.lit(at_us) - F.col("last_success_us")) / 1e6
    bonus = F.when(
        (F.col("state") == "closed") & since.isNotNull(),
        F.greatest(F.lit(0.0), SUCCESS_BONUS - since / SUCCESS_DECAY_S * SUCCESS_BONUS),
    ).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), after_failures - penalty + bonus))
    return joined.withColumn("score", F.when(F.col("state") == "open", 0.0).otherwise(score))


def route_asof(requests: DataFrame, memory: DataFrame, ttl_s: int = ROUTE_TTL_S) -> DataFrame:
    """``requests(domain, id, us)`` with the last remembered route, when it is younger than the TTL.

    Remembered routes reach the bucket of their own time and those the TTL
    covers; each bucket is then one small ordered scan.
    """
    ttl_us = ttl_s * 1_000_000
    asked = requests.select("domain", "us", F.lit(1).alias("_side"), "id", F.lit(None).cast("struct<us:bigint,route:string>").alias("_m"))
    known = memory.select("domain", "us", F.lit(0).alias("_side"), F.lit(None).cast("bigint").alias("id"), F.struct("us", "route").alias("_m"))
    width = ttl_us * 4
    known = with_lookback(known, "us", ttl_us, width).drop("_own")
    asked = asked.withColumn("_bucket", F.floor(F.col("us") / width).cast("bigint"))
    order = Window.partitionBy("domain", "_bucket").orderBy("us", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_m", ignorenulls=True).over(order)
    both = known.unionByName(asked).withColumn("_last", last).where("_side = 1")
    fresh = F.col("us") - F.col("_last.us") < ttl_us
    return both.select("domain", "id", "us", F.when(fresh, F.col("_last.route")).alias("route"))


def liveness(df: DataFrame, at_us: int, timeout_s: float) -> DataFrame:
    """Per worker of ``(worker, us)``: last heartbeat and whether it is alive at a time."""
    last = df.where(F.col("us") <= at_us).groupBy("worker").agg(F.max("us").alias("last_us"))
    return last.withColumn("alive", F.lit(at_us) - F.col("last_us") <= int(timeout_s * 1e6))


def liveness_summary(workers: DataFrame) -> DataFrame:
    return workers.agg(
        F.count_if("alive").alias("alive"),
        F.count_if(~F.col("alive")).alias("stale"),
        F.coalesce(F.bool_and(~F.col("alive")), F.lit(False)).alias("all_stale"),
    )


def successors(rows: DataFrame, after_us: int) -> DataFrame:
    """(hash, us, next_us): the first row of the hash more than ``after_us`` later, for rows ``(hash, us)`` that have one.

    Every row asks at its own time plus the span. Askers and rows are laid in
    one order and cut into ranges of equal size, so a hash that holds most rows
    lies in many tasks; within a range the next row is a running value from the
    end, and a range hands its first row to the ones before it.
    """
    marks = rows.select("hash", F.col("us").alias("at"), F.lit(False).alias("asks")).unionByName(
        rows.select("hash", (F.col("us") + after_us).alias("at"), F.lit(True).alias("asks"))
    )
    # At one moment rows come before askers: the next row must be later.
    laid = in_ranges(marks, ["hash", "at", "asks"])
    row = F.when(~F.col("asks"), F.struct("hash", "at"))
    from_end = Window.partitionBy("_part").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = laid.groupBy("_part").agg(F.min(F.when(~F.col("asks"), F.struct("_at", "hash", "at"))).alias("_first"))
    parts_from_end = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    handed = firsts.select("_part", F.last("_first", ignorenulls=True).over(parts_from_end).alias("_handed"))
    found = (
        laid.withColumn("_next", F.last(row, ignorenulls=True).over(from_end))
        .where("asks")
        # One row for each task of the job before.
        .join(F.broadcast(handed), "_part")
        .withColumn("_next", F.coalesce("_next", F.struct("_handed.hash", "_handed.at")))
    )
    return found.where(F.col("_next.hash") == F.col("hash")).select("hash", (F.col("at") - after_us).alias("us"), F.col("_next.at").alias("next_us"))


# Rows of a hash that are gone through in one row of its own.
FEW_SIGHTS = 1000


def ttl_dedup(df: DataFrame, ttl_s: int = HASH_TTL_S, few: int = FEW_SIGHTS) -> DataFrame:
    """Rows ``(hash, id, us)`` that are new: the entry of a hash expires ``ttl_s`` after it was first seen.

    A hash with up to ``few`` rows is gone through in order within one group, a
    single shuffle for most data; the rows of the others are kept by links
    (``kept_by_links``), which spread a hash over many tasks. Both give the same
    rows. Rows without hash or time are left out; a repeated row counts once, and
    of the rows of a moment the one with the least id stands.
    """
    after_us = ttl_s * 1_000_000
    rows = stored(df.where("hash IS NOT NULL AND us IS NOT NULL").groupBy("hash", "us").agg(F.min("id").alias("id")), "sights")
    busy = stored(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select("hash"), "busy")
    if busy.isEmpty():
        return kept_in_order(rows, after_us)
    busy = checked_side(busy)
    by_links = kept_by_links(stored(rows.join(busy, "hash", "left_semi"), "busy_rows"), after_us)
    return kept_in_order(rows.join(busy, "hash", "left_anti"), after_us).unionByName(by_links)


def kept_in_order(rows: DataFrame, after_us: int) -> DataFrame:
    """New rows of ``(hash, us, id)``, for hashes with a bounded number of rows."""
    sights = F.array_sort(F.collect_list(F.struct("us", "id")))
    first = F.struct(F.col("_sights")[0]["us"].alias("last"), F.slice("_sights", 1, 1).alias("kept"))

    def step(at, sight):
        return F.when(sight["us"] - at["last"] > after_us, F.struct(sight["us"].alias("last"), F.array_append(at["kept"], sight).alias("kept"))).otherwise(at)

    kept = F.aggregate("_sights", first, step)["kept"]
    return rows.groupBy("hash").agg(sights.alias("_sights")).select("hash", F.inline(kept)).select("hash", "id", "us")


def kept_by_links(rows: DataFrame, after_us: int) -> DataFrame:
    """New rows of stored rows ``(hash, us, id)``, of which a hash may hold most.

    Kept are the first row of a hash and what its links reach, each link leading
    to the first row after the TTL. The links are doubled, twice between two
    writes: round k adds the rows 4^k to 4^(k+1) - 1 links away, so a year of
    daily repeats takes five rounds. Joins are on (hash, us), which is unique, so
    a hash with most rows is spread.
    """
    reached = stored(rows.groupBy("hash").agg(F.min("us").alias("us")), "reached")
    links = stored(successors(rows, after_us), "links")
    # Only first rows and targets of links are ever stepped on.
    steps = reached.union(links.select("hash", F.col("next_us").alias("us"))).distinct()
    links = stored(links.join(steps, ["hash", "us"], "left_semi"), "links")

    def doubled(links: DataFrame) -> DataFrame:
        onward = links.select("hash", F.col("us").alias("next_us"), F.col("next_us").alias("_onward"))
        return links.join(onward, ["hash", "next_us"]).select("hash", "us", F.col("_onward").alias("next_us"))

    def stepped(at: DataFrame, by: DataFrame) -> DataFrame:
        return at.join(by, ["hash", "us"]).select("hash", F.col("next_us").alias("us"))

    while not links.isEmpty():
        twice = doubled(links)
        near = stepped(reached, links)
        reached = reached.union(stored(near.union(stepped(reached.union(near), twice)), "reached"))
        links = stored(doubled(twice), "links")
    return rows.join(reached, ["hash", "us"]).select("hash", "id", "us")
