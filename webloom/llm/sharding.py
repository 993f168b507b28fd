"""Shards of equal row counts that keep linked documents together, by label propagation under quotas.

Documents are linked when they share a link key. Linked documents start in a
shard by hash. A link asks for the shards that hold most of its documents, one
for each quota of rows that it has, and brings all its documents along: a claim
is taken whole or not at all. A shard takes large links first, also in place of
smaller ones that it took before. Who finds no place asks again in the next
round: a join to where its documents lie gives the shards of its neighbours, and
of those that have room for a claim of its size, beside claims as large or
larger, it asks the one with most of its documents; chance decides between equal
ones, and between all shards with room only where no neighbour's has any. Rounds
end when no claim can be placed any more or the pairs held together stop
growing. Claims left over are laid over the free places in order, which cuts one
per shard at most, and the documents without links fill what is left, so row
counts differ by one at most. Rounds work on a row per claim; only narrow rows
move.

Defined results: null ids, null texts (size 16, checksum of the empty text,
linked with nothing) and repeated rows are documents like all others. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.ranking import running_sum
from webloom.session import stored

SHARDS = 40
# Rounds without growth before the best one is taken.
PATIENCE = 2
# A link with more than one of so many rows is broadcast, not shuffled: there are fewer such links than this.
HOT_SHARE = 1000
# Rows that one task puts in order.
ROWS_PER_BUCKET = 50_000


def part_of(column: str, rows: int) -> Column:
    """Number of the part of an evenly spread 64-bit column; parts have about ROWS_PER_BUCKET of ``rows`` rows."""
    return F.shiftright(column, 64 - max(1, (rows // ROWS_PER_BUCKET).bit_length())).cast("bigint")


def places(df: DataFrame, keys: tuple[str, ...], rows: int) -> DataFrame:
    """``_place`` from 0 per key, in the order of the unique hash ``spot``."""
    return running_sum(df, F.lit(1).cast("bigint"), ["spot"], part_of("spot", rows), "_place", keys, include_current=False)


def quota(shard: Column, rows: int, shards: int) -> Column:
    return F.lit(rows // shards) + (shard < rows % shards).cast("int")


def claims_of(near: DataFrame, rows: int, shards: int) -> DataFrame:
    """Claims (link, piece, n, shard) of ``near`` (link, shard, here): a quota of rows each and the rest, largest groups first."""
    most = max(1, rows // shards)
    sizes = near.groupBy("link").agg(F.sum("here").alias("all")).where("all > 1")
    pieces = sizes.select("link", "all", F.explode(F.sequence(F.lit(0), F.ceil(F.col("all") / most).cast("int") - 1)).alias("piece"))
    pieces = pieces.select("link", "piece", F.least(F.lit(most), F.col("all") - F.col("piece") * most).cast("bigint").alias("n"))
    # A link has a row per shard at most.
    ranked = Window.partitionBy("link").orderBy(F.desc("here"), F.xxhash64("link", "shard"), "shard")
    wishes = near.withColumn("piece", F.row_number().over(ranked) - 1).select("link", "piece", "shard")
    return pieces.join(wishes, ["link", "piece"], "left")


def one_round(claims: DataFrame, rows: int, shards: int) -> DataFrame:
    """``claims`` (link, piece, n, shard, held) with null for the shard of those that it does not take."""
    level, at = F.floor(F.log2(F.col("n").cast("double"))).cast("bigint"), F.xxhash64("link", "piece")
    asking = claims.where("shard IS NOT NULL").withColumns({"_order": -2 * level - F.col("held").cast("int"), "_at": at})
    bucket = F.col("_order") * (1 << 20) + F.shiftright("_at", 44)
    asked = running_sum(asking, F.col("n"), ["_order", "_at", "link", "piece"], bucket, "_before", ("shard",), include_current=False)
    taken = F.col("_before") + F.col("n") <= quota(F.col("shard"), rows, shards)
    columns = ["link", "piece", "n"]
    judged = asked.select(*columns, F.when(taken, F.col("shard")).alias("shard"))
    return stored(judged.union(claims.where("shard IS NULL").select(*columns, "shard")), "claims")


def asked_again(claims: DataFrame, near: DataFrame, rows: int, shards: int, number: int) -> DataFrame:
    """Claims without a shard ask a neighbours' shard that has room beside claims of their size and more, or else any such shard.

    ``near`` (link, shard, here): where the documents of links without a place lie.
    """
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    held = claims.where("shard IS NOT NULL").groupBy("shard", level.alias("level")).agg(F.sum("n").alias("n")).collect()  # sums per shard and size class
    top = max(rows, 2).bit_length()
    room = [[rows // shards + (s < rows % shards) for s in range(shards)] for _ in range(top)]
    for r in held:
        for k in range(r["level"] + 1):
            room[k][r["shard"]] -= r["n"]
    rooms = claims.sparkSession.createDataFrame([(k, [(s, n) for s, n in enumerate(room[k]) if n >= 1 << k]) for k in range(top)], "_level int, rooms array<struct<s: int, free: bigint>>")

    def chance(shard, weight):
        """Least for one of several shards, with a likelihood that grows with its weight."""
        even = (F.pmod(F.xxhash64("link", "piece", shard, F.lit(number)), F.lit(1 << 40)) + 0.5) / (1 << 40)
        return -F.ln(even) / weight

    waiting = claims.where("shard IS NULL").select("link", "piece", "n", level.alias("_level")).join(F.broadcast(rooms), "_level")
    waiting = waiting.withColumn("rooms", F.filter("rooms", lambda r: r["free"] >= F.col("n")))
    neighbours = near.select("link", F.col("shard").alias("_there"), "here")
    # A link has a row per shard at most, and a claim one wish.
    beside = waiting.join(neighbours, "link").where(F.exists("rooms", lambda r: r["s"] == F.col("_there")))
    nearest = beside.groupBy("link", "piece").agg(F.min(F.struct((-F.col("here")).alias("h"), chance(F.col("_there"), F.lit(1.0)).alias("c"), "_there"))["_there"].alias("_near"))
    drawn = F.array_min(F.transform("rooms", lambda r: F.struct(chance(r["s"], r["free"]).alias("k"), r["s"].alias("s"))))["s"]
    wishing = waiting.join(nearest, ["link", "piece"], "left").select("link", "piece", "n", F.coalesce("_near", drawn).alias("shard"), F.lit(False).alias("held"))
    return claims.where("shard IS NOT NULL").select("link", "piece", "n", "shard", F.lit(True).alias("held")).union(wishing)


def together(claims: DataFrame) -> int:
    """Pairs of neighbours that share a shard by the claims taken."""
    squares = claims.where("shard IS NOT NULL").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("n")))
    return int(squares.first()[0] or 0)


def laid(claims: DataFrame, rows: int, shards: int) -> DataFrame:
    """Parts (link, piece, shard, first, n): claims without a shard, largest first, over the free places; ``first`` counts within the claim."""
    free = sorted(((-r["free"], r["shard"]) for r in room(claims, rows, shards).collect()))  # one number per shard
    ends = [-sum(f for f, _ in free[: k + 1]) for k in range(shards)]
    places = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(e + f).cast("bigint").alias("a"), F.lit(e).cast("bigint").alias("b")) for (f, s), e in zip(free, ends, strict=True)])
    left = claims.where("shard IS NULL").withColumns({"_order": -F.floor(F.log2(F.col("n").cast("double"))).cast("bigint"), "_at": F.xxhash64("link", "piece")})
    bucket = F.col("_order") * (1 << 20) + F.shiftright("_at", 44)
    row = running_sum(left, F.col("n"), ["_order", "_at", "link", "piece"], bucket, "_from", (), include_current=False)
    met = F.filter(places, lambda p: (p["a"] < F.col("_from") + F.col("n")) & (p["b"] > F.col("_from")))
    cut = row.select("link", "piece", "n", "_from", F.explode(met).alias("p"))
    first = F.greatest(F.col("p.a") - F.col("_from"), F.lit(0))
    parts = cut.select("link", "piece", "p.shard", first.alias("first"), (F.least(F.col("p.b") - F.col("_from"), F.col("n")) - first).alias("n"))
    return claims.where("shard IS NOT NULL").select("link", "piece", "shard", F.lit(0).cast("bigint").alias("first"), "n").union(parts)


def room(claims: DataFrame, rows: int, shards: int) -> DataFrame:
    """Free places of every shard beside rows (shard, n)."""
    all_shards = claims.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    held = claims.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("n").alias("held"))
    return all_shards.join(held, "shard", "left").select("shard", (quota(F.col("shard"), rows, shards) - F.coalesce("held", F.lit(0))).alias("free"))


def propagate(near: DataFrame, rows: int, shards: int) -> DataFrame:
    """Parts of links (link, piece, shard, first, n) that fill no shard beyond its quota."""
    best = state = one_round(claims_of(near, rows, shards).withColumn("held", F.lit(False)), rows, shards)
    most, number, idle = together(state), 0, 0
    while idle < PATIENCE:
        number += 1
        asking = stored(asked_again(state, near, rows, shards, number), "asking")
        if asking.where("NOT held AND shard IS NOT NULL").isEmpty():
            break
        state = one_round(asking, rows, shards)
        now = together(state)
        idle = 0 if now > most else idle + 1
        if now > most:
            best, most = state, now
    return laid(best, rows, shards)


def dealt_by_link(linked: DataFrame, parts: DataFrame, rows: int, shards: int) -> DataFrame:
    """Shards (spot, shard) of documents (spot, link) by the stored ``parts`` of their links."""
    most = max(1, rows // shards)
    # Links in several parts: at most two per shard. With them, links too large for a shuffle by link. All others go whole.
    several = parts.groupBy("link").agg(F.count(F.lit(1)).alias("_parts"), F.sum("n").alias("_all")).where(f"_parts > 1 OR _all * {HOT_SHARE} > {rows}")
    several = stored(several.select("link"), "several")
    spans = parts.join(F.broadcast(several), "link", "left_semi").select("link", "shard", (F.col("piece") * most + F.col("first")).alias("_a"), "n")
    numbered = places(linked.join(F.broadcast(several), "link", "left_semi"), ("link",), rows)
    inside = (F.col("_place") >= F.col("_a")) & (F.col("_place") < F.col("_a") + F.col("n"))
    cut = numbered.join(F.broadcast(spans), "link").where(inside).select("spot", "shard")
    whole = parts.join(F.broadcast(several), "link", "left_anti").select("link", "shard")
    rest = linked.join(F.broadcast(several), "link", "left_anti")
    return rest.join(whole, "link").select("spot", "shard").union(cut)


def sharded(narrow: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``narrow`` (link may be null, and any other columns but spot, shard, slot) with ``shard`` and ``slot``."""
    # The row's number is written first and so stays the same for all that reads it.
    base = stored(narrow.withColumn("spot", F.xxhash64(F.monotonically_increasing_id())), "narrow")
    rows = base.count()
    linked = base.where("link IS NOT NULL").select("spot", "link")
    start = F.pmod(F.xxhash64("spot"), F.lit(shards)).cast("int")
    near = stored(linked.groupBy("link", start.alias("shard")).agg(F.count(F.lit(1)).alias("here")), "near")
    parts = stored(propagate(near, rows, shards), "parts")
    placed = stored(dealt_by_link(linked, parts, rows, shards), "placed")
    left = [row["free"] for row in room(parts, rows, shards).orderBy("shard").collect()]  # one number per shard
    ends = [sum(left[: i + 1]) for i in range(shards)]
    fillers = base.select("spot").join(placed.select("spot"), "spot", "left_anti")
    spread = places(fillers, (), rows)
    passed = F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e <= F.col("_place"))
    filled = spread.select("spot", F.size(passed).cast("int").alias("shard"))
    dealt = stored(placed.union(filled), "dealt")
    slotted = places(dealt, ("shard",), rows).withColumnRenamed("_place", "slot")
    return base.join(slotted, "spot").drop("spot")


def by_equal_text(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents (doc_id, text) dealt to shards, equal texts linked: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5("text")).alias("link"),
    )
    return sharded(narrow, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
