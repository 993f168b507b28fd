"""Mixing of sources by a curriculum: weights change over the training time.

Each source has a weight schedule, linear over the training time 0 to 1. Its
integral is the source's demand; the inverse of the cumulative demand gives the
time at which a document's words are due, and the documents are range-sorted by
that time. Sources are read in a fixed order of hashes, whole documents, again
from the start when the demand exceeds the source.

Defined results: a null source is a source of its own, after all others; null
and empty texts have size 0 and are never taken; repeated rows are documents of
their own, and rows with the same id, source and size may stand for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.operators.ranking import running_sum
from webloom.session import stored

WORD = r"[^\x20\x09-\x0D]+"
# Weights and (start, end) of the weight schedules, repeating along the sources in code point order.
WEIGHTS = (3.0, 1.0, 2.0)
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
# Rows of one source that one task sorts, at most and about; there are 256 buckets at least.
ROWS_PER_BUCKET = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """``sizes`` (source, source_size), a row per source, with ``sid``, target, start and end weight.

    All sources together get ``share`` times all sizes, by weight; none gets
    more than ``most`` times its own size, what is over goes to the others.
    In the order of cap / weight the capped sources come first, so one pass of
    running sums finds the common level of all others.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(order) - 1).withColumn("sid", F.col("sid").cast("int"))
    turn = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("sid") % len(values) + 1).cast("int"))
    ranked = (
        ranked.withColumn("weight", turn(weights))
        .withColumn("start", turn([a for a, _ in schedules]))
        .withColumn("end", turn([b for _, b in schedules]))
        .withColumn("cap", F.col("source_size") * F.lit(most))
    )
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("_level", level).withColumn("_open", F.col("cap") / F.col("weight") >= F.col("_level"))
    # The first open source in rising order sets the level; behind it the sums leave out too much.
    common = F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(common, F.lit(0.0)))).drop("_level", "_open", "cap", "weight")


def due(words: Column) -> Column:
    """Training time 0 to 1 at which ``words`` of the source's target are due.

    The weight runs from ``start`` to ``end``; with their mean as 1 the demand
    up to time t is t + s (t^2 - t), where s = (end - start) / (end + start).
    """
    s = (F.col("end") - F.col("start")) / (F.col("end") + F.col("start"))
    y = words / F.col("target")
    root = F.sqrt((1 - s) * (1 - s) + 4 * s * y)
    return F.when(F.abs(s) < 1e-9, y).otherwise((root - (1 - s)) / (2 * s))


def curriculum(docs: DataFrame, **settings) -> DataFrame:
    """Documents (doc_id, text, source) with size, source_size, target, passes, taken, ``positions`` and a hash of the text.

    A pass takes the document if the middle of its words lies before the
    target, so a source's taken words differ from its target by half a document
    at most. ``positions`` are the training times of the passes.
    """
    narrow = stored(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.xxhash64("text").alias("text_hash"),
            F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("_order"),
        ),
        "sizes",
    )
    shares = stored(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), **settings), "targets")
    ready = narrow.withColumnRenamed("source", "_source").join(shares, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    digits = max(2, -(-(narrow.count() // ROWS_PER_BUCKET).bit_length() // 4))
    bucket = F.conv(F.substring("_order", 1, digits), 16, 10).cast("bigint")
    summed = running_sum(
        ready, F.col("size"), ["_order", "doc_id", "size"], bucket, "_before", ("sid",), include_current=False,
        totals_of=ready.select("sid", "size", "_order"),
    )
    middle = F.col("_before") + F.col("size") / 2
    starts = [middle + k * F.col("source_size") for k in (0, 1)]
    times = [F.when((F.col("size") > 0) & (words < F.col("target")), due(words)) for words in starts]
    return (
        summed.withColumn("positions", F.filter(F.array(*times), lambda t: t.isNotNull()))
        .withColumn("passes", F.size("positions"))
        .withColumn("taken", (F.col("passes") * F.col("size")).cast("bigint"))
        .drop("_before", "sid", "start", "end")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the time of its first pass; documents not taken come last."""
    first = F.try_element_at("positions", F.lit(1)).alias("_position")
    rows = curriculum(docs).select("doc_id", "size", "source_size", "target", "taken", "passes", first, "_order")
    return rows.orderBy(F.col("_position").asc_nulls_last(), "_order").withColumn("position", F.round("_position", 6)).drop("_order", "_position")


def training_order(docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, a row for each pass that takes it, range-sorted by training time.

    The times are found on narrow rows; texts are shuffled once to meet them and once to be sorted.
    """
    key = ["doc_id", "source", "text_hash"]
    passes = curriculum(docs.select("doc_id", "text", "source")).select(*[F.col(c).alias(f"_{c}") for c in key], "_order", F.explode("positions").alias("_position"))
    whole = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    once = whole.dropDuplicates(key)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return passes.join(once, same).orderBy("_position", "_order").select("_row.*")
