"""Documents that contain a test item, by size-partitioned MinHash containment search.

Sets are shingles of ``WIDTH`` words in lower case; an item with fewer words is
one shingle of them all. Items are partitioned by the size of their set, each
partition with twice the sizes of the one before. A partition keeps of every
item the least k hashes, where k is one more than an item of its largest size
may lack at the threshold. A document that contains enough of an item must
hold one of these hashes, so the search finds every such document however long
it is, and looks up each shingle of a document once. Candidates are verified on
the shingles themselves.

Everything is in built-in functions. Sketches and the keys of candidates are
written, and broadcast only when they are few; beyond that they are shuffled. Texts are told apart by a 128-bit
checksum, so a text with many copies is verified once.

Defined results: null texts and items, and those without words, contain
nothing and match nothing. A null id or a repeated one stays as it is. Several
items of one id are one item of which the best match counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.sizes import small
from webloom.session import stored

WIDTH = 5
NUM, DEN = 80, 100
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORD), F.lit(0))


def windows(list_name: str, width: int, hashed: bool) -> Column:
    """All runs of ``width`` words, as hashes or as text; none if there are fewer words."""
    w = F.col(list_name)
    begin = F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))
    run = lambda i: [F.get(w, i + j) for j in range(width)]
    return F.transform(begin, lambda i: F.xxhash64(*run(i)) if hashed else F.concat_ws(" ", *run(i)))


def item_shingles(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_key, item_id, width, shingles, hashes, n, lacking): lacking is how many shingles a match may miss."""
    w = benchmark.select("item_id", F.col("text").cast("string").alias("text")).withColumn("w", words("text")).where(F.size("w") > 0)
    whole = w.select("item_id", "w", F.least(F.size("w"), F.lit(width)).alias("width"))
    cases = F.lit(None)
    hashes = F.lit(None)
    for k in range(1, width + 1):
        cases = F.when(F.col("width") == k, F.array_distinct(windows("w", k, False))).otherwise(cases)
        hashes = F.when(F.col("width") == k, F.array_distinct(windows("w", k, True))).otherwise(hashes)
    made = whole.select("item_id", "width", cases.alias("shingles"), hashes.alias("hashes"))
    n = F.size("shingles")
    return made.withColumn("n", n).withColumn("item_key", F.md5(F.concat_ws("\n", F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.concat_ws("\n", "shingles"))))


def sketches(items: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(hash, item_key): the least hashes of each item, as many as its size partition asks for."""
    largest = F.call_function("shiftleft", F.lit(2).cast("bigint"), F.floor(F.log2(F.col("n").cast("double"))).cast("int")) - 1
    # An item of size m may lack floor(m * (den - num) / den) shingles.
    k = (F.floor(largest * (den - num) / den) + 1).cast("int")
    least = F.slice(F.array_sort("hashes"), 1, F.least(k, F.size("hashes")))
    return items.select(F.explode(least).alias("hash"), "item_key").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(text_key, item_id, n_item_shingles, n_shared) of every distinct text that contains an item."""
    items = stored(item_shingles(benchmark, width), "items")
    widths = sorted(r[0] for r in items.select("width").distinct().collect())  # at most ``width`` numbers
    index = stored(sketches(items, num, den), "item_sketches")
    keyed = docs.select(F.md5(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    hashed = keyed.select("text_key", words("text").alias("w"))
    every = F.concat(*[windows("w", k, True) for k in widths]) if widths else F.array().cast("array<bigint>")
    looked_up = hashed.select("text_key", F.explode(every).alias("hash")).join(index, "hash")
    candidates = stored(looked_up.select("text_key", "item_key").distinct(), "candidates")
    # Verification on the shingles, for the texts that have a candidate.
    asked = stored(candidates.select("text_key").distinct(), "candidate_texts")
    once = keyed.join(small(asked), "text_key", "left_semi").dropDuplicates(["text_key"]).withColumn("w", words("text"))
    found = once.select("text_key", *[F.array_distinct(windows("w", k, False)).alias(f"s{k}") for k in widths])
    pairs = candidates.join(items.select("item_key", "item_id", "width", "shingles", "n"), "item_key").join(found, "text_key")
    shared = F.lit(0)
    for k in widths:
        shared = F.when(F.col("width") == k, F.size(F.array_intersect("shingles", f"s{k}"))).otherwise(shared)
    judged = pairs.select("text_key", "item_id", "n", shared.alias("shared")).where(F.col("shared") * den >= F.col("n") * num)
    best = F.max(F.struct((F.col("shared") / F.col("n")).alias("r"), "n", "shared")).alias("b")
    return stored(judged.groupBy("text_key", "item_id").agg(best).select("text_key", "item_id", F.col("b.n").cast("bigint").alias("n_item_shingles"), F.col("b.shared").cast("bigint").alias("n_shared")), "contaminated")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): each document and item it contains."""
    hits = contaminated(docs, benchmark)
    keyed = docs.select("doc_id", F.md5(F.col("text").cast("string")).alias("text_key"))
    return keyed.join(small(hits), "text_key").drop("text_key").distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item."""
    hits = stored(contaminated(docs, benchmark).select(F.col("text_key").alias("_hit")).distinct(), "hits")
    return docs.join(small(hits), F.md5(docs["text"].cast("string")) == F.col("_hit"), "left_anti")
