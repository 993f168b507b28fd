"""Near copies of lines by character shingles: MinHash, high-recall bands, exact Jaccard, union-find.

A line's set holds its distinct runs of SHINGLE characters as 64-bit hashes; a
shorter line is one shingle. Signatures have BINS // BAND bands of BAND
coordinates: lines of similarity 0.8 share a band with a probability of about
0.999, more alike ones almost surely. Equal lines are one node before any pair
is made; candidates are verified exactly and grouped as in ``near``.

Everything is built-in functions, joins and aggregates; no Python runs in
tasks. It is over the check tool's CPU limit, see the README for figures.

Defined results: blank lines (no character beyond space and control characters)
belong to no class and stay; null texts have no lines. Of a class the first
line by document id (null ids last) and place is kept; rows that repeat id and
text are the same lines.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.near import in_pairs, linked_sets
from webloom.session import stored

SHINGLE = 10
BAND = 3
BINS = 32
NUM, DEN = 80, 100
# Bytes of a character in UTF-32, where the place of a character is known without a search.
WIDE = 4
# Shingles that one row holds: rows are few, and their code is small enough to be compiled.
ROW = 8
# What shingles are compared with for each coordinate.
_random = random.Random(37)
TARGETS = [[_random.getrandbits(64) - (1 << 63) for _ in range(BAND)] for _ in range(BINS // BAND)]
# Bits a place, of one row of the table of bits, and the power of two that bounds the table (32 MB).
BITS_A_PLACE, PAGE, MOST_BITS = 16, 4096 * 8, 28
# Words of 64 bits, a power of two, that tell most differences of lines apart.
WORDS = 8
# Nodes of a block of lines, of which tasks keep few: the larger, the fewer times a node of a large band goes through the join.
BLOCK_NODES = 2048
MARKS = [f"mark{k}" for k in range(WORDS)]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no, node, line) of every line that is not blank.

    ``mark`` tells texts under one id apart, ``node`` different lines.
    """
    text = F.col("text").cast("string")
    whole = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), text.alias("text"))
    cut = whole.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(r"[^\x00-\x20]"))
    return cut.select("doc_id", "mark", F.col("line_no").cast("long").alias("line_no"), F.unhex(F.md5("line")).alias("node"), "line")


def last_start(wide: Column) -> Column:
    """Where the last shingle of a line in UTF-32 begins, from 1."""
    return F.greatest(F.length(wide) - (WIDE * SHINGLE - 1), F.lit(1))


def shingle(wide: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(wide, start, F.lit(WIDE * SHINGLE)))


def shingle_set(line: str) -> Column:
    """The distinct hashed shingles of a line."""
    # The outer lambda holds the encoded line, which would be made anew for each shingle otherwise.
    made = F.transform(F.array(F.encode(line, "UTF-32")), lambda w: F.transform(F.sequence(F.lit(1), last_start(w), F.lit(WIDE)), lambda i: shingle(w, i)))
    return F.array_distinct(F.element_at(made, 1))


def signed(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The ``keys`` of rows (keys, line), n and bands: one row for each, with the size of the line's set and its signature.

    A coordinate is the least of its shingles' hashes, shifted by an own number of bits and compared with an own target bit
    by bit: the nearest to the target, which is any of a set with the same probability.
    """
    wide = lines.select(*keys, "line", F.encode("line", "UTF-32").alias("wide"))
    rows = wide.select(*keys, "line", "wide", last_start(F.col("wide")).alias("last"), F.explode(F.sequence(F.lit(1), last_start(F.col("wide")), F.lit(WIDE * ROW))).alias("at"))
    # Rows at the end repeat the last shingle.
    hashed = rows.select(*keys, "line", *(shingle(F.col("wide"), F.least(F.col("at") + WIDE * k, F.col("last"))).alias(f"h{k}") for k in range(ROW)))
    bands, count = range(BINS // BAND), BINS // BAND

    def coordinate(band: int, j: int) -> Column:
        shifted = [F.shiftleft(f"h{k}", band + count * j).bitwiseXOR(F.lit(TARGETS[band][j])) for k in range(ROW)]
        return F.min(F.least(*shifted)).alias(f"c{band}_{j}")

    met = hashed.groupBy(*keys).agg(F.max(F.size(shingle_set("line"))).cast("long").alias("n"), *(coordinate(b, j) for b in bands for j in range(BAND)))
    return met.select(*keys, "n", F.array(*(F.xxhash64(F.lit(b), *(f"c{b}_{j}" for j in range(BAND))) for b in bands)).alias("bands"))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no, node, n, bands) of every line."""
    return signed(keyed(docs), ["doc_id", "mark", "line_no", "node"])


def likely(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The ``rows`` that are among ``places`` (doc_id, mark, line_no, stored), and about one in BITS_A_PLACE of the others.

    The places set bits of a table that goes to every task. It is bounded by MOST_BITS; for more places than it is made
    for, more of the others stay.
    """
    count = places.count()
    bits = 1 << min(max((BITS_A_PLACE * count - 1).bit_length(), PAGE.bit_length() - 1), MOST_BITS)
    bit = F.pmod(F.xxhash64("doc_id", "mark", "line_no"), F.lit(bits))
    page, spot = F.floor(bit / PAGE).alias("_page"), (bit % PAGE).alias("_spot")
    table = places.select(page, spot).groupBy("_page").agg(F.bitmap_construct_agg("_spot").alias("_bits"))
    met = rows.select("*", page, spot).join(F.broadcast(table), "_page")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_spot") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.where(F.getbit(byte, (F.col("_spot") % 8).cast("int")) == 1).select(*rows.columns)


def lines_at(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(nid, members): the lines at the stored ``places`` (nid, own), once each.

    Few lines are asked for, so most others are left out before lines meet their places.
    """
    names = ("doc_id", "mark", "line_no")
    asked = places.select("nid", *(F.col(f"own.{c}").alias(f"_{c}") for c in names))
    rows = likely(keyed(docs).select(*names, "line"), places.select("own.*"))
    same = rows["doc_id"].eqNullSafe(asked["_doc_id"]) & (rows["mark"] == asked["_mark"]) & (rows["line_no"] == asked["_line_no"])
    # Rows that repeat id and text are the same lines.
    return rows.join(asked, same).select("nid", F.col("line").alias("members")).dropDuplicates(["nid"])


def compared(stars: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """As ``near.compared``, of lines, in built-in functions; differences are arrays."""
    sides = [sets.select(F.col("nid").alias(name), F.col("members").alias(s)) for name, s in (("center", "line_c"), ("nid", "line_x"))]
    rows = stars.join(sides[0], "center").join(sides[1], "nid")
    made = rows.select("center", "nid", shingle_set("line_c").alias("c"), shingle_set("line_x").alias("x"))
    apart = made.select("center", "nid", F.size("x").cast("long").alias("n"), F.size("c").cast("long").alias("center_n"), F.concat(F.array_except("c", "x"), F.array_except("x", "c")).alias("apart"))
    return apart.select("center", "nid", "n", "center_n", similar("n", "center_n", F.size("apart"), num, den).alias("linked"), "apart")


def similar(n: str, m: str, apart: Column, num: int, den: int) -> Column:
    """Whether sets of these sizes, that differ in so many members, are alike."""
    # ``apart`` stands here once: where it is costly, it is not made twice.
    return (num + den) * (F.col(n) + F.col(m) - apart) >= 2 * num * (F.col(n) + F.col(m))


def parity(values: str, word: int) -> Column:
    """64 bits: how often, modulo 2, the values with this ``word`` in bits 6 to 8 have each number (0 to 63) in the last six."""
    mine = F.filter(values, lambda x: x.bitwiseAND(F.lit(64 * (WORDS - 1))) == 64 * word)
    return F.aggregate(mine, F.lit(0).cast("long"), lambda seen, x: seen.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with the parities of ``apart`` as MARKS."""
    return rows.select("*", *(parity("apart", k).alias(m) for k, m in enumerate(MARKS)))


def links_of_lines(rows: DataFrame, num: int, den: int) -> DataFrame:
    """As ``near.links_in_blocks``, of lines. A node is stored once, however many pairs of blocks it is in."""
    return block_links(in_pairs(stored(marked(rows), "blocks")), num, den)


def block_links(met: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components that the pairs of two blocks show; pairs do not leave the task that joins them."""
    rows = met if set(MARKS) <= set(met.columns) else marked(met)
    keys = ["center", "left", "right"]
    sides = [rows.where(F.col("block") == F.col(side)).select(*keys, *(F.col(c).alias(f"{c}_{side}") for c in ("nid", "n", "group", "apart", *MARKS))) for side in ("left", "right")]
    sizes = [F.size(f"apart_{side}") for side in ("left", "right")]
    # Sizes and parities rule most pairs out before members are compared: sets differ in a member at least for every bit that differs.
    differ = sum((F.bit_count(F.col(f"{m}_left").bitwiseXOR(F.col(f"{m}_right"))) for m in MARKS), F.lit(0))
    # A block that meets itself shows each pair from both sides; one is enough.
    once = (F.col("left") != F.col("right")) | (F.col("nid_left") < F.col("nid_right"))
    may = once & (F.col("group_left") != F.col("group_right")) & similar("n_left", "n_right", F.abs(sizes[0] - sizes[1]), num, den) & similar("n_left", "n_right", differ, num, den)
    apart = sizes[0] + sizes[1] - 2 * F.size(F.array_intersect("apart_left", "apart_right"))
    pairs = sides[0].join(sides[1], keys).where(may & similar("n_left", "n_right", apart, num, den))
    return pairs.select(F.least("group_left", "group_right").alias("a"), F.greatest("group_left", "group_right").alias("b")).distinct()


def line_classes(docs: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(node, first): the first line (lacking, doc_id, line_no) of the class of every distinct line."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("lacking"), "doc_id", "line_no", "mark")).alias("own")
    # Equal lines become one before their shingles are made; these stay where the line is and need no further exchange.
    once = keyed(docs).groupBy("node").agg(least, F.first("line").alias("line"))
    nodes = stored(signed(once, ["node", "own"]).select("node", "own", "bands").withColumn("nid", F.monotonically_increasing_id()), "lines")
    met = []

    def sets_of(asked: DataFrame) -> DataFrame:
        met.append(stored(asked, "asked_lines"))
        return lines_at(docs, met[0])

    # Lines are a tenth of their sets: they go through the joins, and sets are made where two lines meet.
    groups = linked_sets(nodes, sets_of, num, den, compared, links_of_lines, BLOCK_NODES)
    place = F.struct("own.lacking", "own.doc_id", "own.line_no").alias("own")
    # Only lines that met another can be in a group.
    several = stored(met[0].select("nid", "node", place).join(groups, "nid"), "line_groups")
    first = several.groupBy("component").agg(F.min("own").alias("first"))
    moved = stored(several.join(first, "component").select("node", "first"), "line_classes")
    return nodes.select("node", place).join(moved, "node", "left").select("node", F.coalesce("first", "own").alias("first"))


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, line_no, class_doc, class_line, kept) of every line that is not blank."""
    own = F.struct(F.col("doc_id").isNull().alias("lacking"), "doc_id", "line_no")
    classes = line_classes(docs)
    met = keyed(docs).select("doc_id", "mark", "line_no", "node").join(classes, "node")
    return met.select("doc_id", "mark", "line_no", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line"), (F.col("first") == own).alias("kept"))


def thinned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns; their texts lose the lines that are near copies of earlier ones."""
    gone = judged(docs).where("NOT kept").groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.collect_set("line_no").alias("_gone"))
    rows = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_mark")), "left")
    lines = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_gone", i.cast("long")))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return rows.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])
