"""A Merkle manifest of documents: a digest per document, per source and of everything, with a proof for each document.

The leaves of a source ascend by id; every three consecutive nodes become their
digest until one is left, the subroot, and the subroots of the sources in order
are the leaves of the root's tree.

A tree is cut into blocks of ``3 ** BLOCK_LEVELS`` leaves, aligned so that a
block is a whole subtree; its inner nodes are hashed where the block lies. Above
the blocks the trees climb by a butterfly exchange: in round r the three blocks
that differ in digit r (base 3) of their number send each other the roots they
hold, and each hashes the common ancestor for itself. After the last round every
block holds the root and all siblings on its way, without a pass back down. A
tree's blocks are filled up to a power of three with blocks that hold nothing,
so that each block has its two partners in every round and none has more.

Rows get their places from one range-ordered copy of the leaves, cut between any
two of them: one source, one id or one repeated row may hold most of the rows.
A task holds at most one block.

Null fields are hashed as ``-``; null ids come before all others of a source,
the null source before all others. Rows equal in all hashed fields are leaves
of their own, side by side. Empty and null texts differ. A single leaf is its
own subroot, a single subroot the root, and their proofs are empty. No rows give
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.sizes import small
from webloom.operators.ranking import salted_join
from webloom.session import stored

FANOUT = 3
# Levels hashed inside a block: 2187 leaves.
BLOCK_LEVELS = 7
# Blocks whose proofs (about 3 KB each) every executor may hold; beyond that the join shuffles.
WAYS = 20_000
# Enough for any number of rows that a long can count.
LEVELS = 40

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(**changed: Column) -> Column:
    """The leaf of a document; ``changed`` has expressions in place of columns."""
    return digest(*(encoded(changed.get(name, F.col(name))) for name in FIELDS))


def depth_of(leaves: Column) -> Column:
    """Levels that are hashed above so many leaves."""
    powers = F.array(*(F.lit(FANOUT**i).cast("decimal(38,0)") for i in range(LEVELS)))
    return F.size(F.filter(powers, lambda p: p < leaves))


def placed(leaves: DataFrame) -> DataFrame:
    """Rows (tree, key, leaf, item) with their place in the tree from 0 and the tree's number of leaves."""
    order = ("tree", "key", "leaf", "_uid")
    rows = stored(leaves.withColumn("_uid", F.monotonically_increasing_id()), "leaves")
    # Rising ids of ordered partitions: the partition's number in the upper bits, the row's in the lower 33.
    rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "tree", "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(tree).alias("size")
    )
    found = rows.join(small(stored(starts, "starts")), ["tree", "_part"])
    return found.select("tree", (F.col("_before") + F.col("_at") - F.col("_first")).alias("place"), "size", "leaf", "item")


def blocks_of(leaves: DataFrame) -> DataFrame:
    """Aligned blocks: their items in order and the levels of digests from the leaves to the block's root."""
    span = FANOUT**BLOCK_LEVELS
    rows = placed(leaves).withColumn("block", F.floor(F.col("place") / span))
    blocks = rows.groupBy("tree", "block").agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", "leaf", "item"))).alias("rows")
    )
    depth = depth_of(F.col("size"))
    local = F.slice(F.array(*map(F.lit, range(BLOCK_LEVELS))), 1, F.least(depth, F.lit(BLOCK_LEVELS)))

    def above(nodes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
        return F.transform(runs, lambda run: F.sha2(F.array_join(F.slice(nodes, run * FANOUT + 1, FANOUT), ""), 256))

    levels = F.aggregate(local, F.array(F.col("rows.leaf")), lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))))
    blocks = blocks.select(
        "tree", "block", "size", F.greatest(depth - BLOCK_LEVELS, F.lit(0)).alias("rounds"), F.col("rows.item").alias("items"), levels.alias("levels")
    )
    return stored(blocks, "blocks")


def butterfly(blocks: DataFrame) -> DataFrame:
    """(tree, block, path, root) of every block: the siblings from the block's root up, and the tree's root."""
    held = blocks.select("tree", "block", "rounds", F.element_at(F.element_at("levels", -1), 1).alias("node"))
    trees = held.groupBy("tree", "rounds").agg(F.count(F.lit(1)).alias("_blocks"))
    full = F.pow(F.lit(float(FANOUT)), F.col("rounds")).cast("long")
    empty = trees.where(full > F.col("_blocks")).select(
        "tree", F.explode(F.sequence(F.col("_blocks"), full - 1)).alias("block"), "rounds", F.lit(None).cast("string").alias("node")
    )
    no_path = F.lit(None).cast("array<struct<left:string,right:string>>")
    held = stored(held.unionByName(empty).withColumn("path", F.coalesce(no_path, F.array())), "round")
    done, r = held.where("rounds = 0"), 0
    while not (active := held.where(F.col("rounds") > r)).isEmpty():
        step = FANOUT**r
        digit = F.pmod(F.floor(F.col("block") / step), F.lit(FANOUT))
        sent = active.withColumn("digit", digit).withColumn("to", F.explode(F.array(*map(F.lit, range(FANOUT)))))
        sent = sent.select(
            "tree", (F.col("block") + (F.col("to") - F.col("digit")) * step).alias("block"), "rounds",
            F.struct("digit", "node").alias("root"), F.when(F.col("to") == F.col("digit"), F.col("path")).alias("path"),
        )
        met = sent.groupBy("tree", "block", "rounds").agg(F.sort_array(F.collect_list("root")).alias("roots"), F.max("path").alias("path"))
        roots, own = F.filter("roots", lambda x: x["node"].isNotNull()), digit
        joined = lambda kept: F.array_join(F.transform(F.filter(roots, kept), lambda x: x["node"]), "")
        sides = F.struct(joined(lambda x: x["digit"] < own).alias("left"), joined(lambda x: x["digit"] > own).alias("right"))
        held = stored(
            met.select(
                "tree", "block", "rounds", F.when(F.size(roots) > 0, F.sha2(joined(lambda x: F.lit(True)), 256)).alias("node"),
                F.array_append("path", sides).alias("path"),
            ),
            "round",
        )
        r += 1
        done = done.unionByName(held.where(F.col("rounds") == r))
    # Filled-up blocks hold the root too, but no rows: joins to the blocks leave them out.
    return done.select("tree", "block", "path", F.col("node").alias("root"))


def climbed(blocks: DataFrame, uppers: DataFrame, *kept: str) -> DataFrame:
    """A row per leaf: tree, item, leaf, its path and columns ``kept`` of its block's row of ``uppers``."""

    def sides(nodes: Column, level: Column, at: Column) -> Column:
        node = F.floor(at / F.pow(F.lit(float(FANOUT)), level)).cast("int")
        place = F.pmod(node, F.lit(FANOUT))
        return F.struct(
            F.array_join(F.slice(nodes, node - place + 1, place), "").alias("left"),
            F.array_join(F.slice(nodes, node + 2, FANOUT - 1 - place), "").alias("right"),
        )

    hashed = F.slice("levels", 1, F.size("levels") - 1)
    leaves = F.transform(
        F.arrays_zip(F.col("items").alias("item"), F.element_at("levels", 1).alias("leaf")),
        lambda x, at: F.struct(
            x["item"].alias("item"), x["leaf"].alias("leaf"),
            F.concat(F.transform(hashed, lambda nodes, level: sides(nodes, level, at)), F.col("path")).alias("path"),
        ),
    )
    rows = blocks.join(small(uppers, WAYS), ["tree", "block"]).select("tree", *kept, F.explode(leaves).alias("_row"))
    return rows.select("tree", "_row.item", "_row.leaf", "_row.path", *kept)


def manifest(docs: DataFrame, **carried: Column) -> DataFrame:
    """A row per document: doc_id, leaf, subroot, root, path, and the ``carried`` expressions over ``docs``.

    ``path`` has a row for each level up to the root: the digests left and right
    of the way, each joined.
    """
    # The null source comes first: a name is never empty here.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    extra = [e.alias(name) for name, e in carried.items()]
    rows = docs.select(tree.alias("tree"), F.col("doc_id").alias("key"), leaf_of().alias("leaf"), F.struct(F.col("doc_id"), *extra).alias("item"))
    blocks = blocks_of(rows)
    uppers = stored(butterfly(blocks), "uppers")
    roots = uppers.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("leaf"), F.struct("tree").alias("item"))
    top = blocks_of(roots)
    over = climbed(top, stored(butterfly(top), "uppers"), "root").select(F.col("item.tree").alias("tree"), F.col("path").alias("_over"), F.col("root").alias("_root"))
    ways = salted_join(uppers, stored(over, "over"), "tree", F.col("block"), "inner").select(
        "tree", "block", F.concat("path", "_over").alias("path"), F.col("root").alias("subroot"), F.col("_root").alias("root")
    )
    return climbed(blocks, stored(ways, "ways"), "subroot", "root").select("item.*", "leaf", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda node, side: digest(side["left"], node, side["right"]))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), ""), 256)
