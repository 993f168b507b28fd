"""Near copies among hashed sets: banding, exact verification, components.

Equal sets are one node from the start, so copies never meet as pairs. Nodes
that share a band are candidates. Each band has a center, its best connected
node, and every other node of the band is compared with it; this joins groups
of near copies in one step. Two nodes of a band that this leaves in different
components still have to be compared. They have a center c in common, and

    |x & y| = (|x| + |y| - |x ^ y|) / 2,   |x ^ y| = |x ^ c| + |y ^ c| - 2 |(x ^ c) & (y ^ c)|,

so the short differences from the center decide exactly for all pairs of a
center's nodes. They are compared in blocks of bounded size by matrix products
inside tasks; only the links found leave the task, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.components import components
from webloom.llm.sketch import difference, overlaps
from webloom.session import stored

# Nodes and bytes of differences that one block holds; a task sees two blocks at a time.
BLOCK_NODES, BLOCK_BYTES = 512, 16 << 20


def with_ids(described: DataFrame) -> DataFrame:
    """One row per distinct set (nid, node, n, bands) of rows with these columns."""
    once = described.where("node IS NOT NULL").select("node", "n", "bands").dropDuplicates(["node"])
    return stored(once.withColumn("nid", F.monotonically_increasing_id()), "nodes")


def crowded_bands(nodes: DataFrame) -> DataFrame:
    """(key, nid, center): the members of bands with two nodes or more and the member with most company."""
    # Both readers take the same columns, so that bands are dealt out once.
    bands = nodes.select("nid", F.explode("bands").alias("key")).repartition("key")
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("nid").alias("low"), F.max("nid").alias("high")).where("low < high").select("key", "members")
    met = stored(bands.join(shared.hint("shuffle_hash"), "key"), "bands")
    company = met.groupBy("nid").agg(F.sum("members").alias("company"))
    ranked = met.join(company, "nid")
    best = F.max(F.struct("company", (-F.col("nid")).alias("back"))).alias("best")
    centers = ranked.groupBy("key").agg(best).select("key", (-F.col("best.back")).alias("center"))
    return stored(met.join(centers, "key").select("key", "nid", "center"), "crowded")


def ordered(x, y) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def packed_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of a column that holds their sorted values as bytes."""
    return (np.frombuffer(v.as_py(), np.uint64) for v in column)


def compared(stars: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (center, nid) with size, center_n, whether they are linked and their sorted difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for c, x in zip(packed_sets(batch.column("set_c")), packed_sets(batch.column("set_x")), strict=True):
                apart = difference(c, x)
                both = (len(c) + len(x) - len(apart)) // 2
                made.append((len(x), len(c), den * both >= num * (len(c) + len(x) - both), apart.tobytes()))
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("center"), batch.column("nid"), *columns], ["center", "nid", "n", "center_n", "linked", "apart"])

    sides = [sets.select(F.col("nid").alias(name), F.col("members").alias(s)) for name, s in (("center", "set_c"), ("nid", "set_x"))]
    rows = stars.join(sides[0], "center").join(sides[1], "nid").select("center", "nid", "set_c", "set_x")
    return rows.mapInArrow(run, "center long, nid long, n long, center_n long, linked boolean, apart binary")


def dealt(stars: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """Nodes whose center has a node outside its own component, with their block of ``most`` nodes and the blocks (others) it meets.

    Nodes outside and inside the center's component have blocks of their own; two inside blocks need no comparison.
    """
    # The differences are the bulk of a row: they join when it is known where nodes go.
    size = F.length("apart") if stars.schema["apart"].dataType.typeName() == "binary" else 8 * F.size("apart")
    narrow = stars.select("center", "nid", "n", size.alias("size"))
    own = groups.withColumnRenamed("component", "group").withColumnRenamed("node", "nid")
    theirs = groups.withColumnRenamed("component", "center_group").withColumnRenamed("node", "center")
    named = narrow.join(own, "nid", "left").join(theirs, "center", "left")
    named = named.withColumn("group", F.coalesce("group", "nid")).withColumn("outside", F.col("group") != F.coalesce("center_group", "center"))
    blocks = lambda part: F.ceil(F.greatest(F.sum(part.cast("long")) / most, F.sum(F.when(part, F.col("size"))) / BLOCK_BYTES))
    sizes = named.groupBy("center").agg(blocks(F.col("outside")).alias("outer"), blocks(~F.col("outside")).alias("inner"), F.count(F.lit(1)).alias("nodes"))
    sizes = stored(sizes.where("nodes > 1 AND outer > 0").withColumn("inner", F.coalesce("inner", F.lit(0))), "block_sizes")
    spot = F.pmod(F.xxhash64("nid"), F.when(F.col("outside"), F.col("outer")).otherwise(F.col("inner")))
    placed = named.join(sizes, "center").withColumn("block", spot + F.when(F.col("outside"), 0).otherwise(F.col("outer")))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("outside"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
    whole = placed.select("*", others.alias("others")).join(stars.select("center", "nid", "apart"), ["center", "nid"])
    return whole.select("center", "block", "others", "nid", "n", "group", "apart")


def in_pairs(rows: DataFrame) -> DataFrame:
    """Rows of ``dealt``, once for each pair of blocks (left, right) they are in."""
    met = rows.withColumn("other", F.explode("others"))
    return met.select(F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), *(c for c in rows.columns if c != "others"))


def block_links(rows: list[dict], num: int, den: int) -> list[tuple[int, int]]:
    """Links between components that the pairs of two blocks (of one, if they are the same) show."""
    here = [r for r in rows if r["block"] == r["left"]]
    there = [r for r in rows if r["block"] == r["right"]]
    if not here or not there:
        return []
    a, b = ([np.frombuffer(r["apart"], np.uint64) for r in side] for side in (here, there))
    na, nb = (np.array([r["n"] for r in side]) for side in (here, there))
    apart = np.array([len(v) for v in a])[:, None] + np.array([len(v) for v in b])[None, :] - 2 * overlaps(a, b)
    both = (na[:, None] + nb[None, :] - apart) // 2
    similar = den * both >= num * (na[:, None] + nb[None, :] - both)
    parent: dict[int, int] = {}

    def root(g: int) -> int:
        while parent.get(g, g) != g:
            g = parent[g]
        return g

    found = []
    for i, j in zip(*np.nonzero(similar), strict=True):
        x, y = root(here[i]["group"]), root(there[j]["group"])
        if x != y:
            parent[max(x, y)] = min(x, y)
            found.append((min(here[i]["nid"], there[j]["nid"]), max(here[i]["nid"], there[j]["nid"])))
    return found


def links_in_blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) of all pairs of blocks; a task keeps one pair of blocks at a time."""
    columns = ["center", "left", "right", "block", "nid", "n", "group", "apart"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, rows = None, []

        def flush() -> pa.RecordBatch:
            found = block_links(rows, num, den)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=schema)

        for batch in batches:
            for r in batch.to_pylist():
                own = (r["center"], r["left"], r["right"])
                if own != key and rows:
                    yield flush()
                    rows = []
                key = own
                rows.append(r)
        yield flush()

    keys = ["center", "left", "right"]
    return in_pairs(rows).select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def linked_sets(
    nodes: DataFrame,
    sets_of: Callable[[DataFrame], DataFrame],
    num: int = 80,
    den: int = 100,
    compare: Callable[..., DataFrame] = compared,
    links: Callable[..., DataFrame] = links_in_blocks,
    block_nodes: int | None = None,
) -> DataFrame:
    """(nid, component) of all ``nodes`` (nid, node, bands) that have a link.

    ``sets_of`` gives (nid, members) for nodes (nid, node and what else they have): the sorted full sets, or what ``compare`` makes them from.
    ``compare`` and ``links`` do as ``compared`` and ``links_in_blocks``; a block holds ``block_nodes`` (BLOCK_NODES) nodes.
    """
    stars = stored(crowded_bands(nodes).where("nid <> center").select("center", "nid").distinct(), "stars")
    asked = stars.select("nid").union(stars.select("center")).distinct()
    sets = stored(sets_of(nodes.drop("n", "bands").join(asked, "nid", "left_semi")), "sets")
    seen = stored(compare(stars, sets, num, den), "compared")
    direct = seen.where("linked").select(*ordered(F.col("center"), F.col("nid")))
    first = stored(components(direct), "groups")
    more = stored(links(dealt(seen, first, block_nodes or BLOCK_NODES), num, den), "block_links")
    return components(direct.union(more)).withColumnRenamed("node", "nid")
