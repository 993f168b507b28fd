"""Near copies of documents by word shingles: sketches, bands, exact verification.

A document's set holds its distinct shingles of ``words`` words, A-Z in lower
case; a shorter text is one shingle of all its words. Shingles are 64-bit
hashes of their words; sets are equal when their 128-bit keys are.

Defined results: null texts and texts without words have an empty set, are
linked with nothing and are their own component. The component of a row is the
smallest document id of its group; rows that repeat an id share the fate of the
id, null ids are passed over when the smallest is sought, and a group of null
ids only has a null component and is kept. Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.near import linked_sets, with_ids
from webloom.llm.sizes import small
from webloom.llm.sketch import SKETCH_SCHEMA, described, distinct, set_keys
from webloom.llm.tokens import Words, mix, salts, slices
from webloom.session import stored

PLACE_SALTS = salts(64, 41) | np.uint64(1)
DESCRIBED = "doc_id long, text_key string, node binary, n long, bands array<long>"


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of every document and their offsets, repeats included."""
    h = words.hashes()
    counts = words.counts
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(made)))
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    at = np.repeat(begin - offsets[:-1], made) + np.arange(offsets[-1])
    length = np.repeat(np.minimum(counts, width), made)
    total = length.astype(np.uint64)
    padded = np.concatenate((h, np.zeros(width, np.uint64)))
    for j in range(width):
        total = total + np.where(j < length, padded[at + j] * PLACE_SALTS[j], np.uint64(0))
    return mix(total), offsets


def describe(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, a checksum of the text and the sketch of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), *SKETCH_SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                sets = distinct(*shingles(Words(data, offsets), width))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text_key"), *described(*sets)], schema=schema)

    return docs.select("doc_id", "text", F.md5("text").alias("text_key")).mapInArrow(run, DESCRIBED)


def members(docs: DataFrame, width: int) -> DataFrame:
    """(node, members): the full set of each document, sorted."""
    schema = pa.schema([("node", pa.binary()), ("members", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch):
                values, ends = distinct(*shingles(Words(data, offsets), width))
                keys = np.ascontiguousarray(set_keys(values, ends))
                rows = [(keys[i].tobytes(), values[a:b].tobytes()) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.binary())], schema=schema)

    return docs.select("text").mapInArrow(run, "node binary, members binary")


def grouped(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_key, node, n_shingles, owner) of documents (doc_id, text).

    ``owner`` (lacking, doc_id, text_key) is the first row of the group by id,
    null ids last; it is null for empty sets.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = stored(describe(docs, width), "sketches")
    nodes = with_ids(rows)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("lacking"), "doc_id", "text_key")).alias("owner")
    owners = stored(rows.where("node IS NOT NULL").groupBy("node").agg(least), "owners")

    def sets_of(asked: DataFrame) -> DataFrame:
        # One document per asked set is read again; its key is made anew, so rows that share an id do no harm.
        ids = stored(asked.join(owners, "node").select(F.col("owner.doc_id").alias("id")).distinct(), "asked_ids")
        wanted = docs.join(small(ids), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        return members(wanted, width).join(asked, "node").select("nid", "members").dropDuplicates(["nid"])

    groups = stored(linked_sets(nodes, sets_of, num, den), "groups")
    named = nodes.select("nid", "node").join(groups, "nid", "left").join(owners, "node")
    # Nodes without a component and rows without a set go round the joins: as null keys they would meet in one task.
    several = named.where("component IS NOT NULL")
    first = several.groupBy("component").agg(F.min("owner").alias("first"))
    labels = several.join(first, "component").select("node", F.col("first").alias("owner")).union(named.where("component IS NULL").select("node", "owner"))
    # The labels are written, so that Spark may split a set with very many copies when it joins them.
    rows = rows.select("doc_id", "text_key", "node", F.col("n").alias("n_shingles"))
    labels = stored(labels, "labels")
    bare = rows.where("node IS NULL").withColumn("owner", F.lit(None).cast(labels.schema["owner"].dataType))
    return rows.where("node IS NOT NULL").join(labels, "node").select(*bare.columns).union(bare)


def near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents (doc_id, text) as doc_id, n_shingles, component_id, kept: a row for each."""
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("owner.doc_id"))
    rows = grouped(docs, width, num, den).select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are first in their group; empty sets stay.

    Of rows that repeat both id and text one stays.
    """
    rows = stored(grouped(docs, width, num, den), "grouped")
    first = F.col("owner") == F.struct(F.col("doc_id").isNull().alias("lacking"), "doc_id", "text_key")
    full = rows.where("node IS NOT NULL")
    # What goes is listed, for it is less than what stays.
    names = [F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")]
    gone = stored(full.where(~first).select(*names).distinct(), "gone")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    keyed = row.withColumn("_doc", F.col("_row.doc_id").cast("long")).withColumn("_text", F.md5(F.col("_row.text").cast("string")))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_key"))
    left = keyed.join(small(gone), same, "left_anti")
    again = stored(full.where(first).groupBy(*names).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "repeats")
    if not again.isEmpty():
        repeats = small(again)
        once = left.join(repeats, same, "left_semi").dropDuplicates(["_doc", "_text"])
        left = left.join(repeats, same, "left_anti").union(once)
    return left.select("_row.*")
