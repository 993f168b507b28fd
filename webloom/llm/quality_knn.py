"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

Terms are byte trigrams, hashed, and three marks of form: a word that repeats
the one before it, neighbouring capitals, and symbols. Counts are weighted by
square root and inverse document frequency; the leading directions of the
labelled sample are its latent space. The sample's vectors and labels are
broadcast, the cosine of every document to all of them is computed in blocks,
and the nearest vote with weights that grow with the cosine.

Bounds: SAMPLE labelled rows of distinct ids that have a document, chosen by the
hash of the id; so the broadcast is at most SAMPLE x RANK numbers. Everything is
scored on its whole text.

Defined results: null and empty texts have no terms and take the share of
label 1 in the sample. Documents of which none has a usable label raise a
ValueError, as nothing can be learnt from them. Null labels and ids are not
used, an id with both labels counts once for each, of several texts of an id one
is taken; a null id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.held_out import held_out
from webloom.llm.tokens import Words, mix, slices

SAMPLE = 2000
RANK = 32
TRIGRAMS = 2048
NEIGHBOURS = 15
THRESHOLD = 0.7
# Weight of the marks of form against a trigram: a repeated word, two capitals, a symbol.
FORM_WEIGHTS = (4.0, 0.7, 1.0)
TERMS = TRIGRAMS + len(FORM_WEIGHTS)
# Counts as a neighbour that votes with the share of label 1 in the sample.
PRIOR_WEIGHT = 0.05
SHARPNESS = 8
ROWS = 256

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[np.frombuffer(b"#*$%&|<>!", np.uint8)] = True


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of term counts for each text."""
    n = len(offsets) - 1
    doc = np.repeat(np.arange(n), np.diff(offsets))
    wide = data.astype(np.uint64)
    code = (wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]
    term = (mix(code) % np.uint64(TRIGRAMS)).astype(np.int64)
    inside = doc[:-2] == doc[2:]
    counts = np.zeros((n, TERMS), np.float32)
    counts[:, :TRIGRAMS] = np.bincount((doc[:-2] * TRIGRAMS + term)[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    words = Words(data, offsets, lower=False)
    h = words.hashes()
    again = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    capital = (data >= ord("A")) & (data <= ord("Z"))
    pair = capital[1:] & capital[:-1] & (doc[1:] == doc[:-1])
    for k, places in enumerate((words.doc[1:][again], doc[1:][pair], doc[IS_SYMBOL[data]])):
        counts[:, TRIGRAMS + k] = FORM_WEIGHTS[k] * np.bincount(places, minlength=n)
    return counts


@dataclass
class Model:
    weights: np.ndarray  # inverse document frequency of each term
    space: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # of the labelled sample
    labels: np.ndarray

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero for texts without terms."""
        return unit(unit(np.sqrt(counts) * self.weights) @ self.space)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(counts))
        prior = self.labels.mean()
        cosine = self.place(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, nearest, 1), 0).astype(np.float64) ** SHARPNESS
        total = (vote * self.labels[nearest]).sum(1) + PRIOR_WEIGHT * prior
        return np.clip(total / (vote.sum(1) + PRIOR_WEIGHT), 0.0, 1.0)


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return (rows / np.where(length > 1e-6, length, 1) * (length > 1e-6)).astype(np.float32)


def fitted(counts: np.ndarray, labels: np.ndarray) -> Model:
    if not len(labels):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, RANK), np.float32), np.zeros((0, RANK), np.float32), labels)
    seen = (counts > 0).sum(0)
    weights = (1 + np.log((len(counts) + 1) / (seen + 1))).astype(np.float32)
    rows = unit(np.sqrt(counts) * weights)
    _, directions = np.linalg.eigh((rows.T @ rows).astype(np.float64))
    model = Model(weights, directions[:, -RANK:].astype(np.float32), np.zeros((0, RANK), np.float32), labels)
    model.vectors = model.place(counts)
    return model


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of labelled documents that are not held out."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", 4, 2)).select("doc_id", "quality").distinct()
    # Ids are made distinct before they meet, so one id with most of the rows is one row.
    usable = usable.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, most_rows=ROWS):
                counts = pa.array([row.tobytes() for row in term_counts(data, offsets)], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), counts], ["doc_id", "quality", "counts"])

    typed = texts.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("text").cast("string"))
    counted = typed.mapInArrow(run, "doc_id long, quality int, counts binary").groupBy("doc_id", "quality").agg(F.min("counts").alias("counts"))
    rows = counted.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample).collect()
    if not rows and not docs.isEmpty():
        raise ValueError("no document has a label to learn from")
    counts = np.array([np.frombuffer(r["counts"], np.float32) for r in rows]).reshape(len(rows), TERMS)
    return fitted(counts, np.array([r["quality"] for r in rows], np.float64))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted (1 from the threshold on) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, most_rows=ROWS):
                score = held.value.score(term_counts(data, offsets))
                predicted = pa.array((score >= threshold).astype(np.int32))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score), predicted], ["doc_id", "score", "predicted"])

    typed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return typed.mapInArrow(run, "doc_id long, score double, predicted int")


def good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model accepts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, most_rows=ROWS):
                yield rows.filter(pa.array(held.value.score(term_counts(data, offsets)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
