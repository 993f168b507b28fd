"""Language by a convolutional network over bytes, trained in numpy.

Bytes are embedded; filters of several widths run over a window of LENGTH
bytes; the maximum of each filter over the window, rectified, feeds a softmax
over the languages. A text is cut into windows that cover all of it, and its
probabilities are the mean over its windows. For prediction embedding and
filter become one table per place in the filter, so that a filter is a sum of
table rows.

Bounds: the training set has at most DOCS documents in all, the same number for
each language where there are as many; all windows of their whole texts are used.
Of several texts with one id and language one is taken.

Defined results: null texts and texts without a letter are ``und`` with score
0, as is everything if there is nothing to learn from. Null languages are not
learned; a null id is never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.held_out import held_out, some_per_label
from webloom.llm.tokens import slices

LENGTH = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
# Labelled documents, of distinct ids, that train the network: all windows of their whole texts.
DOCS = 800
EPOCHS = 4
BATCH = 64
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of LENGTH bytes that cover every text, the last filled up with 0, and the text of each."""
    sizes = np.diff(offsets)
    per = -(-sizes // LENGTH)
    doc = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = offsets[doc] + number * LENGTH
    place = begin[:, None] + np.arange(LENGTH)
    inside = place < offsets[doc + 1][:, None]
    return np.where(inside, data[np.minimum(place, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(data) else np.zeros((0, LENGTH), np.uint8), doc


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: width x EMBEDDING x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        return [[np.ascontiguousarray(self.embedding @ f[j], dtype=np.float32) for j in range(len(f))] for f in self.filters]

    def pooled(self, rows: np.ndarray, tables, where: bool = False):
        """The maximum of every filter over each window, and its place."""
        best, place = [], []
        for width, table in zip(WIDTHS, tables, strict=True):
            steps = LENGTH - width + 1
            total = np.take(table[0], rows[:, :steps], axis=0)
            for j in range(1, width):
                total += np.take(table[j], rows[:, j : j + steps], axis=0)
            best.append(total.max(1))
            if where:
                place.append(total.argmax(1))
        return np.concatenate(best, 1) + self.bias, place

    def probabilities(self, rows: np.ndarray, tables) -> np.ndarray:
        pooled, _ = self.pooled(rows, tables)
        return softmax(np.maximum(pooled, 0) @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS) -> Network:
    """Gradient descent with adaptive steps; the gradient of a maximum goes to its place only."""
    rng = np.random.default_rng(7)
    k = FILTERS * len(WIDTHS)
    net = Network(
        languages,
        rng.normal(0, 0.3, (256, EMBEDDING)),
        [rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        np.zeros(k),
        rng.normal(0, 1 / np.sqrt(k), (k, len(languages))),
        np.zeros(len(languages)),
    )
    parameters = [net.embedding, *net.filters, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for first in range(0, len(rows), BATCH):
            picked = order[first : first + BATCH]
            x, y = rows[picked], labels[picked]
            pooled, place = net.pooled(x, net.tables(), where=True)
            active = np.maximum(pooled, 0)
            d = softmax(active @ net.out + net.out_bias)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            d_pooled = (d @ net.out.T) * (pooled > 0)
            d_embedding, d_filters = np.zeros_like(net.embedding), []
            for i, width in enumerate(WIDTHS):
                part = d_pooled[:, i * FILTERS : (i + 1) * FILTERS]
                seen = np.stack([np.take_along_axis(x, place[i] + j, 1) for j in range(width)])  # width x batch x FILTERS
                d_filters.append(np.einsum("wbfe,bf->wef", net.embedding[seen], part))
                back = part[None, :, :, None] * net.filters[i].transpose(0, 2, 1)[:, None]
                np.add.at(d_embedding, seen.ravel(), back.reshape(-1, EMBEDDING))
            step += 1
            for p, g, (m, v) in zip(parameters, [d_embedding, *d_filters, d_pooled.sum(0), active.T @ d, d.sum(0)], moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(docs: DataFrame, most: int = DOCS) -> Network:
    """The network of a bounded sample of documents with a language that are not held out."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 5, 0))
    languages = [r[0] for r in usable.select("lang").distinct().orderBy("lang").collect()]  # names of languages, not of documents
    each = max(1, most // max(1, len(languages)))
    chosen = some_per_label(usable.select("doc_id", F.col("lang").alias("_lang")), "doc_id", "_lang", each)
    # At most ``most`` rows, or one for each language.
    texts = usable.select("doc_id", "lang", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen.select("doc_id", F.col("_lang").alias("lang"))), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                cut, doc = windows(data, offsets)
                langs = rows.column("lang").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([langs, pa.array([window.tobytes() for window in cut], pa.binary())], ["lang", "bytes"])

    cut = texts.mapInArrow(run, "lang string, bytes binary").distinct().orderBy(F.xxhash64("bytes"), "lang").collect()
    code = {name: i for i, name in enumerate(languages)}
    rows = np.array([np.frombuffer(r["bytes"], np.uint8) for r in cut], np.uint8).reshape(len(cut), LENGTH)
    return train(rows, np.array([code[r["lang"]] for r in cut], int), languages)


def predicted(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    held = docs.sparkSession.sparkContext.broadcast((net, net.tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = held.value
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for rows, data, offsets in slices(batch):
                cut, doc = windows(data, offsets)
                total = np.zeros((rows.num_rows, max(1, len(model.languages))))
                if model.languages:
                    for i in range(0, len(cut), 128):
                        np.add.at(total, doc[i : i + 128], model.probabilities(cut[i : i + 128], tables))
                mean = total / np.maximum(1, np.bincount(doc, minlength=rows.num_rows))[:, None]
                known = rows.column("lettered").to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
                best = np.where(known, mean.argmax(1), len(model.languages))
                score = np.where(known, np.clip(mean.max(1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    typed = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return typed.mapInArrow(run, "doc_id long, lang_pred string, score double")
