"""Log-probabilities of texts under a hidden Markov language model.

States emit word classes, a class emits its words: each of the OWN most frequent
words is a class of its own, all others fall into SHARED classes by their last
three bytes, and the end of a text is a class too. Word counts are taken over
all training texts. Baum-Welch begins with the class frequencies under a fixed
noise and runs over all training texts in each round: every partition returns
expected counts, Spark sums them, and the new parameters are set from the sums,
until the summed log-likelihood rises by less than GAIN of itself. In training
only, long sequences are cut into segments of SEGMENT tokens that step together;
a move from one to the next is counted from what each of them says of its end.
A text's score is exact: scaled forward recursion over the whole sequence.

Counts of the HEAD most frequent words are broadcast; all other words of the
texts meet their counts in a shuffled join, so no word is left out. Head words
are recognised by a 64-bit hash.

Defined results: a null or empty text is its end only. A null id is never held
out. Without training texts every count is 0 and all classes are as likely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.tokens import Words, hash_strings, mix, slices, utf8
from webloom.session import stored

STATES = 8
OWN = 4096
SHARED = 1024
END = OWN + SHARED
CLASSES = END + 1
HEAD = 200_000
# Training ends when a round adds less than this part of the log-likelihood.
GAIN = 1e-4
SEGMENT = 128
# Weight, in tokens, of the class frequencies in a state's emissions, and of even odds in its moves.
EMISSION_PRIOR, MOVE_PRIOR = 100.0, 1.0
TRAIN_TOKENS, SCORE_TOKENS = 200_000, 2_000_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch):
                words = Words(data, offsets)
                _, first, count = np.unique(words.hashes(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([words.strings().take(pa.array(first)), pa.array(count)], ["word", "c"])

    return docs.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def shared_class(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of a word by its last three bytes."""
    length = np.diff(offsets)
    tail = np.zeros(len(length), np.uint64)
    for k in (1, 2, 3):
        at = np.maximum(offsets[1:] - k, 0)
        tail = tail * np.uint64(257) + np.where(length >= k, data[at].astype(np.uint64) + np.uint64(1), np.uint64(0))
    return OWN + (mix(tail) % np.uint64(SHARED)).astype(np.int64)


@dataclass
class Vocabulary:
    """Counts of the head words by hash, the classes, and the totals."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    texts: int = 0
    tokens: int = 0
    types: int = 0
    class_tokens: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.int64))
    class_types: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES, np.int64))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the head words, -1 for others."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == h, at, -1)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def share(self) -> np.ndarray:
        """Frequency of each class, above 0."""
        return (self.class_tokens + 1) / (self.class_tokens + 1).sum()


def head_count(counts: DataFrame, most: int = HEAD) -> int:
    """The least count of a head word: at most ``most`` words have as many. Counts are put into bins, 16 to a doubling."""
    shift = F.greatest(F.length(F.bin("c")) - 5, F.lit(0))
    bins = counts.groupBy(shift.alias("shift"), F.call_function("shiftright", F.col("c"), shift).alias("top")).agg(F.count(F.lit(1)).alias("words"))
    least, words = 1 << 62, 0
    for r in sorted(bins.collect(), key=lambda r: -(r["top"] << r["shift"])):  # at most a thousand bins
        words += r["words"]
        if words > most:
            break
        least = r["top"] << r["shift"]
    return least


def vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """Of stored counts (word, c); ``texts`` is the number of training texts, each with an end."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The OWN most frequent words, whatever the number of words with their counts, and the head.
    own_words = counts.orderBy(F.desc("c"), "word").limit(OWN)
    head = pa.concat_tables([own_words.toArrow(), counts.where(F.col("c") >= head_count(counts)).toArrow()])
    head = head.group_by("word").aggregate([("c", "max")]).rename_columns(["word", "c"])
    names, c = head.column("word").combine_chunks().cast(pa.string()), head.column("c").to_numpy()
    # By count, then by the bytes of the word.
    order = np.lexsort((np.array(names.cast(pa.binary()).to_pylist(), object), -c)) if len(c) else np.zeros(0, int)
    names, c, rank = names.take(pa.array(order)), c[order], np.arange(len(c))
    h = hash_strings(names)
    cls = np.where(rank < OWN, rank, shared_class(*utf8(names)) if len(head) else rank)
    order = np.argsort(h)
    v = Vocabulary(h[order], c[order], cls[order], texts, totals[0] + texts, totals[1] + (texts > 0))
    own = np.sort(h[:OWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, c = batch.column("word"), batch.column("c").to_numpy()
            h, cls = hash_strings(words), shared_class(*utf8(words)) if batch.num_rows else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(own, h), max(len(own) - 1, 0))
            rest = own[at] != h if len(own) else np.ones(len(h), bool)
            n = np.bincount(cls[rest], c[rest], CLASSES)
            found = np.flatnonzero(np.bincount(cls[rest], minlength=CLASSES))
            types = np.bincount(cls[rest], minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found].astype(np.int64)), pa.array(types[found])], ["cls", "n", "v"])

    for r in counts.mapInArrow(run, "cls long, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        v.class_tokens[r["cls"]], v.class_types[r["cls"]] = r["n"], r["v"]
    v.class_tokens[: min(OWN, len(head))] = c[:OWN]
    v.class_types[: min(OWN, len(head))] = 1
    v.class_tokens[END], v.class_types[END] = texts, 1
    return v


CODED = (
    "doc_id long, held_out boolean, n_tokens long, classes binary, base double, inner double, known long, "
    "tail array<struct<word: string, cls: int>>"
)


def coded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """The class sequence of every document (doc_id, text, held_out), the sums over its head words, and its other words."""
    held = docs.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        base, end = v.base(v.counts), float(v.base(np.array(v.texts)))
        inner = np.where(v.classes < OWN, 0.0, np.log10((v.counts + 1) / (v.class_tokens + v.class_types + 1)[v.classes]))
        for batch in batches:
            for rows, data, offsets in slices(batch):
                words = Words(data, offsets)
                at = v.find(words.hashes())
                head, doc, n = at >= 0, words.doc, rows.num_rows
                cls = shared_class(*words.packed()) if len(words) else np.zeros(0, np.int64)
                cls[head] = v.classes[at[head]]
                ends = np.cumsum(words.counts + 1)
                codes = np.full(int(ends[-1]), END, np.uint16)
                codes[np.arange(len(words)) + doc] = cls
                tail = np.flatnonzero(~head)
                tails = np.concatenate(([0], np.cumsum(np.bincount(doc[tail], minlength=n)))).astype(np.int32)
                pairs = pa.StructArray.from_arrays([words.strings().take(pa.array(tail)), pa.array(cls[tail].astype(np.int32))], ["word", "cls"])
                sums = [np.bincount(doc[head], x[at[head]], n) for x in (base, inner)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        rows.column("held_out"),
                        pa.array(words.counts + 1),
                        pa.array([codes[e - k - 1 : e].tobytes() for e, k in zip(ends, words.counts, strict=True)], pa.binary()),
                        pa.array(sums[0] + end),
                        pa.array(sums[1]),
                        pa.array(np.bincount(doc[head], minlength=n) + int(v.texts > 0)),
                        pa.ListArray.from_arrays(pa.array(tails), pairs),
                    ],
                    ["doc_id", "held_out", "n_tokens", "classes", "base", "inner", "known", "tail"],
                )

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string")).mapInArrow(run, CODED)


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray  # from state to state
    emit: np.ndarray  # class x state

    def resting(self) -> np.ndarray:
        """How often a state is taken in the long run: where a cut segment starts."""
        p = np.full(len(self.start), 1 / len(self.start))
        for _ in range(50):
            p = p @ self.moves
        return p / p.sum()


def sequences(batch: pa.RecordBatch, tokens: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with about ``tokens`` tokens, their joined class sequences, and offsets."""
    column = batch.column("classes")
    buffers = column.buffers()
    places = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(places, places[first] + 2 * tokens, side="right")) - 1)
        last = min(last, batch.num_rows)
        data = np.frombuffer(buffers[2], np.uint8)[places[first] : places[last]].copy().view(np.uint16)
        yield batch.slice(first, last - first), data, (places[first : last + 1] - places[first]) // 2
        first = last


def expected(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of sequences, and their log-likelihood. All segments step together."""
    sizes = np.diff(offsets)
    per = -(-sizes // SEGMENT)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(offsets[:-1], per) + number * SEGMENT
    length = np.minimum(np.repeat(offsets[1:], per) - begin, SEGMENT)
    order = np.argsort(-length, kind="stable")
    begin, length, fresh = begin[order], length[order], (number == 0)[order]
    place = np.argsort(order)
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # segments longer than t
    states = len(model.start)
    emit, moves = model.emit.astype(np.float32), model.moves.astype(np.float32)
    before = np.where(fresh[:, None], model.start, model.resting()).astype(np.float32)
    alphas, scales, seen, lik = [], [], [], 0.0
    for t in range(steps):
        k = active[t]
        cls = data[begin[:k] + t]
        a = (before[:k] if t == 0 else alphas[-1][:k] @ moves) * emit[cls]
        s = a.sum(1, keepdims=True)
        a /= s
        lik += float(np.log10(s.astype(np.float64)).sum())
        alphas.append(a), scales.append(s), seen.append(cls)
    moved = np.zeros((states, states))
    beta, gammas = np.ones((active[-1], states), np.float32), [None] * steps
    gammas[-1] = alphas[-1] * beta
    for t in range(steps - 2, -1, -1):
        k = active[t + 1]
        w = emit[seen[t + 1]] * beta / scales[t + 1]
        moved += alphas[t][:k].T @ w
        earlier = np.ones((active[t], states), np.float32)
        earlier[:k] = w @ moves.T
        beta = earlier
        gammas[t] = alphas[t] * beta
    # Moves from a full segment to the one that goes on with its text; each is one move.
    later = np.flatnonzero(number > 0)
    if len(later):
        ends = alphas[SEGMENT - 1][place[later - 1]]
        onward = (gammas[0] / before)[place[later]]
        moved += ends.T @ (onward / ((ends @ moves) * onward).sum(1, keepdims=True))
    cls, gamma = np.concatenate(seen), np.concatenate(gammas)
    emitted = np.stack([np.bincount(cls, gamma[:, s], CLASSES) for s in range(states)], axis=1)
    return gammas[0][fresh[: len(gammas[0])]].sum(0).astype(np.float64), moved * model.moves, emitted, lik


def updated(starts: np.ndarray, moved: np.ndarray, emitted: np.ndarray, share: np.ndarray) -> Model:
    start, moves = starts + MOVE_PRIOR, moved + MOVE_PRIOR
    emit = emitted + EMISSION_PRIOR * share[:, None]
    return Model(start / start.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


def beginning(share: np.ndarray, seed: int = 0) -> Model:
    """Even states that emit by the class frequencies, told apart by a fixed noise."""
    emit = share[:, None] * np.exp(np.random.default_rng(seed).normal(0, 0.3, (CLASSES, STATES)))
    return Model(np.full(STATES, 1 / STATES), 0.9 * np.eye(STATES) + 0.1 / STATES, emit / emit.sum(0))


def one_round(texts: DataFrame, model: Model, share: np.ndarray) -> tuple[Model, float]:
    """Baum-Welch over all ``texts`` (classes): counts per partition, summed by Spark. Also the log-likelihood before."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        # Rows: the classes, then the states left, the start, and the log-likelihood.
        total = np.zeros((CLASSES + STATES + 2, STATES))
        for batch in batches:
            for _, data, offsets in sequences(batch, TRAIN_TOKENS):
                starts, moved, emitted, lik = expected(model, data, offsets)
                total += np.concatenate([emitted, moved, starts[None], np.full((1, STATES), lik)])
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(total[some, s]) for s in range(STATES)]], ["row", *[f"s{s}" for s in range(STATES)]])

    columns = [f"s{s}" for s in range(STATES)]
    summed = texts.select("classes").mapInArrow(run, "row long, " + ", ".join(f"{c} double" for c in columns)).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns])
    total = np.zeros((CLASSES + STATES + 2, STATES))
    for r in summed.collect():
        total[r["row"]] = r[1:]
    return updated(total[-2], total[CLASSES:-2], total[:CLASSES], share), float(total[-1, 0])


def forward(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact log10 likelihood of each sequence."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    begin, length = offsets[:-1][order], sizes[order]
    out = np.zeros(len(sizes))
    active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
    a = np.repeat(model.start[None], len(sizes), 0)
    for t, k in enumerate(active):
        a = (a if t == 0 else a[:k] @ model.moves) * model.emit[data[begin[:k] + t]]
        s = a.sum(1)
        a /= s[:, None]
        out[:k] += np.log10(s)
    result = np.empty(len(sizes))
    result[order] = out
    return result


def likelihoods(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (uid, classes) with the log10 likelihood of their class sequences."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in sequences(batch, SCORE_TOKENS):
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(forward(held.value, data, offsets))], ["uid", "lik"])

    return rows.select("uid", "classes").mapInArrow(run, "uid long, lik double")


def trained(texts: DataFrame, share: np.ndarray) -> Model:
    """The model of the training ``texts`` (classes), all of which take part in every round."""
    model, before = beginning(share), -np.inf
    while True:
        model, lik = one_round(texts, model, share)
        if not lik - before > GAIN * abs(lik):
            return model
        before = lik


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document (doc_id, text)."""
    marked = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    counts = stored(word_counts(marked.where("NOT held_out")), "word_counts")
    v = vocabulary(counts, marked.where("NOT held_out").count())
    rows = stored(coded(marked, v).withColumn("uid", F.monotonically_increasing_id()), "coded")
    model = trained(rows.where("NOT held_out"), v.share())
    spark = docs.sparkSession
    # One row for each shared class.
    totals = spark.createDataFrame([(k, int(v.class_tokens[k] + v.class_types[k] + 1)) for k in range(OWN, END)], "cls int, room long")
    words = rows.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", "t.cls")
    met = words.join(counts, "word", "left").join(F.broadcast(totals), "cls")
    c = F.coalesce("c", F.lit(0)) + 1
    tails = met.groupBy("uid").agg(
        F.sum(F.log10(c / F.lit(v.tokens + v.types + 1))).alias("t_base"),
        F.sum(F.log10(c / F.col("room"))).alias("t_inner"),
        F.count("c").alias("t_known"),
    )
    found = rows.drop("classes", "tail").join(likelihoods(rows, model), "uid").join(tails, "uid", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return found.select(
        "doc_id",
        "held_out",
        "n_tokens",
        plus("known", "t_known").alias("n_known"),
        F.lit(v.tokens).cast("bigint").alias("train_tokens"),
        plus("base", "t_base").alias("base_score"),
        (plus("inner", "t_inner") + F.col("lik")).alias("score"),
    )
