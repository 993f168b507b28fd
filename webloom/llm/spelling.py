"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by variable-length grams.

The gram dictionary follows from counts of the substrings of all words: a gram
of ``Q_MIN`` code points is always a gram, and a gram is extended by the next
code point as long as it is frequent, up to ``Q_MAX``. A word, with a mark at
each end, is cut into the longest gram at each place, without grams that lie
within an earlier one.

One edit leaves all but some grams of a word alone. The bound of a word is the
largest number of grams that an edit anywhere in it can affect: those across the
place, and those that a gram grown at the place could swallow. Two words that are
near so share at least all grams of either one but its bound; hence each word's
bound + 1 rarest grams meet in a list with the other's. Words whose bound
leaves nothing over are met by others through all their grams, and by each other
through grams of fixed length ``Q_MIN``, of which an edit affects two.

The lists are kept short by what a shared, unaffected gram says: the edit lies
behind it, then the words agree up to its end, or before it, then they agree
from its start on; and of the rest of the word one half is untouched. A list is
keyed by what has to agree and by length, so no list grows with the use of a
gram alone. Candidates of a list are verified by edit distance as they meet;
the result is exact, without caps.

Texts are read in pieces that end between words, so long texts need little
memory. Null and empty texts have no words; a null id is written as nothing in
the checksum that decides on deletions; repeated rows count once each. No rows
give no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.session import stored

Q_MIN, Q_MAX = 2, 4
# Frequent grams that tasks hold: each has more than one in DICTIONARY of all substrings, so there are fewer than that.
DICTIONARY = 30_000
# Bytes of a text looked at together; distinct words held before they are passed on.
PIECE, HELD = 1 << 20, 200_000

# The run class in UTF-8, after ASCII letters were put in lower case: U+00C0 to U+00FF are C3 80 to C3 BF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
OUTSIDE = re.compile(rb"[^a-z\x80-\xff]")
DELETED_ONE_IN = 199


def pieces(data: bytes):
    """Bounds of parts of about ``PIECE`` bytes that end where no run goes on."""
    start = 0
    while start < len(data):
        cut = OUTSIDE.search(data, start + PIECE)
        end = cut.start() if cut else len(data)
        yield start, end
        start = end


def altered(key: bytes, run: bytes) -> str:
    """The run, without one code point where the checksum of key and run says so."""
    word = run.decode()
    h = zlib.crc32(run, zlib.crc32(key))
    if h % DELETED_ONE_IN == 0:
        word = word[: h % len(word)] + word[h % len(word) + 1 :]
    return word


def counted(docs: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(word, n): words of at least so many code points with at least so many occurrences in all texts."""

    def words(batches):
        held: Counter[str] = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                data = (value.as_py() or "").encode().lower()
                key = f"{'' if key.as_py() is None else key.as_py()}:".encode()
                for start, end in pieces(data):
                    for run, n in Counter(RUN.findall(data, start, end)).items():
                        if len(run) >= least_length and len(word := altered(key, run)) >= least_length:
                            held[word] += n
                    if len(held) > HELD:
                        yield counts(held)
                        held.clear()
        yield counts(held)

    def counts(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(words, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def marked(word: str) -> str:
    return f"\x01{word}\x02"


def frequent_grams(words: DataFrame) -> dict[str, int]:
    """Counts of the frequent substrings of ``Q_MIN`` to ``Q_MAX`` code points of the marked words."""
    whole = F.concat(F.lit("\x01"), "word", F.lit("\x02"))
    cut = [F.transform(F.sequence(F.lit(1), F.length(whole) - (q - 1)), lambda i, q=q: F.substring(whole, i, F.lit(q))) for q in range(Q_MIN, Q_MAX + 1)]
    grams = words.where(F.length("word") + 2 >= Q_MAX).select(F.explode(F.concat(*cut)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("k"))
    grams = stored(grams, "grams")
    total = grams.agg(F.sum("k")).first()[0] or 0
    return {r["gram"]: r["k"] for r in grams.where(F.col("k") > total // DICTIONARY).collect()}


class Grams:
    """Variable-length grams by the dictionary of frequent grams."""

    def __init__(self, frequent: dict[str, int]):
        self.frequent = frequent
        # Ends of grams that can be extended: what may stand right of an edit inside a longer gram.
        self.tails = {g[i:] for g in frequent if len(g) < Q_MAX for i in range(1, len(g))}

    def cut(self, s: str) -> list[tuple[int, int]]:
        """(start, end) of the grams of a marked word."""
        grams, covered = [], 0
        for start in range(len(s) - Q_MIN + 1):
            end = start + Q_MIN
            while end < len(s) and end - start < Q_MAX and s[start:end] in self.frequent:
                end += 1
            if end > covered:
                grams.append((start, end))
                covered = end
        return grams

    def affected(self, s: str, grams: list[tuple[int, int]], left: int, right: int) -> int:
        """Grams that may change with an edit between s[:left] and s[right:], which stay."""
        # Farthest places from which a gram can grow into the edit, or reach out of it.
        first = last = None
        for j in range(max(0, left - Q_MAX + 1), left - Q_MIN + 1):
            if s[j:left] in self.frequent:
                first = j
                break
        for j in range(min(len(s), right + Q_MAX - 1), right + Q_MIN - 1, -1):
            if s[right : j - 1] in self.tails:
                last = j
                break
        crossing = sum(start < right and end > left if left < right else start < left < end for start, end in grams)
        before = 0 if first is None else sum(start >= first and end <= left for start, end in grams)
        behind = 0 if last is None else sum(start >= right and end <= last for start, end in grams)
        return crossing + before + behind

    def bound(self, s: str, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit of the word can affect."""
        replaced = max(self.affected(s, grams, i, i + 1) for i in range(1, len(s) - 1))
        return max(replaced, max(self.affected(s, grams, i, i) for i in range(1, len(s))))

    def rarest(self, s: str, grams: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        return sorted(grams, key=lambda g: (self.frequent.get(s[g[0] : g[1]], 0), s[g[0] : g[1]], g[0]))[:n]

    def probes(self, s: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Variable grams through which a word is met, and grams of fixed length for words that the bound leaves nothing."""
        grams = self.cut(s)
        bound = self.bound(s, grams)
        if bound < len(grams):
            return self.rarest(s, grams, bound + 1), []
        fixed = [(i, i + Q_MIN) for i in range(len(s) - Q_MIN + 1)]
        return grams, self.rarest(s, fixed, Q_MIN + 1)


def probed(words: DataFrame, frequent: dict[str, int]) -> DataFrame:
    """``words`` with a row per gram through which it is met: start and end in the marked word, and the index."""
    kind = pa.list_(pa.struct({"fixed": pa.bool_(), "start": pa.int32(), "end": pa.int32()}))

    def cut(batches):
        grams = Grams(frequent)
        for batch in batches:
            rows = []
            for word in batch.column(0).to_pylist():
                variable, fixed = grams.probes(marked(word))
                rows.append([{"fixed": f, "start": a, "end": b} for f, found in ((False, variable), (True, fixed)) for a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], names=["word", "n", "probes"])

    rows = words.select("word", "n").mapInArrow(cut, "word string, n long, probes array<struct<fixed:boolean,start:int,end:int>>")
    return rows.select("word", "n", F.inline("probes"))


def lists(probes: DataFrame) -> DataFrame:
    """(key, longer, word, n): what another word has to agree with, for words of the same length and one code point shorter."""
    whole, size = F.concat(F.lit("\x01"), "word", F.lit("\x02")), F.length("word") + 2
    part = lambda a, b: F.substring(whole, a + 1, b - a)
    start, end, shorter = F.col("start"), F.col("end"), F.col("shorter")
    keys = []
    # The shared length of the rest is that of the shorter word; of its two halves one agrees.
    for head in (True, False):
        rest = shorter - end if head else shorter - (size - start)
        half = F.floor(rest / 2).cast("int")
        if head:
            agree = {"a": (F.lit(""), part(F.lit(0), end + half)), "z": (part(F.lit(0), end), part(size - (rest - half), size))}
        else:
            agree = {"a": (part(F.lit(0), half), part(start, size)), "z": (F.lit(""), part(start - (rest - half), size))}
        # A gram that takes more than the shorter word cannot be shared at that end.
        keys += [F.when(rest >= 0, F.xxhash64("fixed", F.lit(head), F.lit(side), "shorter", *parts)) for side, parts in agree.items()]
    rows = probes.withColumn("longer", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("shorter", size - F.col("longer").cast("int"))
    return rows.select("word", "n", "longer", F.explode(F.array_compact(F.array(*keys))).alias("key")).distinct()


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) once for each two stored ``words`` that differ by one edit; a is the shorter or lesser one."""
    met = stored(lists(probed(words, frequent_grams(words))), "lists")
    a = met.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = met.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    near = a.join(b, (a["key"] == b["key"]) & (F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return near.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for stored (word, form): forms followed to the last, by doubling the step in each round."""
    way = stored(forms.select("word", F.col("form").alias("root")), "way")
    while True:
        further = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(way.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "way")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        way = step.select("word", "root")


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    ``form``: the near word of largest n, at least ``ratio`` times the word's own
    (ties: the least); ``root``: where forms lead.
    """
    words = stored(counted(docs, least_length, least_count), "words")
    near = stored(near_pairs(words), "near")
    both = near.select(F.col("a").alias("word"), "n_a", "b", "n_b").union(near.select("b", "n_b", "a", "n_a")).toDF("word", "n", "other", "other_n")
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.max("n").alias("_own"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w"))).alias("_best")
    )
    is_form = -F.col("_best.n") >= ratio * F.col("_own")
    best = stored(
        best.select("word", "n_near", F.when(is_form, F.col("_best.w")).alias("form"), F.when(is_form, -F.col("_best.n")).alias("form_n")), "best"
    )
    ends = roots(best.where("form is not null"))
    rows = words.join(best, "word", "left").join(ends, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
