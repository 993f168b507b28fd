"""Quality rules whose limits follow the data: quantile sketches per language and source.

Each rule is a rate per 1000 words or lines. Its distribution in a group (a
language and a source) is kept as a sketch: counts in bins whose width grows
with the value, 16 to each doubling. Sketches merge by adding counts, so they
are built with partial sums whatever the size of a group, and the sketch of a
language or of everything is the sum of its groups' sketches. A group's own
sketch is merged with that of its language at the weight of PRIOR documents, and
the language's with that of everything likewise, whatever their sizes: a small
group leans on its language, a large one on itself, and no number of documents
switches from one to the other. The limit is the upper quartile plus SPREADS
interquartile ranges and the rule's slack.

Documents and limits meet in one join. Everything is in built-in functions.
Equal windows of words are found by a 64-bit hash.

Defined results: null and empty texts have all counts 0, fail the base rule and
are left out of the sketches; null languages and sources are groups like any
other; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.session import stored

WORD = r"[^\x20\x09-\x0D]+"
SPREADS = 3
# Documents that the sketch above counts for, and parts of a document that weights are rounded to.
PRIOR, UNIT = 100, 1_000_000
# (rule, numerator, denominator, slack): a rate per 1000 may pass the quartiles by the slack at least.
RULES = (
    ("word_length", "word_chars", "n_words", 2000),
    ("symbols", "n_symbols", "n_words", 150),
    ("marks", "n_marks", "n_words", 300),
    ("dup_lines", "n_dup_lines", "n_lines", 300),
    ("repeats", "n_repeat_words", "n_words", 250),
)


def repeat_words(list_name: str) -> tuple[Column, Column, Column]:
    """Three steps, each reading the one before: sorted windows, places of repeated ones, words they cover."""
    w = F.col(list_name)
    begin = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    ordered = F.array_sort(F.transform(begin, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))
    s = F.col("_sorted")
    n = F.greatest(F.size(s) - 1, F.lit(0))
    twins = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    places = F.array_sort(F.array_distinct(F.flatten(twins)))
    p = F.col("_places")
    later = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.array(F.lit(2**30)))
    covered = F.aggregate(F.zip_with(p, later, lambda a, b: F.least(b - a, F.lit(3))), F.lit(0), lambda x, y: x + F.coalesce(y, F.lit(0)))
    return ordered, places, F.when(F.size(p) > 0, covered).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document (doc_id, text, lang, source)."""
    text = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    cut = text.withColumn("_w", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("_lines", lines)
    ordered, places, covered = repeat_words("_w")
    steps = cut.withColumn("_sorted", ordered).withColumn("_places", places)
    counts = steps.select(
        "doc_id", "lang", "source",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"!")).cast("bigint").alias("n_marks"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.withColumn("base_failed", failed)


def rate(top: str, bottom: str) -> Column:
    return F.floor(1000 * F.col(top) / F.greatest(F.col(bottom), F.lit(1))).cast("bigint")


def bin_of(value: Column) -> Column:
    shift = F.greatest(F.length(F.bin(value)) - 5, F.lit(0))
    return shift * 16 + F.call_function("shiftright", value, shift)


def top_of(bin_number: Column) -> Column:
    """The largest value of a bin."""
    shift = F.greatest(F.floor(bin_number / 16).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", bin_number - shift * 16 + 1, shift) - 1


def sketched(counts: DataFrame) -> DataFrame:
    """(lang, source, rule, bin, n): the sketch of every group and rule."""
    rates = F.array(*[F.struct(F.lit(name).alias("rule"), bin_of(rate(a, b)).cast("bigint").alias("bin")) for name, a, b, _ in RULES])
    each = counts.where("n_words > 0").select("lang", "source", F.explode(rates).alias("r"))
    return each.groupBy("lang", "source", "r.rule", "r.bin").agg(F.count(F.lit(1)).alias("n"))


def priors(sketch: DataFrame) -> DataFrame:
    """(lang, rule, prior): the weight that each bin of a language's sketch, merged with that of everything, lends to a group."""
    everything = sketch.groupBy("rule", "bin").agg(F.sum("n").alias("all_n"))
    everything = everything.withColumn("all_docs", F.sum("all_n").over(Window.partitionBy("rule")))
    own = sketch.groupBy("lang", "rule", "bin").agg(F.sum("n").alias("n"))
    docs = own.groupBy("lang", "rule").agg(F.sum("n").alias("docs"))
    # Every language has all bins that occur; bins are some hundreds.
    bins = docs.join(everything, "rule").alias("b").join(own.alias("o"), (F.col("b.rule") == F.col("o.rule")) & (F.col("b.bin") == F.col("o.bin")) & F.col("b.lang").eqNullSafe(F.col("o.lang")), "left")
    weight = F.floor(F.lit(float(PRIOR * UNIT)) * (F.coalesce("o.n", F.lit(0)) + (PRIOR * F.col("b.all_n")).cast("double") / F.col("b.all_docs")) / (F.col("b.docs") + PRIOR))
    rows = bins.select("b.lang", "b.rule", F.struct(F.col("b.bin").alias("bin"), weight.cast("bigint").alias("w")).alias("e"))
    return rows.groupBy("lang", "rule").agg(F.collect_list("e").alias("prior"))


def limits(sketch: DataFrame) -> DataFrame:
    """A row per group (g_lang, g_source) with a limit for each rule."""
    own = sketch.groupBy("lang", "source", "rule").agg(F.collect_list(F.struct("bin", (F.col("n") * UNIT).alias("w"))).alias("own"))
    o, p = own.alias("o"), priors(sketch).alias("p")
    joined = o.join(p, F.col("o.lang").eqNullSafe(F.col("p.lang")) & (F.col("o.rule") == F.col("p.rule")))
    sorted_bins = F.array_sort(F.concat("own", "prior"))
    merged = joined.select(F.col("o.lang").alias("g_lang"), F.col("o.source").alias("g_source"), F.col("o.rule").alias("rule"), sorted_bins.alias("bins"))
    total = F.aggregate("bins", F.lit(0).cast("bigint"), lambda n, e: n + e["w"])
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q3"))

    def step(s: Column, e: Column) -> Column:
        upto = s["upto"] + e["w"]
        reached = lambda part: F.when(upto * 4 >= F.col("docs") * part, e["bin"])
        return F.struct(upto.alias("upto"), F.coalesce(s["q1"], reached(1)).alias("q1"), F.coalesce(s["q3"], reached(3)).alias("q3"))

    quarters = merged.withColumn("docs", total).withColumn("q", F.aggregate("bins", start, step))
    q1, q3 = (top_of(F.col(f"q.{q}")) for q in ("q1", "q3"))
    slack = F.create_map(*[F.lit(x) for name, _, _, s in RULES for x in (name, s)])
    capped = quarters.select("g_lang", "g_source", "rule", (q3 + SPREADS * (q3 - q1) + slack[F.col("rule")]).alias("most"))
    return capped.groupBy("g_lang", "g_source").agg(*[F.max(F.when(F.col("rule") == name, F.col("most"))).alias(f"most_{name}") for name, *_ in RULES])


def judged(docs: DataFrame) -> DataFrame:
    """The counts of every document, base_failed and kept."""
    counts = stored(measured(docs), "counts")
    bounds = stored(limits(stored(sketched(counts), "rule_sketches")), "limits")
    fits = counts.join(bounds, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    fine = F.lit(True)
    for name, a, b, _ in RULES:
        fine = fine & (rate(a, b) <= F.col(f"most_{name}"))
    return fits.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(False)))
