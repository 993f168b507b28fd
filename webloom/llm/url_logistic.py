"""URL verdicts: longest-match rules first, then a logistic regression on hashed character n-grams.

Host and path are read from the URL; n-grams of both, marked with where they
come from, are hashed into WIDTH columns. The regression is trained by full
gradient steps on a small labelled URL table, which holds no URL that a rule
decides: what rules say about their own hosts and paths tells nothing of others.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule and is judged by the regression's constant alone; repeated rows
are judged alike. Without labelled rows of both kinds nothing is blocked beyond
the rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.tokens import BYTE_VALUE, mix, salts, slices, utf8

WIDTH = 1 << 14
GRAMS = (2, 3, 4, 5)
STEPS = 300
HOST, PATH = salts(2, 53)

# (rule, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
# Labelled by hand: hosts and paths that no rule decides and that say what they hold, in all languages of the crawl.
BLOCKED = """
http://www.spam-farm.example.org/en/1 https://spam-farm.example.com/es/2 http://casino-bonus.example.org/win http://casino.example.com/es/bonus
https://online-casino.example.org/de/slots http://cheap-pills.example.com/buy http://pills.example.org/en/cheap https://buy-pills.example.com/fr/order
https://adult-xxx.example.org/videos http://xxx.example.com/en/videos https://xxx-videos.example.org/es/7 http://adult.example.com/fr/xxx
http://link-farm.example.com/en/links https://linkfarm.example.org/de/links/9 http://farm-of-links.example.com/es/links https://free-links.example.org/links/all
http://spam.example.org/click https://spam.example.com/en/12 http://click-spam.example.com/fr/3 https://m.spam-mail.example.org/es/44
https://free-money.example.com/offer http://money-offer.example.org/de/free https://fast-money.example.com/en/offer http://get-money.example.com/es/offer
http://torrent-warez.example.org/files https://warez.example.com/en/cracks http://free-warez.example.com/fr/cracks https://cracks.example.org/es/warez
http://best-offer.example.org/en/free-money https://offer-today.example.com/es/free https://free-prize.example.org/de/win http://win-prize.example.com/fr/free
http://xxx-adult.example.com/fr/adult https://adult-videos.example.org/de/xxx http://casino-win.example.org/es/casino https://spam-offer.example.org/de/click
http://warez-files.example.com/es/torrent https://torrent.example.org/en/warez http://pills-offer.example.org/es/pills https://cheap-links.example.com/fr/links
http://betting-slots.example.com/play https://slots.example.org/en/betting http://bet-casino.example.com/fr/play https://slots-casino.example.com/es/spin
"""
ALLOWED = """
https://library.example.org/en/catalogue https://www.library.example.com/fr/catalogue http://library.example.com/es/books https://library.example.org/de/books/3
https://www.university.example.com/en/courses http://university.example.org/de/courses/2 https://university.example.com/fr/lectures http://math.university.example.org/es/lectures
https://news.example.org/en/politics/1 http://www.news.example.com/fr/politics/20 https://news.example.org/es/sport/8 http://news.example.org/de/weather
https://docs.example.com/fr/guide https://docs.example.org/en/guide/4 http://docs.example.com/es/manual https://docs.example.org/de/manual/11
https://museum.example.org/de/works http://museum.example.com/en/works/5 https://www.museum.example.com/fr/works http://museum.example.org/es/visit
https://blog.example.com/en/2020/notes http://blog.example.org/de/2021/notes https://blog.theater.example.com/fr/77 http://blog.garden.example.org/es/12
https://m.example.org/es/articles/7 http://m.kitchen.example.com/en/recipes/9 https://m.river.example.org/de/31 http://m.mountain.example.com/fr/18
https://garden.example.org/es/articles http://theater.example.org/en/tickets https://river.example.com/fr/maps http://mountain.example.com/es/paths/4
https://kitchen.example.org/de/recipes http://school.example.com/fr/lectures/9 https://m.school.example.org/en/contact http://radio.example.com/es/news
https://hospital.example.org/de/visit http://city.example.com/en/contact https://m.city.example.com/fr/about http://park.example.org/es/about/2
https://www.example.com/en/about http://example.org/es/contact https://street.example.com/fr/50 http://www.forest.example.org/en/64
"""
LABELLED = tuple((url, verdict) for urls, verdict in ((BLOCKED, "block"), (ALLOWED, "allow")) for url in urls.split())


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    cases = []
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        cases.append((fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(None))


def columns_of(data: np.ndarray, offsets: np.ndarray, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed column of every n-gram."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    value = BYTE_VALUE[data]
    rows, cols = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for j in range(n):
            h = mix(h + value[j : len(data) - n + 1 + j])
        inside = doc[: len(h)] == doc[n - 1 :]
        rows.append(doc[: len(h)][inside])
        cols.append((mix(h[inside] ^ salt) % np.uint64(WIDTH)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def features(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with host and path, and of their n-grams row, column and weight; a row's weights have length 1 or less."""
    joined = pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(batch.num_rows))], [*batch.schema.names, "_at"])
    for rows, data, offsets in slices(joined, "host"):
        parts = [columns_of(data, offsets, HOST), columns_of(*utf8(rows.column("path")), PATH)]
        at, col = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        count = np.bincount(at, minlength=rows.num_rows)
        yield rows, at, col, 1 / np.sqrt(np.maximum(1, count))[at]


def train(table: list[tuple[str, str, int]], steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and constant for rows (host, path, 1 if blocked)."""
    y = np.array([t[2] for t in table], float)
    if len(set(y)) < 2:
        return np.zeros(WIDTH), -1.0
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in table]), pa.array([t[1] for t in table])], ["host", "path"])
    found = [(rows.column("_at").to_numpy()[at], col, w) for rows, at, col, w in features(batch)]
    at, col, w = (np.concatenate([f[i] for f in found]) for i in range(3))
    # Both verdicts weigh the same.
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    weights, constant, speed, push = np.zeros(WIDTH), 0.0, np.zeros(WIDTH), 0.0
    for _ in range(steps):
        z = np.bincount(at, weights[col] * w, minlength=len(y)) + constant
        error = (1 / (1 + np.exp(-z)) - y) * each
        slope = np.bincount(col, error[at] * w, minlength=WIDTH) + 1e-5 * weights
        speed, push = 0.9 * speed - 4.0 * slope, 0.9 * push - 0.4 * error.sum()
        weights, constant = weights + speed, constant + push
    return weights, constant


def judged(pages: DataFrame, labelled: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's ``p_block`` of every page (page_id, url).

    ``labelled`` (url, verdict) is collected: it must be a small table.
    """
    parts = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "verdict")
    table = [(r["host"], r["path"], int(r["verdict"] == "block")) for r in parts.orderBy("host", "path", "verdict").collect()]
    held = pages.sparkSession.sparkContext.broadcast(train(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, constant = held.value
        for batch in batches:
            for rows, at, col, w in features(batch):
                z = np.bincount(at, weights[col] * w, minlength=rows.num_rows) + constant
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("page_id", "host", "path")), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                    ["page_id", "host", "path", "p_block"],
                )

    url = F.col("url").cast("string")
    scored = pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path")).mapInArrow(
        run, "page_id long, host string, path string, p_block double"
    )
    found = scored.withColumn("_r", longest_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", own).alias("verdict"), "p_block")


def labels(spark: SparkSession, rows=LABELLED) -> DataFrame:
    """The labelled table (url, verdict)."""
    return spark.createDataFrame(list(rows), "url string, verdict string")
