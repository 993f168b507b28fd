"""Sitemap bodies (plain or gzip) as a relation of entries."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html import unescape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as X

# The known change frequencies.
CHANGE_FREQUENCIES = ("always", "hourly", "daily", "weekly", "monthly", "yearly", "never")

_PARTS = ("loc", "lastmod", "changefreq", "priority")
_RAW = pa.schema([("sitemap_url", pa.string()), ("kind", pa.string()), ("position", pa.int32())] + [(p, pa.string()) for p in _PARTS])
_BATCH_ROWS = 50_000


def _by_tags(text: str) -> tuple[str, list[dict]]:
    """Entries of a body that is not well-formed XML."""
    kind = "index" if re.search(r"<sitemapindex[\s>]", text) else "urlset"
    item = "sitemap" if kind == "index" else "url"
    rows = []
    for block in re.findall(rf"<{item}(?:\s[^>]*)?>(.*?)</{item}>", text, re.S):
        found = {p: re.search(rf"<{p}(?:\s[^>]*)?>(.*?)</{p}>", block, re.S) for p in _PARTS}
        rows.append({p: unescape(m[1]) if m else None for p, m in found.items()})
    return kind, rows


def _unpacked(body: bytes) -> bytes:
    """All members of a gzip body; of a broken one what comes before the fault."""
    out = []
    while body[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(zlib.MAX_WBITS | 16)
        try:
            out.append(member.decompress(body))
        except zlib.error:
            break
        body = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _entries(body: bytes) -> tuple[str, list[dict]]:
    if body[:2] == b"\x1f\x8b":
        body = _unpacked(body)
    try:
        root = ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return _by_tags(body.decode("utf-8", "replace"))
    space = root.tag.rpartition("}")[0] + "}" if root.tag.startswith("{") else ""
    kind = "index" if root.tag == space + "sitemapindex" else "urlset"
    rows = []
    for item in root.iter(space + ("sitemap" if kind == "index" else "url")):
        found = {p: next(item.iter(space + p), None) for p in _PARTS}
        rows.append({p: None if e is None else "".join(e.itertext()) for p, e in found.items()})
    return kind, rows


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[dict] = []
        for url, body in zip(batch.column("url").to_pylist(), batch.column("body").to_pylist(), strict=True):
            kind, rows = _entries(body or b"")
            for position, row in enumerate(rows):
                if kind == "index":
                    row["changefreq"] = row["priority"] = None
                out.append({"sitemap_url": url, "kind": kind, "position": position, **row})
                if len(out) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=_RAW)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=_RAW)


def parse_lastmod(c: Column) -> Column:
    """ISO dates and times with fraction and zone, else RFC 2822; no zone means UTC."""
    c = X.strip_space(c)
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?([+-]\d{2}:?\d{2}|Z)?)?$"
    zoned = F.regexp_replace(c, r"([+-]\d{2})(\d{2})$", "$1:$2")
    zoned = F.when(c.rlike(r"\d[+-]\d{4}$"), zoned).otherwise(c)
    mail = F.regexp_replace(F.regexp_replace(c, r"^[A-Za-z]+,\s*", ""), r"(GMT|UTC?|Z)$", "+0000")
    rfc = F.coalesce(
        F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss"))
    )
    return F.when(c.rlike(iso), zoned.try_cast("timestamp")).otherwise(rfc)


def parse_sitemaps(bodies: DataFrame) -> DataFrame:
    """Entries of ``bodies(url, body BINARY)``; entries without loc are left out."""
    raw = bodies.select("url", "body").mapInArrow(
        _read_batches,
        "sitemap_url STRING, kind STRING, position INT, loc STRING, lastmod STRING, changefreq STRING, priority STRING",
    )
    freq = F.lower(X.strip_space(F.col("changefreq")))
    number = X.strip_space(F.col("priority")).try_cast("double")
    return raw.select(
        "sitemap_url",
        "kind",
        "position",
        X.strip_space(F.col("loc")).alias("loc"),
        parse_lastmod(F.col("lastmod")).alias("lastmod"),
        F.when(freq.isin(*CHANGE_FREQUENCIES), freq).alias("changefreq"),
        F.when(number.isNotNull() & ~F.isnan(number), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).alias("priority"),
    ).where(F.col("loc") != "")


def read_sitemaps(spark, path: str) -> DataFrame:
    """Entries of stored sitemap files; the file path is the sitemap's URL."""
    files = spark.read.format("binaryFile").load(path)
    return parse_sitemaps(files.select(F.col("path").alias("url"), F.col("content").alias("body")))
