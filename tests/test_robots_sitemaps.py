import gzip
import random
import re

from pyspark.sql import functions as F

from webloom.operators import robots as R
from webloom.operators import sitemaps as M
from webloom.sources.robots import parse_robots, robots_rules
from webloom.sources.sitemaps import parse_lastmod, parse_sitemaps

BODY = """# comment
Sitemap: https://e.com/early.xml
User-agent: *
Disallow: /private
Disallow:
ALLOW: /private/open
Crawl-delay: 5
Sitemap: https://e.com/map.xml

User-agent: Bot
Request-rate: 2/9
Crawl-delay: x
Disallow: /api/*/delete$
Disallow: /a.b
User-agent: one
User-agent: two
Disallow: /two
"""


def bodies(spark, *rows):
    return spark.createDataFrame(list(rows), "origin string, body string, status int")


def allowed(spark, agent, *paths, body=BODY, rfc=False):
    robots = parse_robots(bodies(spark, ("https://e.com", body, 200)), agent, rfc)
    urls = spark.createDataFrame([(i, f"https://e.com{p}") for i, p in enumerate(paths)], "i int, url string")
    return [r.allowed for r in R.robots_verdict(urls, robots).orderBy("i").collect()]


def test_verdicts(spark):
    assert allowed(spark, "other", "/", "/private/x", "/private/open/x", "/privat") == [True, False, True, True]
    assert allowed(spark, "BOT", "/private", "/api/1/delete", "/api/1/delete/x", "/a.b", "/axb", "/api/1/delete?x=1") == [
        True, False, True, False, True, False,
    ]
    # The decoded path counts; a plus sign stays.
    assert allowed(spark, "x", "/%70rivate", "/a+b", body="User-agent: *\nDisallow: /private\nDisallow: /a+b") == [False, False]


def test_several_agent_lines(spark):
    assert allowed(spark, "one", "/two") == [True] and allowed(spark, "two", "/two") == [False]
    assert allowed(spark, "one", "/two", rfc=True) == [False] and allowed(spark, "two", "/two", rfc=True) == [False]


def test_ties_and_specificity(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a\nAllow: /b\nDisallow: /b/c"
    assert allowed(spark, "x", "/a", "/b/c", "/b/d", body=body) == [True, False, True]


def by_pattern(path, rules):
    """Verdict of (kind, pattern) rules, each as one regular expression."""
    best = (-1, True)
    for kind, pattern in rules:
        body, end = (pattern[:-1], r"\Z") if pattern.endswith("$") else (pattern, "")
        if "\n" not in path and re.match(".*".join(map(re.escape, body.split("*"))) + end, path):
            best = max(best, (len(pattern), kind == "allow"))
    return best[1]


def test_lists_and_rows_of_rules_agree_with_patterns(spark, monkeypatch):
    dice = random.Random(3)
    text = lambda n, of: "".join(dice.choice(of) for _ in range(dice.randrange(n)))
    rules = {(dice.choice(["allow", "disallow"]), dice.choice(["/", "", "*"]) + text(5, "ab/*") + dice.choice(["", "", "$", "$a"])) for _ in range(150)}
    rules = sorted(r for r in rules if r[1])
    paths = sorted({"/" + text(8, "ab/$") for _ in range(400)} | {"/", "/a\nb"})
    body = "User-agent: *\n" + "\n".join(f"{kind}: {pattern}" for kind, pattern in rules)
    robots = parse_robots(bodies(spark, ("https://e.com", body, 200), ("https://f.com", "User-agent: *\nDisallow: /a", 200)), "x")
    urls = spark.createDataFrame(
        [(i, f"https://{h}.com{p}".replace("\n", "%0A"), h, p) for i, (h, p) in enumerate([(h, p) for h in "efg" for p in [*paths, paths[3]]])]
        + [(-1, None, "n", "/"), (-2, "no url", "n", "/")],
        "i int, url string, h string, p string",
    )
    of = {"e": rules, "f": [("disallow", "/a")], "g": [], "n": []}
    want = {r.i: by_pattern(r.p, of[r.h]) for r in urls.collect()}
    assert len(set(want.values())) == 2
    for listed in (1000, 64, 0):
        monkeypatch.setattr(R, "LISTED_RULES", listed)
        verdicts = R.robots_verdict(urls, robots)
        assert set(verdicts.columns) == {"i", "url", "h", "p", "origin", "allowed"}
        rows = verdicts.collect()
        assert len(rows) == len(want) and {r.i: r.allowed for r in rows} == want, listed


def test_origin_fields(spark):
    df = parse_robots(
        bodies(spark, ("a", BODY, 200), ("b", None, 404), ("c", None, 0), ("d", None, None), ("e", "Disallow: /", 200), ("f", BODY.replace("\n", "\r\n"), 200)),
        "bot",
    )
    got = {r.origin: (r.crawl_delay, r.sitemaps, r.fetch_status, r.rules is None) for r in df.collect()}
    assert got["a"] == (4.5, ["https://e.com/map.xml"], "ok", False) == got["f"]
    assert got["b"][2:] == ("http_404", True)
    assert got["c"][2:] == ("fetch_failed", True)
    assert got["d"][2:] == ("not_checked", True)
    # Rules before any agent line belong to nobody.
    assert got["e"][2:] == ("ok", True)
    assert robots_rules(df).where("origin = 'a'").count() == 2
    assert {r.state: r.origins for r in R.robots_status(df).collect()} == {"ok": 4, "failed": 1, "not_checked": 1}


def test_delay_limits(spark):
    rows = [(str(d), f"User-agent: *\nCrawl-delay: {d}", 200) for d in ("0", "-1", "3600", "3601", "nan", "1e2", " 2 ")]
    got = {r.origin: r.crawl_delay for r in parse_robots(bodies(spark, *rows), "x").collect()}
    assert got == {"0": None, "-1": None, "3600": 3600.0, "3601": 3601.0, "nan": None, "1e2": 100.0, " 2 ": 2.0}


def test_long_body(spark):
    head = "User-agent: *\nDisallow: /x\n"
    body = head + "#" + "é" * 300_000 + "\nDisallow: /late"
    assert allowed(spark, "x", "/x", "/late", body=body) == [False, False]


URLSET = """<?xml version="1.0" encoding="UTF-8"?>
<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:i="http://x/i">
<url><loc> https://e.com/a?b=1&amp;c=2 </loc><lastmod>2024-05-01</lastmod><changefreq> Weekly</changefreq><priority>1.7</priority></url>
<url><i:loc>https://e.com/no</i:loc></url><url><loc></loc></url>
<url><loc>https://e.com/sitemapindex</loc><changefreq>often</changefreq><priority>nan</priority></url></urlset>"""
INDEX = "<sitemapindex><sitemap><loc>https://e.com/1.xml</loc><lastmod>2024-05-01T10:00:00+02:00</lastmod></sitemap></sitemapindex>"


def test_sitemaps(spark):
    rows = [
        ("plain", URLSET.encode()),
        ("gzip", gzip.compress(URLSET.encode())),
        ("index", INDEX.encode()),
        ("broken", URLSET.replace("</urlset>", "").encode()),
        ("not gzip", b"\x1f\x8bxx"),
        ("members", gzip.compress(URLSET[:200].encode()) + gzip.compress(URLSET[200:].encode())),
        ("empty", b""),
    ]
    got = {}
    for r in parse_sitemaps(spark.createDataFrame(rows, "url string, body binary")).collect():
        got.setdefault(r.sitemap_url, []).append((r.kind, r.loc, str(r.lastmod), r.changefreq, r.priority))
    entries = [
        ("urlset", "https://e.com/a?b=1&c=2", "2024-05-01 00:00:00", "weekly", 1.0),
        ("urlset", "https://e.com/sitemapindex", "None", None, None),
    ]
    assert got["plain"] == got["gzip"] == got["members"] == got["broken"] == entries
    assert got["index"] == [("index", "https://e.com/1.xml", "2024-05-01 08:00:00", None, None)]
    assert set(got) == {"plain", "gzip", "members", "index", "broken"}


def test_lastmod(spark):
    cases = [
        ("2024-05-01", "2024-05-01 00:00:00"),
        ("2024-05-01T10:00:00", "2024-05-01 10:00:00"),
        ("2024-05-01 10:00:00.5Z", "2024-05-01 10:00:00.5"),
        ("2024-05-01T10:00:00-0330", "2024-05-01 13:30:00"),
        ("Wed, 01 May 2024 10:00:00 GMT", "2024-05-01 10:00:00"),
        ("1 May 2024 10:00:00 +0100", "2024-05-01 09:00:00"),
        ("2024-13-01", None),
        ("soon", None),
    ]
    df = spark.createDataFrame(cases, "t string, expected string")
    wrong = df.withColumn("got", parse_lastmod(F.col("t"))).where("NOT (got <=> CAST(expected AS TIMESTAMP))")
    assert [tuple(r) for r in wrong.collect()] == []


def test_expand_depth_and_loops(spark):
    rows = [("s", "index", "m"), ("m", "index", "l"), ("m", "index", "s"), ("l", "index", "deep"), ("l", "urlset", "u1"), ("deep", "urlset", "u2"), ("s", "urlset", "u0")]
    entries = spark.createDataFrame(rows, "sitemap_url string, kind string, loc string")
    seeds = spark.createDataFrame([("s",)], "sitemap_url string")
    assert sorted(r.loc for r in M.sitemap_expand(entries, seeds).collect()) == ["u0", "u1", "u2"]
    assert sorted(r.loc for r in M.sitemap_expand(entries, seeds, 2).collect()) == ["u0", "u1"]


def test_seed_cap(spark):
    rows = [(f"m{i % 3}", i, f"https://e.com/{i}") for i in range(30)] + [("m0", 99, "ftp://x"), ("m0", 98, "https://e.com:x/")]
    entries = spark.createDataFrame(rows, "sitemap_url string, position int, loc string")
    got = [r.url for r in M.sitemap_seed(entries, cap=12).orderBy("sitemap_url", "position").collect()]
    assert got == [f"https://e.com/{i}" for i in [*range(0, 30, 3), 1, 4]]


def test_many_robots_lines(spark):
    """Plain rules are compared as text: the longest match of 5000 lines, with wildcards among them."""
    lines = [("disallow" if i % 3 else "allow", f"/d{i % 700}/{i}") for i in range(5000)] + [("disallow", "/d1/*.pdf$"), ("allow", "/d2/*/ok"), ("disallow", "/d2"), ("disallow", "*z")]
    body = "user-agent: *\n" + "\n".join(f"{kind}: {p}" for kind, p in lines)
    robots = parse_robots(spark.createDataFrame([("https://a.com", body, 200)], "origin string, body string, status int"), "me")
    paths = [f"/d{i % 701}/{i}{tail}" for i in range(0, 5000, 97) for tail in ("", "7", "/x.pdf", "/ok", "z", "%0Az")]
    urls = spark.createDataFrame([(f"https://a.com{p}",) for p in paths], "url string")
    got = {r.url: r.allowed for r in R.robots_verdict(urls, robots).collect()}
    for p in paths:
        path, best = p.replace("%0A", "\n"), (0, True)
        for kind, rule in lines:
            pattern = re.escape(rule.removesuffix("$")).replace("\\*", ".*") + ("\\Z" if rule.endswith("$") else ".*\\Z")
            if re.match(pattern, path):
                best = max(best, (len(rule), kind == "allow"))
        assert got[f"https://a.com{p}"] == best[1], p
