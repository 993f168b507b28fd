import json
import random
import re

import pytest

from pyspark.sql import functions as F

from webloom.functions.html import compile_selector
from webloom.operators import rules as R
from webloom.plans.records import crawl_records, saved_records
from webloom.sources import rules as S

GOOD = {
    "name": "a",
    "match": {"domains": ["A.com."], "url_pattern": "^/x"},
    "fields": {"t": {"selector": "h1", "fallback": ["h2", {"selector": "h3", "extract": "attr", "attr": "id"}], "transform": {"regex": "(x+)"}}},
}


def doc(**changes):
    return json.dumps({**GOOD, **changes})


def field(**changes):
    return doc(fields={"t": {"selector": "p", **changes}})


def nested(n):
    return json.loads("[" * n + "1" + "]" * n)


DOCS = [
    (doc(), "pass", None),
    ("﻿" + doc(), "pass", None),
    (doc(tags=nested(19)), "pass", None),
    ("", "skip", "empty file"),
    (doc(tags=nested(40)), "pass", None),
    ('{"name": "a"}', "skip", "no fields key"),
    ("{", "fail", "not valid JSON or repeated keys"),
    ('{"name": "a", "name": "b", "fields": {}}', "fail", "not valid JSON or repeated keys"),
    ("[1]", "fail", "not an object"),
    (doc(schema_version=3), "fail", "schema_version is not supported"),
    (doc(name=" "), "fail", "name is empty"),
    (doc(name="default"), "fail", "name is reserved"),
    (doc(name="n" * 65), "pass", None),
    (doc(name="Big"), "fail", "name has other characters"),
    (doc(enabled="true"), "fail", "enabled is not a boolean"),
    (doc(version=0), "fail", "version is not valid"),
    (doc(version="1"), "fail", "version is not valid"),
    (doc(match=[]), "fail", "match is not an object"),
    (doc(match={"domains": ["nodot"]}), "fail", "a domain is malformed"),
    (doc(match={"url_pattern": "(a"}), "fail", "url_pattern is not accepted"),
    (doc(match={"url_pattern": "(?!a)b"}), "fail", "url_pattern is not accepted"),
    (doc(match={"url_pattern": r"(a)\1"}), "fail", "url_pattern is not accepted"),
    (doc(match={"url_pattern": "(?P<n>a)"}), "pass", None),
    (doc(match={"scope": "some"}), "fail", "scope is unknown"),
    (doc(match={"scope": "domain_all"}), "fail", "scope needs domains"),
    (doc(match={"scope": "any", "domains": ["a.com"]}), "fail", "scope excludes domains"),
    (doc(match={"scope": "domain_pattern", "domains": ["a.com"]}), "fail", "scope needs url_pattern"),
    (doc(fields=[]), "fail", "fields is not an object"),
    (doc(fields={f"f{i}": {"selector": "a"} for i in range(1200)}), "pass", None),
    (doc(fields={"f" * 65: {"selector": "a"}}), "pass", None),
    (doc(fields={"": {"selector": "a"}}), "fail", "a field name is empty"),
    (doc(fields={"url": {"selector": "a"}}), "fail", "a field name is reserved"),
    (doc(fields={"t": "p"}), "fail", "field t is not an object"),
    (field(selector=""), "fail", "field t selector is empty"),
    (field(extract="json"), "fail", "field t extract is unknown"),
    (field(extract="attr"), "fail", "field t attr is missing or malformed"),
    (field(multiple=1), "fail", "field t multiple is not a boolean"),
    (field(fallback=["a", "b", "c"]), "pass", None),
    (field(fallback=[{"selector": "a", "fallback": ["b"]}]), "fail", "field t fallback is nested"),
    (field(fallback=[1]), "fail", "field t fallback is malformed"),
    (field(transform={"regex": "(?<=a)b"}), "fail", "field t regex is not accepted"),
    (field(multiple=True, transform={"regex": "a"}), "fail", "field t multiple does not allow regex or replace"),
    (field(transform={"unknown": 1, "join": 2}), "pass", None),
    (doc(options=1), "fail", "options is not an object"),
]


def test_documents(spark):
    rows = [("user", str(i), d[0]) for i, d in enumerate(DOCS)]
    _, report = S.load_rules(spark.createDataFrame(rows, "source string, path string, content string"))
    for r in report.collect():
        assert (r.status, r.error) == DOCS[int(r.path)][1:], DOCS[int(r.path)][0][:200]


def test_loaded_rule(spark):
    rules, _ = S.load_rules(spark.createDataFrame([("user", "p", doc())], "source string, path string, content string"))
    r = rules.first().asDict(recursive=True)
    assert (r["name"], r["version"], r["scope"], r["domains"], r["url_pattern"]) == ("a", 1, "domain_pattern", ["a.com"], "^/x")
    assert r["fields"]["t"]["fallback"] == [
        {"selector": "h2", "extract": "text", "attr": ""},
        {"selector": "h3", "extract": "attr", "attr": "id"},
    ]
    assert (r["keep_body_text"], r["follow_links"], r["enabled"]) == (False, True, True)


def test_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.json").write_text(doc(), encoding="utf-8")
    (tmp_path / "note.txt").write_text("{}")
    docs = S.read_rule_files(spark, {"user": str(tmp_path)})
    assert [(r.source, r.path.endswith("deep/a.json")) for r in docs.collect()] == [("user", True)]


def test_answers(spark):
    rows = [(1, f"Sure:\n```json\n{doc()}\n```"), (2, doc()), (3, "no"), (4, f"```\n{doc(name='default')}\n```")]
    got = S.ingest_answers(spark.createDataFrame(rows, "id bigint, content string"))
    assert {r.id: (r.accepted, r.error) for r in got.collect()} == {
        1: (True, None),
        2: (True, None),
        3: (False, "not valid JSON or repeated keys"),
        4: (False, "name is reserved"),
    }


def rules(spark, *rows):
    ddl = "name string, scope string, domains array<string>, url_pattern string, version int, source string, enabled boolean"
    return spark.createDataFrame([(*r, True)[:7] if len(r) == 6 else r for r in rows], ddl)


def test_match_order(spark):
    snapshot = rules(
        spark,
        ("exact", "domain_all", ["a.example.com"], "", 1, "user"),
        ("suffix", "domain_pattern", ["example.com"], "^/de/", 9, "user"),
        ("suffix-long", "domain_pattern", ["example.com"], "^/de/[0-9]+", 1, "user"),
        ("old", "domain_all", ["example.org"], "", 1, "pip"),
        ("new", "domain_all", ["example.org"], "", 2, "user"),
        ("same-b", "domain_all", ["example.net", "www.example.net"], "", 1, "user"),
        ("same-a", "domain_all", ["example.net"], "", 1, "user"),
        ("same-pip", "domain_all", ["example.net"], "", 1, "pip"),
        ("any", "any", [], "", 1, "user"),
        ("query", "global_pattern", [], r"\?x=1", 1, "user"),
        ("off", "any", [], "", 99, "pip", False),
    )
    urls = {
        "https://a.example.com/de/1": ["exact", "suffix-long", "suffix", "any"],
        "https://b.example.com/de/x": ["suffix", "any"],
        "https://example.org/": ["new", "old", "any"],
        "https://www.example.net/p?x=1": ["same-b", "same-pip", "same-a", "query", "any"],
        "https://notexample.com/": ["any"],
        "not a url": ["any"],
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    # As one short list, and by joins on hosts and paths.
    for few in (R.FEW_RULES, 0):
        got = {r.url: r.candidates for r in R.rule_match(df, snapshot, few).collect()}
        assert got == urls
    none = R.rule_match(df, snapshot.where("name = 'off'")).collect()
    assert {(r.rule, len(r.candidates)) for r in none} == {("default", 0)}


def test_rank_and_caps(spark):
    rows = [(f"g{i}", "any", [], "", i, "user") for i in range(1, 6)] + [("d", "domain_all", ["a.com"], "", 1, "user"), ("p", "global_pattern", [], "abc", 1, "user")]
    ranked = R.rule_rank(rules(spark, *rows), max_total=6, max_generic=3).orderBy("rank")
    assert [r.name for r in ranked.collect()] == ["d", "p", "g5", "g4"]


def test_transform(spark):
    ddl = "id int, v array<string>, m boolean, t struct<strip:boolean,strip_currency:boolean,regex:string,replace_from:string,replace_to:string,join:string>"

    def t(**kw):
        return tuple(kw.get(k) for k in ("strip", "strip_currency", "regex", "replace_from", "replace_to", "join"))

    cases = [
        (["  a　"], False, t(strip=True), ["a"]),
        (["R$ 5,00 €"], False, t(strip_currency=True), ["5,00"]),
        (["price 12 now"], False, t(regex=r"(\d+) (now)"), ["12"]),
        (["price 12"], False, t(regex=r"\d+"), ["12"]),
        (["price 12"], False, t(regex=r"[(]|\(|\d+"), ["12"]),
        (["price 12"], False, t(regex=r"(?P<n>\d)\d"), ["1"]),
        (["none"], False, t(regex=r"\d+"), None),
        (["aXb"], False, t(replace_from="X", replace_to="-"), ["a-b"]),
        (["aXb"], False, t(replace_from="X", replace_to="y" * 50), ["a" + "y" * 50 + "b"]),
        (["a", "b"], True, t(join=", "), ["a, b"]),
        (["a1", "b"], True, t(regex=r"\d", replace_from="a", replace_to="z"), ["a1", "b"]),
        ([], True, t(join=","), [""]),
        (None, True, t(join=","), None),
        (["abc"], False, t(join=","), ["abc"]),
    ]
    df = spark.createDataFrame([(i, c[0], c[1], c[2]) for i, c in enumerate(cases)], ddl)
    out = df.select("id", R.transform_value(F.col("v"), F.col("m"), F.col("t")).alias("out")).orderBy("id")
    assert [r.out for r in out.collect()] == [c[3] for c in cases]


def test_records(spark):
    spec = {"h": {"selector": "h1"}, "ps": {"selector": "p", "multiple": True, "transform": {"join": "|"}}, "x": {"selector": "a:hover"}}
    documents = [
        ("user", "1", json.dumps({"name": "shop", "match": {"domains": ["shop.com"]}, "fields": spec, "options": {"follow_links": False}})),
        ("user", "2", json.dumps({"name": "empty", "match": {"domains": ["empty.com"]}, "fields": {"x": {"selector": "table"}}})),
    ]
    snapshot, _ = S.load_rules(spark.createDataFrame(documents, "source string, path string, content string"))
    html = "<title>T</title><h1> H  1</h1><p>a</p><p>b</p><a href='/l'>l</a>"
    pages = [
        (1, "https://www.shop.com/a", html), (2, "https://empty.com/a", html), (3, "https://other.com/a", html),
        (4, "https://shop.com/b", html), (5, "https://other.com/b", "<meta name=robots content=noindex>" + html), (6, "https://other.com/c", ""),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in saved_records(crawl_records(df, snapshot)).collect()}
    assert got[1].extraction_type == "shop" and got[1].text == "" and got[1].anchors == []
    assert got[1].fields == {"h": ["H 1"], "ps": ["a|b"], "x": None}
    assert got[2].extraction_type == "default" and got[2].fields == {} and got[2].text.startswith("T\nH  1")
    assert len(got[3].anchors) == 1 and got[3].url == "https://other.com/a"
    # A page served by a rule is a run of it; pages of the default type are none.
    assert {k: (r.fields_filled, r.fields_total) for k, r in got.items()} == {1: (2, 3), 2: (0, 0), 3: (0, 0), 4: (2, 3), 5: (0, 0), 6: (0, 0)}
    stats = R.rule_stats(R.rule_runs(crawl_records(df, snapshot), F.lit(2000))).collect()
    assert [(r.rule, r.hits, r.fields_filled, r.fields_total, r.slow_count, r.avg_ms) for r in stats] == [("shop", 2, 4, 6, 2, 2000.0)]
    # Pages 2 and 3 have the same text, 1 and 4 the same fields; page 6 is empty and always kept.
    assert {k: r.outcome for k, r in got.items()} == {1: "ok", 2: "ok", 3: "duplicate", 4: "duplicate", 5: "noindex", 6: "ok"}


def test_selectors_that_the_reader_does_not_know_are_refused(spark):
    known = ["#d > p", "p.a.b, span", "[data-x^=pre]", "[data-x$='f x']", '[a*="-"]', "li:nth-child( 2n + 1 )", "li:nth-child(-n+2)", "li:nth-child(even)",
             "p:not(.a):not([data-x])", ":not(ul > li, .b) ~ p", "*", "ul li:first-child", "p.é", "a:hover", "div a:focus > b"]
    unknown = ["p:nth-of-type(2)", "p:last-of-type", "p:has(a)", ":is(h1, h2)", "p:empty", "[a|=x]", "[a=x i]", '[a="x"i]', "p >", "> p", "p::after", "[x",
               "li:nth-child(x)", "a,,b", "p:not(:has(a))", "p:first-childx", "a:hover, p", "p:not(:hover)", "a\\:b"]
    docs = [("s", c, doc(fields={"t": {"selector": c}})) for c in known + unknown]
    docs.append(("s", "fallback", doc(fields={"t": {"selector": "p", "fallback": ["p:has(a)"]}})))
    _, report = S.load_rules(spark.createDataFrame(docs, "source string, path string, content string"))
    got = {r.path: (r.status, r.error) for r in report.collect()}
    assert {c for c in known if got[c] != ("pass", None)} == set()
    assert {c for c in unknown if got[c] != ("fail", "field t selector is not understood")} == set()
    assert got["fallback"] == ("fail", "field t fallback selector is malformed")
    for c in known:
        if ":hover" not in c and ":focus" not in c:
            compile_selector(c)


def test_quality(spark):
    rows = [("r", "a", None), ("r", "a", []), ("r", "a", [" "]), ("r", "a", ["x"]), ("r", "b", ["x"])]
    got = R.rule_quality(spark.createDataFrame(rows, "rule string, field string, values array<string>"))
    assert {r.field: tuple(r)[2:] for r in got.collect()} == {"a": (4, 1, 1, 1, True), "b": (1, 0, 0, 0, False)}


@pytest.mark.parametrize(
    "pattern, text",
    [
        ("^/item/[0-9]+", "/item/"), ("page=[0-9]", "page="), (r"\.html$", ".html"), ("a|bcd", ""), ("(abc)def?gh", "gh"), ("x(a|b)?yz+w", "yz"), ("colou?r/", "colo"),
        (r"\d+abc", "abc"), (r"ab\x41cd", ""), ("(?i)abc", ""), ("ab{2,3}cde", "cde"), ("[a-z]*", ""), (r"a\+\+b", "a++b"), ("a++bcd", ""), (r"q\?x=", "q?x="), ("a.b+?cde", "cde"), ("", ""),
    ],
)
def test_required_text(spark, pattern, text):
    assert spark.createDataFrame([(pattern,)], "p string").select(R.required_text(F.col("p"))).first()[0] == text


def test_general_rules_by_required_text(spark):
    """50 000 general rules as rows: each page meets those of its own grams, and the result is that of all patterns."""
    rng = random.Random(1)
    rules = [(f"/p{i}x/", i) for i in range(50_000)] + [("^/p7x/", 1), ("[0-9]x/$", 2), ("x/(a|b)", 3), ("(?i)/P9X", 4), ("/zz?y", 5), ("^/[^?]*[?]q=", 6), (None, 7)]
    rows = [(f"r{i}", "any" if p is None else "global_pattern", [], p or "", v, "user", True) for i, (p, v) in enumerate(rules)]
    snapshot = spark.createDataFrame(rows, "name string, scope string, domains array<string>, url_pattern string, version int, source string, enabled boolean")
    urls = [f"https://h{i % 9}.com/p{rng.randrange(50_000)}x/{rng.choice(['', 'a', 'b', 'zy', 'zzy?q=1'])}" for i in range(40)] + ["https://a.com/p9x/a", "https://a.com/p7x/", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    got = {r.page_id: set(r.candidates) for r in R.rule_match(pages, snapshot).collect()}
    assert len(got) == len(urls)
    listed = R.rule_match(pages, snapshot.where("name >= 'r49900'")).collect()
    joined = R.rule_match(pages, snapshot.where("name >= 'r49900'"), few=0).collect()
    assert sorted(listed) == sorted(joined)
    for i, u in enumerate(urls):
        place = "" if u is None else re.sub("^[^:]+://[^/]*", "", u)
        assert got[i] == {f"r{j}" for j, (p, _) in enumerate(rules) if p is None or (u and re.search(p, place))}
