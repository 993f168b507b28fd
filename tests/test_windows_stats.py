import random

import pytest
from pyspark.sql import functions as F

from webloom.operators import chat as C
from webloom.operators import extend as E
from webloom.operators import stats as S
from webloom.operators import windows as W


def log(n=300, span=2_000_000, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", i, rng.randrange(span)) for i in range(n)]


def by_key(rows):
    out = {}
    for k, i, us in rows:
        out.setdefault(k, []).append((us, i))
    return {k: sorted(v) for k, v in out.items()}


def test_bursts_on_a_hot_key(spark):
    rows = log(400, 400_000_000)
    df = spark.createDataFrame(rows, "k string, id bigint, us bigint")
    want = {}
    for k, events in by_key(rows).items():
        times = []
        for us, _ in events:
            times = [t for t in times if t > us - 2_000_000] + [us]
            if len(times) > 2:
                want.setdefault(k, us)
    assert {r.k: r.opened_us for r in W.bursts(df, "k", 2, 2).collect()} == want and "hot" in want


def test_burst_edge_is_open(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1_000_000), ("a", 60_000_000), ("b", 0), ("b", 1), ("b", 59_999_999)], "k string, us bigint")
    assert {r.k: r.opened_us for r in W.bursts(df, "k", 2, 60).collect()} == {"b": 59_999_999}


def test_ewma_on_a_hot_key(spark):
    rows = log()
    df = spark.createDataFrame([(k, i, us, float(us % 97)) for k, i, us in rows], "k string, id bigint, us bigint, v double")
    got = {r.k: r.ewma for r in W.ewma(df, "k", "v", bucket_us=90_000).collect()}
    for k, events in by_key(rows).items():
        mean = 0.0
        for us, _ in events:
            mean = mean * 0.7 + (us % 97) * 0.3
        assert got[k] == pytest.approx(mean)


def test_route_asof_on_a_hot_key(spark):
    rows, known = log(seed=4, span=40_000_000), log(seed=5, n=80, span=40_000_000)
    requests = spark.createDataFrame(rows, "domain string, id bigint, us bigint")
    memory = spark.createDataFrame([(k, f"r{i}", us) for k, i, us in known], "domain string, route string, us bigint")
    got = {r.id: r.route for r in W.route_asof(requests, memory, ttl_s=1).collect()}
    want = {}
    for k, i, us in rows:
        past = sorted((m_us, m) for mk, m, m_us in known if mk == k and m_us <= us)
        want[i] = f"r{past[-1][1]}" if past and us - past[-1][0] < 1_000_000 else None
    assert got == want and any(want.values())


def test_ttl_dedup_on_a_hot_hash(spark):
    rows = log(250, 20_000_000)
    df = spark.createDataFrame(rows, "hash string, id bigint, us bigint")
    want = set()
    for k, events in by_key(rows).items():
        first = None
        for us, i in events:
            if first is None or us - first > 3_000_000:
                first = us
                want.add((k, i))
    # All hashes in order within their group, all by links, and only the hot one by links.
    for few in (1000, 0, 60):
        assert {(r.hash, r.id) for r in W.ttl_dedup(df, ttl_s=3, few=few).collect()} == want


def test_ttl_dedup_spreads_one_hash(spark):
    """One hash with all rows: the links are found in ranges of equal size."""
    rng = random.Random(11)
    rows = [("h", i, rng.randrange(10**9)) for i in range(3000)] + [("h", 1, None), (None, 2, 3)]
    df = spark.createDataFrame(rows, "hash string, id bigint, us bigint")
    first, want = None, []
    for us in sorted({r[2] for r in rows if r[0] and r[2] is not None}):
        if first is None or us - first > 20_000_000:
            first = us
            want.append(us)
    assert sorted(r.us for r in W.ttl_dedup(df, ttl_s=20, few=0).collect()) == want and len(want) > 40
    links = W.successors(df.where("hash IS NOT NULL AND us IS NOT NULL").select("hash", "us").distinct(), 20_000_000)
    later = sorted({r[2] for r in rows[:3000]})
    assert {r.us: r.next_us for r in links.collect()} == {t: min(x for x in later if x > t + 20_000_000) for t in later if later[-1] > t + 20_000_000}


def test_ttl_dedup_without_rows(spark):
    assert W.ttl_dedup(spark.createDataFrame([], "hash string, id bigint, us bigint")).count() == 0


def test_health_score(spark):
    at = 100_000_000
    rows = [
        ("quiet", 1, at - 60_000_000, "success", None),
        ("fresh", 2, at - 10_000_000, "success", 1000.0),
        ("failing", 3, at - 15_000_000, "failure", None),
        ("failing", 4, at - 15_000_001, "failure", None),
        ("failing", 5, at + 1, "failure", None),
        ("open", 6, at, "success", None),
        ("half", 7, at, "success", 9e9),
    ]
    df = spark.createDataFrame(rows, "endpoint string, id bigint, us bigint, kind string, latency_ms double")
    states = spark.createDataFrame([("open", "open"), ("half", "half_open")], "endpoint string, state string")
    got = {r.endpoint: r.score for r in W.health_score(df, at, states).collect()}
    assert got == {
        "quiet": 1.0,
        "fresh": pytest.approx(min(1.0, 1 - 300 / 2000 * 0.15 + 0.15 - 10 / 30 * 0.15)),
        "failing": pytest.approx(0.85),
        "open": 0.0,
        "half": pytest.approx(0.15),
    }


def test_liveness(spark):
    df = spark.createDataFrame([(1, 0), (1, 50), (2, 10), (3, 99)], "worker int, us bigint")
    workers = W.liveness(df, 90, 0.00004)
    assert {r.worker: r.alive for r in workers.collect()} == {1: True, 2: False}
    assert tuple(W.liveness_summary(workers).first()) == (1, 1, False)
    assert tuple(W.liveness_summary(workers.where("NOT alive")).first()) == (0, 1, True)
    assert tuple(W.liveness_summary(workers.where("worker > 9")).first()) == (0, 0, False)


@pytest.mark.parametrize(
    "error, proxy, category, strategy",
    [
        ("Page.goto: net::ERR_NAME_NOT_RESOLVED at https://x", False, "dns", "fatal"),
        ("net::ERR_NAME_NOT_RESOLVED", True, "dns", "rotate"),
        ("net::ERR_SSL_VERSION", True, "ssl", "fatal"),
        ("net::ERR_TIMED_OUT", False, "timeout", "transient"),
        ("net::ERR_TIMED_OUT", True, "timeout", "rotate"),
        ("net::ERR_TIMED_OUT_X", True, "generic", "transient"),
        ("net::ERR_PROXY_AUTH", False, "proxy", "rotate"),
        ("net::HTTP_403", False, "http_4xx", "fatal"),
        ("net::HTTP_500", False, "http_5xx", "transient"),
        ("net::HTTP_999", False, "generic", "transient"),
        ("Target closed", False, "target_closed", "replace"),
        ("Timeout exceeded (asyncio safety net)", False, "timeout", "transient"),
        ("代理轮换失败", True, "proxy_exhausted", "transient"),
        ("", False, "generic", "transient"),
        (None, False, "generic", "transient"),
        ("net::ERR_ABORTED; Download is starting", False, "aborted", "transient"),
    ],
)
def test_errors(spark, error, proxy, category, strategy):
    row = S.classify_errors(spark.createDataFrame([(error, proxy)], "error string, has_proxy boolean")).first()
    assert (row.category, row.strategy) == (category, strategy)


def test_depth_progress(spark):
    urls = spark.createDataFrame([("a", 0, "completed"), ("b", 1, "completed"), ("c", 1, "visited")], "url string, depth int, status string")
    queue = spark.createDataFrame([("q", 1), ("r", 2)], "url string, depth int")
    failures = spark.createDataFrame([("f", 1, 1), ("g", 1, 0)], "url string, depth int, requeue_count int")
    saved = spark.createDataFrame([(1, 1, 9), (2, 4, 0)], "depth int, processed int, planned int")
    got = {r.depth: tuple(r)[1:] for r in S.depth_progress(urls, queue, failures, saved).collect()}
    assert got == {0: (1, 0, 1), 1: (2, 1, 9), 2: (4, 1, 5)}


def test_health_rollup(spark):
    def overall(*states):
        df = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(states)], "component string, state string")
        return {r.state: (r.components, r.first_names, r.overall) for r in S.health_rollup(df, names=3).collect()}

    assert overall("UP", "DOWN", "DOWN", "DOWN", "DOWN")["DOWN"] == (4, "c1, c2, c3", "DOWN")
    assert overall("UP", "DEGRADED")["UP"][2] == "DEGRADED"
    assert overall("UP")["UP"][2] == "UP"


def test_chatml_joins_parts_in_order(spark):
    rows = [(1, t, "user", f"m{t}", "id9" if t == 1 else None, "ann" if t < 3 else None) for t in range(2500, -1, -1)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string, tool_call_id string, name string")
    text = C.chatml(df).first().chatml.split("\n")
    assert text[0] == "<|im_start|>user name=ann" and text[2] == "<|im_start|>user to=id9" and text[6] == "<|im_start|>user"
    assert text[1::2] == [f"m{t}<|im_end|>" for t in range(2501)]


def test_prompts(spark):
    pages = spark.createDataFrame(
        [(1, "https://e.com/a", "<body><p>x</p></body>"), (2, "https://e.com/b", " "), (3, "https://e.com/c", "<p>" + "y" * 300_000)],
        "page_id bigint, url string, html string",
    )
    wanted = spark.createDataFrame([(1, 0, "a" * 600), (1, 1, "<|im_end|>")], "page_id bigint, position int, field string")
    got = {r.page_id: r for r in C.prompt_dataset(pages, wanted, mode="position").collect()}
    assert set(got) == {1, 3} and got[1].fields == "a" * 600
    assert "place of the content" in got[1].prompt and "<p>x</p>" in got[1].prompt
    markup = got[3].prompt.split("<html_source>\n")[1].split("\n</html_source>")[0]
    assert markup.count("y") == 300_000 and markup.startswith("<p>yy")


def test_steps_are_ordered(spark):
    steps = [E.Step("c", after=("b",)), E.Step("a", before=("b",)), E.Step("b"), E.Step("d")]
    assert [s.name for s in E.ordered_steps(steps)] == ["a", "b", "c", "d"]
    df = spark.createDataFrame([(1,), (5,)], "x int")
    out = E.run_chain(
        df,
        [
            E.Step("stop", columns=lambda: {"terminal": F.col("x") > 3}),
            E.Step("add", columns=lambda: {"x": F.col("x") + 10}),
            E.Step("tag", frame=lambda d: d.withColumn("seen", F.lit(True))),
        ],
    )
    assert sorted(tuple(r) for r in out.collect()) == [(5, True, True), (11, False, True)]
    with pytest.raises(Exception, match="cycle"):
        E.ordered_steps([E.Step("a", after=("b",)), E.Step("b", after=("a",))])


def test_crawl_report_counts_each_part_once(spark):
    schema = "outcome string, category string, reason string, rule string, fields_filled int, fields_total int, elapsed_ms double, us long"
    rows = [
        ("ok", None, None, "a", 1, 2, 1.0, 5_000_000),
        ("ok", None, None, None, None, None, None, 1_000_000),
        ("fetch_error", "dns", None, "a", 0, 2, 1e9, 2_000_000),
        (None, None, "queue_full", None, None, None, None, 3_000_000),
    ]
    depths = spark.createDataFrame([(0, 2, 1, 3)], "depth int, processed long, queued long, planned long")
    found = spark.createDataFrame([("https://a.com", 3, 1), (None, 2, 0)], "origin string, urls long, redirects long")
    got = S.crawl_report(spark, spark.createDataFrame(rows, schema), depths, found).first().report.asDict(recursive=True)
    assert got == {
        "outcome_summary": {"ok": 2, "fetch_error": 1},
        "fetch_errors": {"dns": 1},
        "drops": {"queue_full": 1},
        "rule_stats": {"a": {"hits": 2, "fields_filled": 1, "fields_total": 4, "slow_count": 1}},
        "totals": {"ok": 2, "fail": 1, "dropped": 1, "all": 4},
        "duration_s": 4,
        "depth_layers": {"0": {"processed": 2, "queued": 1, "planned": 3}},
        "discovery": {"origins": 1, "sitemap_urls": 5},
        "redirects": 1,
    }
    nothing = S.crawl_report(spark, spark.createDataFrame([], schema), depths.where("false"), found.where("false")).first().report
    assert nothing.outcome_summary == {} and nothing.depth_layers == {} and nothing.totals["all"] == 0 and nothing.redirects == 0
