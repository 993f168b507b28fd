"""State jobs against plain Python on small relations with one key holding most rows."""

import random

from pyspark.sql import functions as F

from webloom.operators import frontier as O
from webloom.operators.ranking import hot_keys, in_ranges, numbered, ordered_take, salted_join, with_lookback

URLS = "url string, depth int, status string, added_time bigint, completed_time bigint, outcome string"
QUEUE = "id bigint, url string, depth int, added_time bigint, domain string"
FAILURES = "url string, depth int, error string, ts bigint, requeue_count int"
IN_FLIGHT = "url string, depth int, started_at bigint"
BOUNDARY = "parent_url string, child_url string, parent_depth int"


def u(n):
    return f"https://e.com/{n}"


def skewed_keys(n, seed=1):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}") for _ in range(n)]


def test_numbered_on_a_hot_key(spark):
    rows = [(k, i, random.Random(i).randrange(50)) for i, k in enumerate(skewed_keys(400))]
    df = spark.createDataFrame(rows, "k string, id int, v int")
    got = {r.id: r.rn for r in numbered(df, ["v", "id"], F.floor(F.col("v") / 7), "rn", ["k"]).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        for rn, r in enumerate(sorted((r[2], r[1]) for r in rows if r[0] == key), 1):
            want[r[1]] = rn
    assert got == want


def test_ordered_take(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(200)], "id int, v int")
    for n in (0, 1, 57, 500):
        got = sorted((r.v, r.id) for r in ordered_take(df, n, ["v", "id"], F.floor(F.col("v") / 10)).collect())
        assert got == sorted(((i * 37) % 101, i) for i in range(200))[:n]


def test_lookback_copies(spark):
    df = spark.createDataFrame([(t,) for t in range(0, 1000, 7)], "us bigint")
    copies = with_lookback(df, "us", 30, 100)
    assert copies.where("_own").count() == df.count()
    # A row is in every bucket that a frame reaching back to it may lie in.
    assert copies.where("NOT (_bucket * 100 <= us + 30 AND us < (_bucket + 1) * 100)").count() == 0


def test_salted_join(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(skewed_keys(300))] + [("none", -1), (None, -2)], "k string, id int")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("unused", 3)], "k string, x int")
    hot = hot_keys(left, "k", 20)
    parts = {r.k: r._parts for r in hot.collect()}
    counts = {r.k: r["count"] for r in left.groupBy("k").count().collect() if r.k}
    assert parts == {k: -(-n // 20) for k, n in counts.items() if n > 20} and parts["hot"] > 5
    want = {r.id: {"hot": 1, "k1": 2}.get(r.k) for r in left.collect()}
    for some_hot in (None, hot):
        rows = salted_join(left, right, "k", F.col("id"), hot=some_hot).collect()
        assert len(rows) == len(want) and {r.id: r.x for r in rows} == want
    inner = salted_join(left, right, "k", F.col("id"), "inner", hot)
    assert {r.id: r.x for r in inner.collect()} == {i: x for i, x in want.items() if x}
    semi = salted_join(left, right, "k", F.col("id"), "left_semi", hot)
    assert semi.columns == ["k", "id"] and {r.id for r in semi.collect()} == {i for i, x in want.items() if x}


def relations(spark, urls=(), queue=(), failures=(), in_flight=(), boundary=()):
    return (
        spark.createDataFrame(list(urls), URLS), spark.createDataFrame(list(queue), QUEUE), spark.createDataFrame(list(failures), FAILURES),
        spark.createDataFrame(list(in_flight), IN_FLIGHT), spark.createDataFrame(list(boundary), BOUNDARY),
    )


def test_admission_order(spark):
    urls, queue, _, in_flight, _ = relations(
        spark, urls=[(u(1), 0, "completed", 0, 0, "ok")], queue=[(1, u(2), 0, 0, "e.com")], in_flight=[(u(3), 0, 0)]
    )
    cands = [
        ("ftp://x", 0, "invalid_url"), (u("skip"), 9, "excluded"), (u(1), 9, "boundary"), (u(1), 0, "duplicate"), (u(2), 0, "duplicate"),
        (u(3), 0, "duplicate"), (u(4), 0, "enqueued"), (u(4), 0, "duplicate"), (u(5), 1, "enqueued"), (u(5), 1, "queue_full"),
        (u(6), 1, "queue_full"), (u(7), 3, "boundary"), ("x", 0, "invalid_url"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cands)], "seq bigint, url string, depth int")
    for bucket_rows in (1, 4, 1000):
        out = O.admit(df, urls, queue, in_flight, ["skip"], max_depth=3, cap=3, bucket_rows=bucket_rows).orderBy("seq").collect()
        assert [r.verdict for r in out] == [c[2] for c in cands]


def test_admission_against_a_loop(spark):
    rng = random.Random(5)
    known = {u(n) for n in range(0, 40, 3)}
    cands = [(i, u(rng.randrange(60)), rng.randrange(4)) for i in range(300)]
    size, seen, want = 0, set(known), []
    for _, url, depth in cands:
        if depth >= 3:
            want.append("boundary")
        elif size >= 15:
            want.append("queue_full")
        elif url in seen:
            want.append("duplicate")
        else:
            seen.add(url)
            size += 1
            want.append("enqueued")
    urls, queue, _, in_flight, _ = relations(spark, urls=[(x, 0, "completed", 0, 0, "ok") for x in known])
    df = spark.createDataFrame(cands, "seq bigint, url string, depth int")
    out = O.admit(df, urls, queue, in_flight, max_depth=3, cap=15, bucket_rows=20).orderBy("seq").collect()
    assert [r.verdict for r in out] == want


def test_politeness_on_a_hot_domain(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(100_000)) for i, k in enumerate(skewed_keys(300))]
    df = spark.createDataFrame(rows, "domain string, event_id bigint, us bigint")
    plain, strict = {}, {}
    for key in {r[0] for r in rows}:
        last_us = last_slot = None
        for us, i in sorted((r[2], r[1]) for r in rows if r[0] == key):
            plain[i] = us if last_us is None else max(us, last_us + 900)
            strict[i] = last_slot = us if last_slot is None else max(us, last_slot + 900)
            last_us = us
    for mode, want in (("as_run", plain), ("strict", strict)):
        out = O.politeness(df, 900, mode, bucket_us=7_000)
        assert {r.event_id: r.slot_us for r in out.collect()} == want


def test_round_robin(spark):
    rows = [(i, u(i), i % 3, 0, k) for i, k in enumerate(skewed_keys(60))]
    _, queue, _, _, _ = relations(spark, queue=rows)
    out = O.round_robin(queue, bucket_rows=7).collect()
    for key in {r[4] for r in rows}:
        mine = sorted((r.turn, r.depth, r.id) for r in out if r.domain == key)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    head = sorted((r.turn, r.domain) for r in out)[:20]
    assert [(r.turn, r.domain) for r in O.queue_page(queue, 20, 7).orderBy("turn", "domain").collect()] == head


def test_depth_limits_there_and_back(spark):
    queue = [(i, u(i), i % 5, 0, "e.com") for i in range(1, 20)]
    _, q, f, _, b = relations(spark, queue=queue, failures=[(u(50), 4, "", 0, 0), (u(51), 1, "", 0, 0)])
    kept, failures, boundary = O.depth_trim(q, f, b, 3)
    assert kept.where("depth >= 3").count() == 0 and [r.url for r in failures.collect()] == [u(51)]
    promoted, rest = O.promote(boundary, 99)
    back = kept.select("url", "depth").union(promoted.select("url", "depth"))
    assert sorted(map(tuple, back.collect())) == sorted((r[1], r[2]) for r in queue)
    assert rest.count() == 0


def test_promote_takes_least_depth(spark):
    _, _, _, _, b = relations(spark, boundary=[("p", "c", 3), ("q", "c", 1), ("p", "d", 4)])
    promoted, rest = O.promote(b, 5)
    assert [tuple(r) for r in promoted.collect()] == [("c", 2)]
    assert [tuple(r) for r in rest.collect()] == [("p", "d", 4)]


def test_lost_children(spark):
    urls, q, _, fl, b = relations(
        spark, urls=[(u(1), 0, "visited", 0, 0, "")], queue=[(1, u(2), 0, 0, "")], in_flight=[(u(3), 0, 0)],
        boundary=[("p", u(i), 1) for i in range(1, 6)] + [("q", u(4), 1), ("q", u(9), 2)],
    )
    assert sorted(r.url for r in O.lost_children(b, urls, q, fl, 1).collect()) == [u(4), u(5)]


def test_recover(spark):
    urls, q, _, fl, _ = relations(
        spark, urls=[(u(1), 0, "completed", 0, 0, ""), (u(2), 0, "visited", 0, 0, "")], queue=[(1, u(3), 0, 0, "")],
        in_flight=[(u(i), 0, 0) for i in (1, 2, 3, 4)],
    )
    got = {r.url: r.action for r in O.recover(fl, urls, q).collect()}
    assert got == {u(1): "skipped", u(2): "recovered", u(3): "queued", u(4): "recovered"}


def test_reclaim(spark):
    urls, q, f, fl, _ = relations(
        spark, urls=[(u(1), 0, "completed", 0, 0, ""), (u(5), 0, "visited", 0, 0, "")], queue=[(1, u(2), 0, 0, "")], in_flight=[(u(3), 0, 0)],
        failures=[(u(i), 9 - i, "", 0, 0) for i in range(1, 8)] + [(u(8), 0, "", 0, 2)],
    )
    taken, failures = O.retry_reclaim(f, q, fl, urls, max_requeue=2, n=3)
    assert sorted(r.url for r in taken.collect()) == [u(5), u(6), u(7)]
    assert {r.url: r.requeue_count for r in failures.collect()} == {u(i): int(i in (5, 6, 7)) for i in range(1, 8)} | {u(8): 2}


def test_ledger(spark):
    _, _, f, _, _ = relations(spark, failures=[("old", 0, "", 0, 1), ("gone", 0, "", 0, 1), ("still", 0, "", 0, 0)])
    attempts = [("old", "error"), ("gone", "error"), ("gone", "success"), ("new", "error"), ("net", "infra"), ("stop", "shutdown"), ("many", "error")] + [("many", "error")] * 9
    out = O.apply_attempts(f, spark.createDataFrame(attempts, "url string, kind string"), 3)
    assert {r.url: (r.requeue_count, r.permanent) for r in out.collect()} == {
        "old": (2, False), "new": (1, False), "still": (0, False), "stop": (3, True), "many": (3, True),
    }


def test_complete(spark):
    urls, _, f, fl, _ = relations(
        spark, urls=[(u(1), 5, "visited", 10, None, "")], failures=[(u(1), 0, "", 0, 1), (u(7), 0, "", 0, 1), (u(8), 0, "", 0, 1)],
        in_flight=[(u(2), 0, 0), (u(9), 0, 0)],
    )
    done = spark.createDataFrame([(u(1), None, 1, 99, "ok"), (u(2), u(7), 2, 98, "noindex")], "url string, original_url string, depth int, ts bigint, outcome string")
    merged, failures, in_flight = O.complete(urls, f, fl, done)
    assert sorted(map(tuple, merged.collect())) == [(u(1), 1, "completed", 10, 99, "ok"), (u(2), 2, "completed", 98, 98, "noindex")]
    assert [r.url for r in failures.collect()] == [u(8)] and [r.url for r in in_flight.collect()] == [u(9)]


def test_legacy(spark):
    visited = spark.createDataFrame([("a", 1, 5), ("b", 2, 6)], "url string, depth int, added_time bigint")
    completed = spark.createDataFrame([("b", 7), ("c", 8)], "url string, completed_time bigint")
    assert sorted(map(tuple, O.merge_legacy(visited, completed).collect())) == [
        ("a", 1, "visited", 5, None), ("b", 2, "completed", 6, None), ("c", 0, "completed", None, 8),
    ]


def test_bfs(spark):
    edges = spark.createDataFrame([("s", "a"), ("s", "b"), ("a", "c"), ("b", "a"), ("c", "d"), ("c", "s"), ("x", "y")], "src_url string, dst_url string")
    seeds = spark.createDataFrame([("s",)], "url string")
    reached, boundary = O.bfs(edges, seeds, 3)
    assert sorted(map(tuple, reached.collect())) == [("a", 1), ("b", 1), ("c", 2), ("s", 0)]
    assert sorted(map(tuple, boundary.collect())) == [("c", "d", 2), ("c", "s", 2)]
    assert O.bfs(edges, seeds, 9)[1].count() == 0


def test_budget(spark):
    rows = [(i, i * 10, i % 3 != 0) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, us bigint, success boolean")
    done, want = 0, []
    for i, us, ok in rows:
        if us >= 400 or done >= 12:
            break
        want.append(i)
        done += ok
    assert sorted(r.event_id for r in O.budget(df, 12, 400).collect()) == want


def test_budget_in_one_busy_hour(spark):
    """All rows within an hour, half of them at one moment: ranges of equal size, the same cut."""
    rng = random.Random(2)
    rows = [(i, 5 if i % 2 else rng.randrange(3_600_000_000), rng.random() < 0.7) for i in range(4000)]
    df = spark.createDataFrame(rows, "event_id bigint, us bigint, success boolean")
    done, want = 0, set()
    for i, _, ok in sorted(rows, key=lambda r: (r[1], r[0])):
        if done >= 1700:
            break
        want.add(i)
        done += ok
    assert {r.event_id for r in O.budget(df, 1700).collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    parts = [r["count"] for r in in_ranges(df, ["us", "event_id"]).groupBy("_part").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 8 and max(parts) < 1000


def test_infrastructure_errors_come_back(spark):
    """In the order of the attempts; known, waiting and finished URLs do not."""
    rows = [(5, "https://a.com/1", 2, "infra"), (3, "https://a.com/1", 1, "error"), (4, "https://a.com/1", 0, "infra"), (1, "https://b.com/2", 1, "infra"), (9, "https://b.com/2", 1, "success"),
            (2, "https://c.com/3", 3, "infra"), (6, "https://d.com/4", 0, "infra"), (7, "https://e.com/5", 0, "shutdown")]
    attempts = spark.createDataFrame(rows, "id bigint, url string, depth int, kind string")
    known = spark.createDataFrame([("https://d.com/4",)], "url string")
    out = O.requeued(attempts, known, known.limit(0)).orderBy("id").collect()
    assert [tuple(r) for r in out] == [(2, "https://c.com/3", 3, "c.com"), (4, "https://a.com/1", 0, "a.com")]


def test_drop_reasons_of_admissions(spark):
    rows = [(1, "https://e.com/a", 1), (2, "https://e.com/a", 1), (3, "https://e.com/x9", 1), (4, "https://e.com/b", 5), (5, "bad", 1), (6, "https://e.com/k", 1),
            (7, "https://e.com/c", 1), (8, "https://e.com/d", 1)]
    urls = spark.createDataFrame([("https://e.com/k",)], "url string")
    admitted = O.admit(spark.createDataFrame(rows, "seq int, url string, depth int"), urls, urls.where("false"), urls.where("false"), ["x9$"], cap=2)
    got = {r.seq: r.reason for r in admitted.select("seq", O.admission_reason(F.col("verdict")).alias("reason")).collect()}
    assert got == {1: None, 2: "already_visited", 3: "exclude_pattern", 4: None, 5: "invalid_url", 6: "already_visited", 7: None, 8: "queue_full"}
