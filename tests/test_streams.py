import json

from pyspark.sql import functions as F

from webloom.sources import history as H
from webloom.sources import state as ST
from webloom.sources.records import read_logs, read_records, write_records
from webloom.sources.rules import load_rules
from webloom.sources.state import current_version, read_state, write_state
from webloom.streaming import jobs as J
from webloom.streaming import stateful as S

S1 = 1_000_000


def drain(spark, tmp_path, df, ddl):
    out = str(tmp_path / "out")
    J.run_available(df.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")))
    return spark.read.schema(ddl).parquet(out)


def arriving(spark, tmp_path, ddl, *batches):
    """A stream that takes each batch as one file of its own trigger."""
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(str(folder / f"b{i}"))
    from pyspark.sql import types as T

    reader = spark.readStream.schema(T.StructType.fromDDL(ddl)).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.option("latestFirst", False).parquet(str(folder))


def test_endpoint_windows(spark, tmp_path):
    ddl = "endpoint bigint, us bigint, kind string, weight int"
    batches = [[(1, 1 * S1, "failure", 1), (1, 2 * S1, "success", 1), (2, 3 * S1, "failure", 3)], [(1, 70 * S1, "success", 1)], [(1, 500 * S1, "failure", 3)]]
    rows = arriving(spark, tmp_path, ddl, *batches).withColumn("ts", F.timestamp_micros("us"))
    out = drain(spark, tmp_path, S.endpoint_windows(rows), "endpoint bigint, window_start timestamp, failures bigint, successes bigint, state string")
    got = {(r.endpoint, r.at): (r.failures, r.successes, r.state) for r in out.withColumn("at", F.unix_seconds("window_start")).collect()}
    assert got == {(1, 0): (1, 1, "degraded"), (2, 0): (3, 0, "open"), (1, 60): (0, 1, "closed")}


def test_bursts_over_batches(spark, tmp_path):
    ddl = "key bigint, us bigint"
    batches = [[(1, 0), (2, 0)], [(1, 5 * S1), (2, 70 * S1)], [(1, 9 * S1), (2, 75 * S1)], [(1, 9 * S1), (2, 131 * S1)]]
    sink = str(tmp_path / "sink")
    J.run_available(S.stream_bursts(arriving(spark, tmp_path, ddl, *batches), sink, str(tmp_path / "cp"), n=2))
    assert [tuple(r) for r in spark.read.parquet(f"{sink}/alerts").select("key", "opened_us").collect()] == [(1, 9 * S1)]


HOUR = 3600 * S1


def test_dedup_expires_after_the_ttl(spark, tmp_path):
    """One hash at 0, 30, 60, 90 h: in one batch and in four the entry has expired each time."""
    ddl = "hash string, id bigint, us bigint"
    rows = [("h", i, t * HOUR) for i, t in enumerate((0, 30, 60, 90))] + [("g", 10 + t, t * HOUR) for t in (0, 6, 12, 24, 30, 31, 200)]
    want = {("h", 0), ("h", 1), ("h", 2), ("h", 3), ("g", 10), ("g", 40), ("g", 210)}
    by_time = sorted(rows, key=lambda r: r[2])
    for name, batches in {"one": [rows], "four": [by_time[i : i + 3] for i in range(0, 11, 3)]}.items():
        folder = tmp_path / name
        J.run_available(J.stream_dedup(arriving(spark, folder, ddl, *batches), str(folder / "sink"), str(folder / "cp")))
        kept = spark.read.parquet(str(folder / "sink/rows/batch=*")).collect()
        assert {(r["hash"], r["id"]) for r in kept} == want and len(kept) == len(want), name


def test_dedup_of_late_and_repeated_batches(spark, tmp_path):
    write = J.sight_writer(spark, str(tmp_path), ttl_s=10)
    ddl = "hash string, id bigint, us bigint"
    batches = [[("a", 1, 50 * S1)], [("a", 2, 45 * S1), ("a", 3, 20 * S1), (None, 4, 0), ("a", 5, None)], [], [("a", 6, 61 * S1), ("a", 7, 60 * S1)]]
    for i, rows in enumerate(batches):
        write(spark.createDataFrame(rows, ddl), i)
        write(spark.createDataFrame(rows, ddl), i)
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/rows/batch=*").collect()) == [1, 3, 6]


def test_history_reads_few_folders(spark, tmp_path, monkeypatch):
    """One day a batch: what a batch may see is named by its digits; days outside are not read."""
    assert all(len(H._parts(n)) <= 7 * 3 for n in range(512)) and len(H._parts(10**6)) <= 7 * 7
    monkeypatch.setattr(H, "MERGED", 3)
    root, last = str(tmp_path), 19
    for n in range(last + 1):
        for _ in range(2 if n in (9, last) else 1):
            H.keep(spark.createDataFrame([(n, n * H.DAY_US)], "key bigint, us bigint").coalesce(1), root, n, "us")
    seen = H.recall(spark, root, last, "key BIGINT, us BIGINT")
    assert sorted(r["key"] for r in seen.collect()) == list(range(last))
    some = H.recall(spark, root, last, "key BIGINT, us BIGINT", 3 * H.DAY_US, 5 * H.DAY_US + 7)
    assert sorted(r["key"] for r in some.collect()) == [3, 4, 5] and len(some.inputFiles()) == 3
    assert H.recall(spark, root, last, "key BIGINT, us BIGINT", 500 * H.DAY_US, 501 * H.DAY_US).count() == 0


def test_frontier_writes_changes_only(spark, tmp_path, monkeypatch):
    """Bytes of a version do not grow with the queue; a batch that is run again changes nothing; full versions in between."""
    monkeypatch.setattr(ST, "FULL_EVERY", 3)
    root = str(tmp_path)
    J.start_state(spark, root, queue=spark.range(50_000).selectExpr("id", "concat('https://e.com/q', id) AS url", "0 AS depth", "CAST(NULL AS TIMESTAMP) AS added_time", "'e.com' AS domain"))
    write = J.frontier_writer(spark, root)
    for n in range(4):
        rows = spark.createDataFrame([(n, "p", f"https://e.com/{n}", 1), (100 + n, "p", "https://e.com/0", 1)], "seq bigint, parent_url string, url string, depth int")
        write(rows, n)
        if n == 2:
            write(rows, n)
        queue = read_state(spark, root, ["queue"], n + 1)["queue"]
        assert queue.count() == 50_001 + n and queue.select("url").distinct().count() == 50_001 + n
    size = {v: sum(f.stat().st_size for f in (tmp_path / f"version={v}").rglob("*.parquet")) for v in range(5)}
    assert all(size[v] < size[0] / 10 for v in (1, 2, 4)) and size[3] > size[0] / 2


def test_timeouts(spark, tmp_path):
    ddl = "url string, us bigint, kind string"

    def row(url, t, kind):
        return (url, (1000 + t) * S1, kind)

    batches = [
        [row("a", 0, "start"), row("b", 0, "start")],
        [row("a", 200, "end")],
        [row("b", 301, "end")],
        [row("z", 5000, "start"), row("z", 5000, "end")],
        [row("z", 5001, "end"), row("y", 5001, "start")],
    ]
    out = drain(spark, tmp_path, J.stream_timeouts(arriving(spark, tmp_path, ddl, *batches)), "url string, started_us bigint")
    assert [tuple(r) for r in out.collect()] == [("b", 1000 * S1)]


def test_stream_records_drop_copies_of_earlier_batches(spark, tmp_path):
    rule = json.dumps({"name": "r", "match": {"domains": ["r.com"]}, "fields": {"h": {"selector": "h1"}}})
    snapshot, _ = load_rules(spark.createDataFrame([("user", "p", rule)], "source string, path string, content string"))
    html = "<h1>x</h1><p>text</p>"
    ddl = "page_id bigint, url string, html string"
    stream = arriving(spark, tmp_path, ddl, [(1, "https://a.com/", html), (2, "https://b.com/", html), (3, "https://r.com/1", html)], [(4, "https://c.com/", html), (5, "https://c.com/", "<p>new"), (6, "https://c.com/", "")])
    sink = str(tmp_path / "sink")
    J.run_available(J.stream_pages(stream, snapshot, sink, str(tmp_path / "cp")))
    got = spark.read.schema("page_id bigint, extraction_type string").json(f"{sink}/records")
    assert sorted(map(tuple, got.select("page_id", "extraction_type").collect())) == [(1, "default"), (3, "r"), (5, "default"), (6, "default")]
    # A batch that is run again replaces its own output.
    J.record_writer(spark, snapshot, sink)(spark.createDataFrame([(4, "https://c.com/", html), (5, "https://c.com/", "<p>new"), (6, "https://c.com/", "")], ddl), 1)
    again = spark.read.schema("page_id bigint").json(f"{sink}/records")
    assert sorted(r.page_id for r in again.collect()) == [1, 3, 5, 6]
    # A page that comes back after the hashes have expired is new.
    J.record_writer(spark, snapshot, sink, ttl_s=0)(spark.createDataFrame([(7, "https://d.com/", html)], ddl), 9)
    assert 7 in {r.page_id for r in spark.read.schema("page_id bigint").json(f"{sink}/records").collect()}


def test_stream_frontier_over_batches(spark, tmp_path):
    root = str(tmp_path / "state")
    J.start_state(spark, root, failures=spark.createDataFrame([("https://e.com/f", 1, "x", None, 0)], J.STATE_DDL["failures"]))
    ddl = "seq bigint, parent_url string, url string, depth int"
    rows = lambda *ns: [(n, "p", f"https://e.com/{n % 10}", n % 4) for n in ns]
    J.run_available(J.stream_frontier(arriving(spark, tmp_path, ddl, rows(1, 2, 3), rows(11, 14, 7)), root, str(tmp_path / "cp")))
    state = read_state(spark, root, J.STATE_NAMES)
    assert sorted(r.url[-1] for r in state["queue"].collect()) == ["1", "2", "4", "f"]
    assert sorted(r.child_url[-1] for r in state["boundary"].collect()) == ["1", "3", "7"]
    assert [r.requeue_count for r in state["failures"].collect()] == [1]
    assert current_version(spark, root) == 2


def test_state_reads_only_committed_versions(spark, tmp_path):
    root = str(tmp_path)
    assert current_version(spark, root) is None
    one = {"queue": spark.range(3), "urls": spark.range(1)}
    write_state(one, root, 1)
    spark.range(9).write.parquet(f"{root}/version=2/queue")
    assert read_state(spark, root, ["queue"])["queue"].count() == 3
    write_state({"queue": spark.range(5), "urls": spark.range(1)}, root, 2)
    assert read_state(spark, root, ["queue"])["queue"].count() == 5
    assert read_state(spark, root, ["queue"], 1)["queue"].count() == 3


def test_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame(
        [("u", 1, "t\n", None, "default", "T", {"a": ["x", "y"], "b": None}, '{"k":1}')],
        "url string, depth int, text string, ts timestamp, extraction_type string, title string, fields map<string,array<string>>, schema_org string",
    ).withColumn("schema_org", F.try_parse_json("schema_org"))
    write_records(df, path)
    write_records(df, path, gzip=True, resume=True)
    good, bad = read_records(spark, path)
    assert [tuple(r) for r in good.collect()][:1] == [("u", 1, "t\n", None, "default", "T", {"a": ["x", "y"], "b": None}, '{"k":1}')]
    assert good.count() == 2 and bad.count() == 0
    write_records(df, path)
    assert read_records(spark, path)[0].count() == 1


def test_log_lines(spark, tmp_path):
    lines = [
        r'ts=2024-01-01 10:00:00,250 level=info logger=a.b event=x n=1 text="a \"q\" b\\c = d" e="" level=warn',
        '{"ts": "2024-01-01T10:00:00", "level": "error", "logger": "a", "event": "y", "field_level": "z", "n": 2}',
        "not a log line",
    ]
    (tmp_path / "l.log").write_text("\n".join(lines), encoding="utf-8")
    got = sorted(read_logs(spark, str(tmp_path)).collect(), key=lambda r: r.event)
    assert [(str(r.ts), r.level, r.logger, r.event, r.kv) for r in got] == [
        ("2024-01-01 10:00:00.250000", "info", "a.b", "x", {"n": "1", "text": r'a "q" b\c = d', "e": ""}),
        ("2024-01-01 10:00:00", "error", "a", "y", {"field_level": "z", "n": "2"}),
    ]
