"""The pipeline against a brute-force version, and what shards and mixing promise."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from webloom.llm import mixing, quality_knn, sharding


def shingles(text, width, lower=str.lower):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def ascii_lower(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def passes_of(docs):
    """doc id -> passes, for (id, text, source)."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in docs}
    total = Counter()
    for i, _, s in docs:
        total[s] += size[i]
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    out, run = {}, Counter()
    for i, _, s in sorted(docs, key=lambda d: (hashlib.md5(str(d[0]).encode()).hexdigest(), d[0])):
        middle = run[s] + size[i] / 2
        out[i] = sum(size[i] > 0 and middle + k * total[s] < target[s] for k in (0, 1))
        run[s] += size[i]
    return out, size, total, target


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality_knn.fit(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r["doc_id"] for r in quality_knn.scored(table, model).where("predicted = 1").collect()}
    docs = [d for d in docs if d[0] in good]
    sets = {i: shingles(t, 5, ascii_lower) for i, t, _ in docs}
    group = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    docs = [d for d in docs if group[d[0]] == d[0]]
    items = [shingles(r["text"], 5) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = [d for d in docs if not any(100 * len(shingles(d[1], 5) & item) >= 80 * len(item) for item in items if item)]
    want = {i: n for i, n in passes_of(docs)[0].items() if n}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows) == want
    check_shards(rows)


def check_shards(rows, shards=40):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({c: F.lit(c) for c in ("_row", "size", "node", "position", "shard")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0, name


def test_shards_keep_links_together(spark):
    # A link larger than a shard, many small ones, and documents without links.
    links = ["big"] * 170 + [f"pair{i % 150}" for i in range(300)] + ["x"] * 3 + [None] * 400
    narrow = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "id long, link string")
    rows = sharding.sharded(narrow, shards=8).collect()
    check_shards(rows, 8)
    spread = defaultdict(set)
    for r in rows:
        if r["link"]:
            spread[r["link"]].add(r["shard"])
    big = sorted(Counter(r["shard"] for r in rows if r["link"] == "big").values())
    assert sum(big[-3:]) > 0.8 * sum(big)
    assert sum(len(s) > 1 for k, s in spread.items() if k != "big") <= 8


def test_links_move_to_their_neighbours(spark):
    """A claim without a place asks the shard with room that holds most of its documents, not just any."""
    claims = spark.createDataFrame([("a", 0, 4, None), ("b", 0, 4, 0), ("c", 0, 4, None), ("d", 0, 9, None)], "link string, piece int, n long, shard int")
    near = spark.createDataFrame([("a", 0, 3), ("a", 2, 1), ("c", 0, 4), ("c", 1, 0), ("d", 1, 9)], "link string, shard int, here long")
    for number in range(5):
        # Quotas of 6: shard 0 has 2 places beside b, the others 6; d fits nowhere.
        rows = {r["link"]: r for r in sharding.asked_again(claims, near, 18, 3, number).collect()}
        assert rows["a"]["shard"] == 2 and rows["c"]["shard"] == 1 and rows["b"]["held"] and rows["d"]["shard"] is None


def test_small_graphs_are_cut_as_little_as_can_be(spark):
    """Pairs kept together, against all ways to deal the documents of a small graph."""
    for links in (["a"] * 3 + ["b"] * 3, ["a", "a", "b", "b", "c", "c"], ["a"] * 4 + ["b"] * 2, ["a", "a", None, None, "b", "b"], ["a"] * 5 + [None]):
        rows = sharding.sharded(spark.createDataFrame([(i, x) for i, x in enumerate(links)], "id long, link string"), shards=2).collect()
        check_shards(rows, 2)
        kept = lambda shard: sum(x is not None and x == y and shard[i] == shard[j] for (i, x), (j, y) in combinations(enumerate(links), 2))
        best = max(kept([int(i in chosen) for i in range(6)]) for chosen in combinations(range(6), 3))
        assert kept([s for _, s in sorted((r["id"], r["shard"]) for r in rows)]) == best, links


def test_a_link_of_a_third_of_all_rows_takes_whole_shards(spark):
    # 400 of 1200 rows need 14 of 40 shards of 30 rows.
    links = ["big"] * 400 + [f"pair{i // 2}" for i in range(300)] + [None] * 500
    rows = sharding.sharded(spark.createDataFrame([(i, x) for i, x in enumerate(links)], "id long, link string")).collect()
    check_shards(rows)
    spread = defaultdict(set)
    for r in rows:
        spread[r["link"]].add(r["shard"])
    assert len(spread["big"]) == 14
    assert sum(len(s) > 1 for k, s in spread.items() if k and k != "big") == 0


def test_full_shards_exchange_pairs(spark):
    # Every document has a copy and no place is free: a boundary between shards cuts one pair at most.
    rows = sharding.sharded(spark.createDataFrame([(i, f"l{i // 2}") for i in range(400)], "id long, link string"), shards=8).collect()
    check_shards(rows, 8)
    spread = defaultdict(set)
    for r in rows:
        spread[r["link"]].add(r["shard"])
    assert sum(len(s) > 1 for s in spread.values()) <= 7


def test_mixing_reaches_its_targets(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    passes, size, total, target = passes_of(docs)
    rows = {r["doc_id"]: r for r in mixing.mixed(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    taken = Counter()
    for i, _, s in docs:
        r = rows[i]
        assert (r["size"], r["source_size"], r["taken"]) == (size[i], total[s], passes[i] * size[i])
        assert abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        taken[s] += r["taken"]
    for s in total:
        assert abs(taken[s] - target[s]) <= 2 * max(size[i] for i, _, t in docs if t == s)


def test_a_source_comes_when_its_weight_is_high(spark):
    docs = [(i, "w " * 10, s) for i, s in enumerate(["a", "b", "c"] * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mixed(df).join(df.drop("text"), "doc_id").where("position IS NOT NULL").groupBy("source").agg(F.avg("position").alias("p")).collect()
    mean = {r["source"]: r["p"] for r in rows}
    assert mean["a"] < mean["c"]  # the first source's weight falls, the third one's rises
