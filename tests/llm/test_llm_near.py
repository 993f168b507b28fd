"""Near copies of documents and lines against brute force."""

import random
import re
import time
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webloom.llm import line_dedup, minhash_dedup, near
from webloom.llm.components import components
from webloom.llm.sketch import BINS, EMPTY, difference, distinct, overlaps, sketches
from webloom.llm.tokens import Words, hash_strings, mix, slices
from webloom.session import stored


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \t\n\x0b\x0c\r\u00a0aBÉzü\x00.") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [[] for _ in texts]
    at = 0
    for rows, data, offsets in slices(batch, most=200):
        w = Words(data, offsets)
        for word, doc in zip(w.strings().to_pylist(), w.doc, strict=True):
            got[at + doc].append(word)
        assert (hash_strings(w.strings()) == w.hashes()).all()
        at += rows.num_rows
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for t in texts]


@pytest.mark.parametrize("size", [1, 2, 7, 40, 300, 3000])
def test_sketches_are_full_and_agree_as_the_sets_do(size):
    rng = np.random.default_rng(size)
    agree, jaccard = [], []
    for _ in range(30):
        values = mix(rng.integers(0, 2**63, 2 * size).astype(np.uint64))
        cut = max(1, int(size * 0.9))
        a, b = values[:size], values[size - cut : 2 * size - cut]
        rows = sketches(*distinct(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
        assert (rows != EMPTY).all()
        agree.append((rows[0] == rows[1]).mean())
        jaccard.append(len(set(a) & set(b)) / len(set(a) | set(b)))
    assert abs(np.mean(agree) - np.mean(jaccard)) < 4 * np.sqrt(0.25 / BINS / 30)


def test_differences_and_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    table = overlaps(sets[:12], sets[12:], width=16)
    for i, j in combinations(range(30), 2):
        assert set(difference(sets[i], sets[j])) == set(sets[i]) ^ set(sets[j])
        if i < 12 <= j:
            assert table[i, j - 12] == len(set(sets[i]) & set(sets[j]))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 40)] + [tuple(sorted(rng.sample(range(40), 2))) for _ in range(25)]
    want = grouped_by_links(range(1000), edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: want[n] for e in edges for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def grouped_by_links(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in parent}


def shingle_set(text, width):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def families():
    """Families of edited copies in which many pairs lie just above and just below the threshold."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(400)]
    texts = []
    for _ in range(6):
        first = [rng.choice(words) for _ in range(rng.randint(60, 150))]
        for _ in range(25):
            rate = rng.choice([0.0, 0.01, 0.03, 0.06, 0.08])
            texts.append(" ".join(rng.choice(words) if rng.random() < rate else w for w in first))
    for _ in range(30):  # chains
        texts.append(" ".join([*texts[-1].split()[4:], *[rng.choice(words) for _ in range(4)]]))
    rng.shuffle(texts)
    return [*texts, None, "", "one", "ONE", "two words", texts[0]]


@pytest.mark.parametrize("width", [2, 5])
def test_near_copies(spark, monkeypatch, width):
    monkeypatch.setattr(near, "BLOCK_NODES", 4)
    texts = families()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t, width) for t in texts]
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = grouped_by_links(range(len(texts)), links)
    rows = {r["doc_id"]: r for r in minhash_dedup.near_copies(docs, width).collect()}
    assert {i: r["component_id"] for i, r in rows.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in rows.items())
    left = {r["doc_id"] for r in minhash_dedup.one_of_each(docs, width).collect()}
    assert left == {i for i in want if want[i] == i}


def test_one_of_each_with_repeats_and_null_ids(spark):
    text = "some words that are quite the same in all of these rows " * 3
    rows = [(None, text, 1), (7, text, 2), (7, text, 2), (9, text + "x", 3), (None, "alone here", 4), (None, None, 5), (None, None, 5), (7, "another text of the id", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    left = sorted(minhash_dedup.one_of_each(docs).collect(), key=lambda r: r["node"])
    assert [(r["doc_id"], r["node"]) for r in left] == [(7, 2), (None, 4), (None, 5), (None, 5), (7, 6)]
    marked = minhash_dedup.near_copies(docs).collect()
    assert sorted((r["component_id"] is None, r["kept"]) for r in marked) == sorted([(False, False), (False, True), (False, True), (False, False), (True, True), (True, True), (True, True), (False, True)])


def lines():
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefg hij") for _ in range(rng.randint(1, 500))) for _ in range(25)]
    docs = []
    for i in range(40):
        picked = [list(rng.choice(base)) for _ in range(rng.randint(1, 6))]
        for line in picked:
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice("xyzÉ")
        docs.append((i, "\n".join("".join(x) for x in picked) + "\n" * (i % 3)))
    return [*docs, (90, None), (91, ""), (92, "\n \n\t\n"), (93, "ab"), (94, "ab\nab"), docs[0]]


def test_line_classes(spark):
    docs = lines()
    places = defaultdict(list)
    for i, text in dict(docs).items():
        for k, line in enumerate((text or "").split("\n")):
            if re.search(r"[^\x00-\x20]", line):
                places[line].append((i, k))
    names = list(places)
    sets = [{x[i : i + 10] for i in range(len(x) - 9)} if len(x) > 10 else {x} for x in names]
    links = [(i, j) for i, j in combinations(range(len(names)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = grouped_by_links(range(len(names)), links)
    first = defaultdict(lambda: (10**9, 0))
    for k, line in enumerate(names):
        first[group[k]] = min(first[group[k]], *places[line])
    want = {p: first[group[k]] for k, line in enumerate(names) for p in places[line]}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = line_dedup.judged(df).collect()
    assert {(r["doc_id"], r["line_no"]): (r["class_doc"], r["class_line"]) for r in rows} == want
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["class_doc"], r["class_line"])) for r in rows)
    thin = {r["doc_id"]: r["text"] for r in line_dedup.thinned(df).collect()}
    for i, text in dict(docs).items():
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in want or want[i, k] == (i, k))
        assert thin[i] == kept


def test_lines_of_many_shapes(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("a\n \tÉ\x00") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "\n", "x" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["line_no"], r["line"]) for r in line_dedup.keyed(df).collect())
    assert got == [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if re.search(r"[^\x00-\x20]", x)]
    sizes = {(r["doc_id"], r["line_no"]): (r["n"], len(r["bands"])) for r in line_dedup.describe(df).collect()}
    for i, k, x in got:
        want = len({x[j : j + 10] for j in range(len(x) - 9)}) if len(x) > 10 else 1
        assert sizes[i, k] == (want, line_dedup.BINS // line_dedup.BAND)


def test_line_texts_go_through_the_joins_instead_of_sets(spark, monkeypatch):
    kept = {}
    real = near.stored
    monkeypatch.setattr(near, "stored", lambda df, name="stage": kept.setdefault(name, real(df, name)) if name == "sets" else real(df, name))
    line = " ".join(f"word{i * 37 % 101}" for i in range(60))
    # Two texts under one id, a null id, a repeated row; the same place holds different lines.
    docs = [(1, line + "\nonly one"), (1, line.replace("word37", "other") + "\nélan vital " + line), (None, "x\n" + line + " more"), (2, line + "\nonly one"), (2, line + "\nonly one")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {(r["doc_id"], r["line_no"], r["class_doc"], r["class_line"], r["kept"]) for r in line_dedup.judged(df).collect()}
    assert rows == {
        (1, 0, 1, 0, True), (1, 1, 1, 1, True), (2, 0, 1, 0, False), (2, 1, 1, 1, False), (None, 0, None, 0, True), (None, 1, 1, 0, False)
    } | {(1, 1, 1, 0, False)}
    lines = {x for _, text in docs for x in text.split("\n")}
    members = [r["members"] for r in kept["sets"].collect()]
    assert len(members) == len(set(members)) > 1 and set(members) <= lines


def test_texts_do_not_go_through_the_join_with_asked_lines(spark, monkeypatch):
    docs = [(i if i % 9 else None, "\n".join(f"line {k} of text {i}" for k in range(40))) for i in range(150)]
    df = spark.createDataFrame([*docs, docs[5]], "doc_id long, text string")
    all_lines = line_dedup.keyed(df).collect()
    asked = [(n, (r["doc_id"], r["mark"], r["line_no"])) for n, r in enumerate(all_lines[:6000:20])]
    places = spark.createDataFrame(asked, "nid long, own struct<doc_id: long, mark: long, line_no: long>")
    want = {(n, all_lines[20 * n]["line"]) for n, _ in asked}
    for bits in (line_dedup.MOST_BITS, 0):  # a table as large as wanted, and a full one
        monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
        left = line_dedup.likely(line_dedup.keyed(df), places.select("own.*")).collect()
        assert {(r["doc_id"], r["mark"], r["line_no"]) for r in left} >= {own for _, own in asked}
        assert (len(left) < len(all_lines) / 5) == (bits > 0)
        found = [tuple(r) for r in line_dedup.lines_at(df, places).collect()]
        assert len(found) == len(want) and set(found) == want


def test_lines_run_no_python_in_tasks(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("Python in tasks")

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", refused)
    monkeypatch.setattr(near, "BLOCK_NODES", 4)
    rng = random.Random(21)
    base = "".join(rng.choice("abcdefghij \U0001f600é") for _ in range(160))
    texts = []
    for _ in range(60):  # pairs just above and just below the threshold, some around a common center only
        line = list(base)
        for _ in range(rng.randint(0, 4)):
            line[rng.choice([5, 35, 65, 95, 125, 155])] = rng.choice("xyz")
        texts.append("".join(line))
    names = sorted(set(texts))
    sets = [{x[i : i + 10] for i in range(len(x) - 9)} for x in names]
    links = [(i, j) for i, j in combinations(range(len(names)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = grouped_by_links(range(len(names)), links)
    first = {}
    for i, x in enumerate(texts):
        first.setdefault(group[names.index(x)], i)
    rows = line_dedup.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_doc"] for r in rows} == {i: first[group[names.index(x)]] for i, x in enumerate(texts)}


def test_links_in_blocks_of_lines_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    center = np.unique(rng.integers(-(2**62), 2**62, 150))
    sets, rows = [], []
    pool = rng.integers(-(2**62), 2**62, 60)
    for k in range(40):
        mine = set(rng.permutation(center)[: rng.integers(110, 150)].tolist()) if k % 2 else set(center[:120].tolist())
        mine |= set(pool[30 * (k % 2) : 30 * (k % 2) + int(rng.integers(20, 30))].tolist())
        sets.append(mine)
    for k, mine in enumerate(sets):
        for other in (0, 1):
            rows.append((7, min(k % 2, other), max(k % 2, other), k % 2, k, len(mine), k, list(mine ^ set(center.tolist()))))
    met = spark.createDataFrame(rows, "center long, left long, right long, block long, nid long, n long, group long, apart array<long>")
    got = {(r["a"], r["b"]) for r in line_dedup.block_links(met, 80, 100).collect()}
    want = {(i, j) for i, j in combinations(range(len(sets)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert got == want and 0 < len(want) < 40 * 39 / 2


def test_parities_of_lines_rule_out_large_differences_only(spark):
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(-(2**62), 2**62, 300)).tolist() for _ in range(12)]
    sets += [s[:280] + [7 * k, 7 * k + 1] for k, s in enumerate(sets)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "nid long, apart array<long>")
    rows = df.select("nid", *(line_dedup.parity("apart", k).alias(f"m{k}") for k in range(line_dedup.WORDS))).collect()
    marks = {r[0]: [x % 2**64 for x in r[1:]] for r in rows}
    for i, j in combinations(range(len(sets)), 2):
        differ = sum((x ^ y).bit_count() for x, y in zip(marks[i], marks[j], strict=True))
        assert differ <= len(set(sets[i]) ^ set(sets[j]))
        assert j == i + 12 or differ > (len(sets[i]) + len(sets[j])) / 9  # such pairs need no comparison of members


def test_equal_lines_are_signed_once(spark, monkeypatch):
    seen = []
    real = line_dedup.signed
    monkeypatch.setattr(line_dedup, "signed", lambda lines, keys: seen.append(lines.count()) or real(lines, keys))
    docs = [(i, "the same line\nand the same again\nthe same line") for i in range(30)]
    rows = line_dedup.judged(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert seen == [2] and len(rows) == 90 and {(r["class_doc"], r["class_line"]) for r in rows} == {(0, 0), (0, 1)}


def test_a_line_is_stored_once_however_many_blocks_it_meets(spark, monkeypatch):
    kept = []
    real = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name="stage": (kept.append(real(df, name)) or kept[-1]) if name == "blocks" else real(df, name))
    for module in (near, line_dedup):
        monkeypatch.setattr(module, "BLOCK_NODES", 4, raising=False)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghij") for _ in range(200))
    # Lines on both sides of the threshold, around one center.
    texts = ["".join(rng.choice("xyz") if i in cut else c for i, c in enumerate(base)) for cut in (rng.sample(range(5, 200, 15), rng.choice([0, 1, 2, 3])) for _ in range(60))]
    names = sorted(set(texts))
    sets = [{x[i : i + 10] for i in range(len(x) - 9)} for x in names]
    links = [(i, j) for i, j in combinations(range(len(names)), 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    group = grouped_by_links(range(len(names)), links)
    first = {}
    for i, x in enumerate(texts):
        first.setdefault(group[names.index(x)], i)
    rows = line_dedup.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_doc"] for r in rows} == {i: first[group[names.index(x)]] for i, x in enumerate(texts)}
    assert kept[0].count() == kept[0].select("center", "nid").distinct().count() > 8 * 4


def test_stored_rows_leave_no_shuffle_files(spark):
    files = lambda: {str(f) for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    rows = stored(spark.range(1000).withColumn("k", F.col("id") % 7).groupBy("k").count())
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and rows.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
