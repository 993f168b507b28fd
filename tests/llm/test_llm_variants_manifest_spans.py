"""Spelling variants, Merkle manifests and personal data against plain versions on small inputs."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.llm import merkle, personal_data, spelling
from webloom.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# spelling variants


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in around.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    rows = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, len(around[w]), words[form[w]] if form[w] else None))
    return rows


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("letters", ["ab", "abcÉü"])
def test_variants_as_brute_force(spark, letters):
    rng = random.Random(letters)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(150)]
    docs = []
    for i in range(120):
        text = " ".join(rng.choice(words[: rng.choice((3, 20, 150))]) for _ in range(rng.randint(0, 60)))
        docs.append((None if i % 17 == 0 else i % 90, rng.choice((text, text.upper(), text.replace(" ", "\n1")))))
    docs += [(1, None), (2, ""), (3, "\x00 a"), (4, "×÷ÀÿĀ " * 7)]
    df = spark.createDataFrame([(*d, "x", "y", 0) for d in docs], DOCS)
    assert rows_of(spelling.variants(df)) == plain_variants(docs)


@pytest.mark.parametrize("dictionary", [5, 60, 10**6])
def test_near_pairs_whatever_the_dictionary(spark, monkeypatch, dictionary):
    """Few, some and all grams frequent: bounds of none, some and many grams."""
    monkeypatch.setattr(spelling, "DICTIONARY", dictionary)
    rng = random.Random(dictionary)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 10))) for _ in range(700)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    found = {frozenset((r["a"], r["b"])) for r in spelling.near_pairs(df).collect()}
    assert found == {frozenset((a, b)) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}


def test_bound_of_affected_grams():
    """Near words share all grams but the bound; some words are left nothing."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(6, 12))) for _ in range(400)]
    for share in (0.1, 0.5, 1.0):
        kept = [s[i : i + q] for s in texts for q in (2, 3, 4) for i in range(len(s) - q + 1)]
        grams = spelling.Grams({g: n for g, n in Counter(kept).items() if rng.random() < share or len(g) == 2})
        # Prefixes of frequent grams are frequent, as with counts.
        grams = spelling.Grams({g: n for g, n in grams.frequent.items() if all(g[:q] in grams.frequent for q in range(2, len(g)))})
        for s in texts:
            i = rng.randrange(len(s))
            other = rng.choice((s[:i] + s[i + 1 :], s[:i] + "x" + s[i:], s[:i] + "dcba"[i % 4] + s[i + 1 :]))
            a, b = spelling.marked(s), spelling.marked(other)
            shared = sum((Counter(a[x:y] for x, y in grams.cut(a)) & Counter(b[x:y] for x, y in grams.cut(b))).values())
            assert shared >= len(grams.cut(a)) - grams.bound(a, grams.cut(a))
            assert shared >= len(grams.cut(b)) - grams.bound(b, grams.cut(b))


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 50)
    data = ("straße Übung " * 40 + "a" * 300 + " " + "É" * 99).encode().lower()
    found = [run for start, end in spelling.pieces(data) for run in spelling.RUN.findall(data, start, end)]
    assert found == spelling.RUN.findall(data)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc):
    doc_id, text, lang, source, n_chars = doc
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(nodes):
    """The root and every leaf's siblings, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, p in enumerate(at):
            run = nodes[p // 3 * 3 : p // 3 * 3 + 3]
            paths[leaf].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def plain_manifest(docs):
    sources = defaultdict(list)
    for d in docs:
        sources[d[3]].append((d[0] is not None, d[0] or 0, plain_leaf(d)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    subroots, ways = [], []
    for s in order:
        leaves = [x[2] for x in sorted(sources[s])]
        root, paths = plain_tree(leaves)
        subroots.append(root)
        ways.append(list(zip(leaves, paths)))
    root, over = plain_tree(subroots)
    return sorted((leaf, sub, root, path + up) for sub, way, up in zip(subroots, ways, over) for leaf, path in way)


def many_documents(n, sources):
    rng = random.Random(n)
    docs = [(i, rng.choice((None, "", "é\nb", f"text {i}\n\n")), rng.choice(("en", None)), rng.choice(sources), rng.choice((None, i))) for i in range(n)]
    return docs + docs[:3] + docs[:1] * 12 + [(None, "a\nb", None, sources[0], 1)] * 5


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_as_brute_force(spark, monkeypatch, levels):
    """Small blocks: several rounds of exchange, in the trees of the sources and in the root's."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    docs = many_documents(130, ["hot"] * 30 + [None, "", "É", "z", *(f"s{i}" for i in range(9))])
    docs.append((7, "alone", "en", "only one", 5))
    df = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(1) for c in ("tree", "place", "item", "leaf", "root")})
    rows = merkle.manifest(df, given=merkle.leaf_of()).withColumn("back", merkle.folded(F.col("given"), F.col("path"))).collect()
    found = sorted((r["leaf"], r["subroot"], r["root"], [(x["left"], x["right"]) for x in r["path"]]) for r in rows)
    assert found == plain_manifest(docs)
    assert all(r["back"] == r["root"] and r["given"] == r["leaf"] for r in rows)


@pytest.mark.parametrize("changed", ["doc_id", "source", "lang", "n_chars", "text"])
def test_manifest_finds_changes(spark, changed):
    docs = many_documents(20, ["a", "b"])
    other = F.lit(77) if changed in ("doc_id", "n_chars") else F.lit("other")
    rows = merkle.manifest(spark.createDataFrame(docs, DOCS), given=merkle.leaf_of(**{changed: other}))
    assert rows.where(merkle.folded(F.col("given"), F.col("path")) == F.col("root")).count() == 0


def test_manifest_of_one_document(spark):
    (row,) = merkle.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS)).withColumn("proof", merkle.proof_digest(F.col("path"))).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == plain_leaf((1, "a", "en", "s", 1)) and row["path"] == []
    assert row["proof"] == sha("")


# personal data


def plain_base(text):
    """The patterns as they stand, whole matches tested one by one."""
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and plain_luhn(re.sub("[^0-9]", "", m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    )
    return [(kind, m.start(), m.end()) for kind, pattern, fits in rules for m in re.finditer(pattern, text) if fits(m.group())]


def plain_luhn(number):
    total = 0
    for place, c in enumerate(reversed(number)):
        d = int(c) * (1 + place % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_base_spans_as_brute_force():
    rng = random.Random(8)
    parts = ["a@b.c", "@", ".", "-", "+1 (386) 555-3733", "4944339490429605", "4111 1111 1111 1111", "255.1.2.3", "256.1.1.1", "007.0.0.1", "_x%é", "12", " ", "\n", "(", "+", "𝒳", "5", "a.b@c-d.e"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [s[:3] for s in personal_data.spans_of(text) if s[4]] == plain_base(text), text
    for _ in range(4000):
        text = "".join(rng.choice("a@.-+1( 90") for _ in range(rng.randint(0, 40)))
        assert [s[:3] for s in personal_data.spans_of(text) if s[4]] == plain_base(text), text


def added(text):
    return [(k, text[a:b]) for k, a, b, _, base in personal_data.spans_of(text) if not base]


def test_validators_and_context():
    assert added("IBAN DE89 3704 0044 0532 0130 00.") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("see GB29NWBK60161331926819 there") == [("iban", "GB29NWBK60161331926819")]
    assert added("DE88 3704 0044 0532 0130 00") == []
    assert added("Please call 020 7946 0958 today") == [("phone", "020 7946 0958")]
    assert added("Llame al teléfono (030) 901 820.") == [("phone", "(030) 901 820")]
    assert added("rows 020 7946 0958 in all") == []
    assert added("amex card 378282246310005") == [("card", "378282246310005")]
    assert added("order 378282246310005") == [] and added("amex card 378282246310006") == []
    assert added("social security 078-05-1120") == [("identity", "078-05-1120")] and added("part 078-05-1120") == []
    # A span of the base patterns is never taken twice, and a word must be near.
    assert added("phone +1 (386) 555-3733") == []
    assert added("phone " + "x" * 60 + " 020 7946 0958") == []
    spans = personal_data.spans_of("tel 020 7946 0958, +1 (386) 555-3733, a@b.co")
    assert [s[0] for s in spans] == ["email", "phone", "phone"] and spans[1][1] < spans[2][1]


def test_words_nearby_raise_the_score():
    far, by = (personal_data.spans_of(t)[0][3] for t in ("4944339490429605", "card 4944339490429605"))
    assert by == pytest.approx(min(1.0, far + personal_data.CONTEXT))


def test_long_runs_take_linear_time():
    start = time.time()
    for run in ("a", "1", "1.", "a@", "+1", "+1 ", "1-", "(", "ab12", "DE89 ", "12 345 ", "@" * 3 + "a."):
        personal_data.spans_of(run * 200_000)
    assert time.time() - start < 60


def test_spans_of_odd_rows(spark):
    rows = [(None, "a@b.co"), (1, None), (2, ""), (2, "𝒳 a@b.co"), (2, "𝒳 a@b.co")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("other"))
    found = sorted((str(r["doc_id"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in personal_data.found(df).collect())
    assert found == [("1", []), ("2", []), ("2", [(2, 8)]), ("2", [(2, 8)]), ("None", [(0, 6)])]


def test_digests_of_spans(spark):
    """The query on the given tables, row by row."""
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op13_personal_data"](spark, folder).collect()
    assert len(rows) == len(texts) and any(r["n_card"] for r in rows)
    written = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for r in rows:
        base = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == sha(written(base)) and r["spans"] == written(s[:3] for s in personal_data.spans_of(texts[r["doc_id"]]))
