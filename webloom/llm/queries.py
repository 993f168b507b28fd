"""The registered queries of this subpackage and, where SQL can say them, their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import (
    decontamination, hmm_lm, language_cnn, line_dedup, merkle, minhash_dedup, mixing, personal_data, quality_knn, quality_rules, sharding, spelling,
    url_logistic,
)
from webloom.llm.held_out import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_minhash_dedup",
    r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT DISTINCT doc_id AS x, doc_id AS c FROM documents UNION SELECT u.y, r.c FROM r JOIN u ON r.x = u.x),
c AS (SELECT x, min(c) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id""",
)
def op1(spark, sf_dir):
    return minhash_dedup.near_copies(table(spark, sf_dir, "documents"), width=2)


@query("op2_line_dedup")
def op2(spark, sf_dir):
    rows = line_dedup.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "line_no", "class_doc", "class_line", "kept")


@query(
    "op3_decontamination",
    r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
k AS (SELECT DISTINCT least(5, len(w)) AS k FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS g FROM d, k),
bs AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, unnest([array_to_string(w[i:i + least(5, len(w)) - 1], ' ') for i in range(1, len(w) - least(5, len(w)) + 2)]) AS g FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, any_value(n) AS n_item_shingles, count(*) AS n_shared
FROM ds JOIN bs ON ds.g = bs.g AND ds.k = bs.k JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 100 >= any_value(n) * 80""",
)
def op3(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = language_cnn.predicted(docs, language_cnn.fit(docs))
    return rows.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


@query("op5_sharding")
def op5(spark, sf_dir):
    return sharding.by_equal_text(table(spark, sf_dir, "documents"))


@query(
    "op6_quality_rules",
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, [l for l in string_split(text, chr(10)) if regexp_matches(l, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT r, unnest([{'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]} for i in range(1, len(w) - 1)]) AS x FROM t),
m AS (SELECT r, x.i AS i, count(*) OVER (PARTITION BY r, x.g) AS k FROM g),
c AS (SELECT r, count(DISTINCT i + j) AS n FROM m, (VALUES (0), (1), (2)) AS o(j) WHERE k > 1 GROUP BY r),
q AS (SELECT t.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM t LEFT JOIN c ON c.r = t.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q),
v AS (SELECT r, lang, source, n_words, unnest([{'rule': 'word_length', 'v': 1000 * word_chars // greatest(n_words, 1), 's': 2000}, {'rule': 'symbols', 'v': 1000 * n_symbols // greatest(n_words, 1), 's': 150},
    {'rule': 'marks', 'v': 1000 * n_marks // greatest(n_words, 1), 's': 300}, {'rule': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_lines, 1), 's': 300},
    {'rule': 'repeats', 'v': 1000 * n_repeat_words // greatest(n_words, 1), 's': 250}], recursive := true) FROM f),
h AS (SELECT *, greatest(length(bin(v)) - 5, 0) AS e FROM v),
b AS (SELECT *, e * 16 + (v >> e) AS bin, ((((v >> e) + 1) << e) - 1) AS top FROM h),
a AS (SELECT lang, source, rule, bin, any_value(top) AS top, any_value(s) AS s, count(*) AS n FROM b WHERE n_words > 0 GROUP BY lang, source, rule, bin),
al AS (SELECT rule, bin, any_value(top) AS top, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY rule) AS docs FROM a GROUP BY rule, bin),
la AS (SELECT lang, rule, bin, sum(n) AS n FROM a GROUP BY lang, rule, bin),
ld AS (SELECT lang, rule, sum(n) AS docs FROM la GROUP BY lang, rule),
pr AS (SELECT ld.lang, ld.rule, al.bin, al.top, CAST(floor(CAST(100000000 AS DOUBLE) * (coalesce(la.n, 0) + CAST(100 * al.n AS DOUBLE) / al.docs) / (ld.docs + 100)) AS BIGINT) AS w
  FROM ld JOIN al ON al.rule = ld.rule LEFT JOIN la ON la.rule = ld.rule AND la.bin = al.bin AND la.lang IS NOT DISTINCT FROM ld.lang),
u AS (SELECT lang, source, rule, any_value(s) AS s FROM a GROUP BY lang, source, rule),
k AS (SELECT lang, source, rule, bin, top, CAST(n * 1000000 AS BIGINT) AS w FROM a
  UNION ALL SELECT u.lang, u.source, u.rule, bin, top, w FROM u JOIN pr ON pr.rule = u.rule AND pr.lang IS NOT DISTINCT FROM u.lang),
o AS (SELECT *, sum(w) OVER (PARTITION BY lang, source, rule ORDER BY bin) AS upto, sum(w) OVER (PARTITION BY lang, source, rule) AS docs FROM k),
p AS (SELECT lang, source, rule, min(CASE WHEN upto * 4 >= docs THEN top END) AS q1, min(CASE WHEN upto * 4 >= docs * 3 THEN top END) AS q3 FROM o GROUP BY lang, source, rule),
x AS (SELECT u.lang, u.source, u.rule, p.q3 + 3 * (p.q3 - p.q1) + s AS most
  FROM u JOIN p ON p.rule = u.rule AND p.lang IS NOT DISTINCT FROM u.lang AND p.source IS NOT DISTINCT FROM u.source),
z AS (SELECT h.r, bool_and(h.v <= x.most) AS fine FROM h JOIN x ON h.rule = x.rule AND h.lang IS NOT DISTINCT FROM x.lang AND h.source IS NOT DISTINCT FROM x.source GROUP BY h.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(z.fine, false) AS kept FROM f LEFT JOIN z ON z.r = f.r""",
)
def op6(spark, sf_dir):
    rows = quality_rules.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_lm_score")
def op7(spark, sf_dir):
    return hmm_lm.scored(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


@query(
    "op8_mixing",
    r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][sid % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap,
    [1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE][sid % 3 + 1] AS w0, [0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE][sid % 3 + 1] AS w1 FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT l.*, least(cap, weight * coalesce((SELECT o.level FROM l AS o WHERE o.cap / o.weight >= o.level ORDER BY o.cap / o.weight, o.sid LIMIT 1), 0)) AS target,
    (w1 - w0) / (w1 + w0) AS slope FROM l),
c AS (SELECT doc_id, size, source_size, target, slope,
    coalesce(sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS m
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN size > 0 AND m < target THEN 1 ELSE 0 END + CASE WHEN size > 0 AND m + source_size < target THEN 1 ELSE 0 END AS passes FROM c)
SELECT doc_id, size, source_size, target, CAST(passes * size AS BIGINT) AS taken, passes,
  CASE WHEN passes > 0 THEN round(CASE WHEN abs(slope) < 1e-9 THEN m / target
    ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * m / target) - (1 - slope)) / (2 * slope) END, 6) END AS position
FROM p""",
)
def op8(spark, sf_dir):
    return mixing.mixed(table(spark, sf_dir, "documents"))


@query("op9_url_filter")
def op9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_logistic.judged(pages, url_logistic.labels(spark))


@query("op10_quality_knn")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = quality_knn.scored(docs, quality_knn.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


# Unsigned crc32 of hex-written bytes, as DuckDB expressions.
CRC_TABLE = """t AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS t FROM range(256) AS r(i))"""


@query(
    "op11_spelling_variants",
    rf"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
c AS (SELECT doc_id, w, count(*) AS n, any_value(hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM r GROUP BY doc_id, w),
h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, [('0x' || substr(x, 2 * i + 1, 2))::UBIGINT for i in range(len(x) // 2)]),
    lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255)::BIGINT + 1]))) AS h FROM c, t WHERE length(w) >= 6),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, length(word) AS len, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM w, LATERAL unnest(range(1, length(word) + 1)) AS u(i)),
p AS (SELECT a.word AS x, b.word AS y FROM d AS a JOIN d AS b ON a.cut = b.cut AND a.i = b.i AND a.word < b.word
  UNION SELECT w.word, d.word FROM w JOIN d ON w.word = d.cut),
b AS (SELECT x AS word, y AS other FROM p UNION SELECT y, x FROM p),
f AS (SELECT b.word, count(*) AS n_near, min(struct_pack(k := -o.n, w := b.other)) AS best FROM b JOIN w AS o ON o.word = b.other GROUP BY b.word),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.k >= 5 * w.n THEN best.w END AS form, CASE WHEN -best.k >= 5 * w.n THEN -best.k END AS form_n
  FROM w LEFT JOIN f ON f.word = w.word),
e AS (SELECT word, form AS goal, 1 AS step FROM g WHERE form IS NOT NULL UNION ALL SELECT e.word, g.form, step + 1 FROM e JOIN g ON g.word = e.goal WHERE g.form IS NOT NULL),
z AS (SELECT word, arg_max(goal, step) AS root FROM e GROUP BY word)
SELECT g.word, form, coalesce(z.root, g.word) AS root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM g LEFT JOIN z ON z.word = g.word""",
)
def op11(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


ENCODED = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR) END"
LEAF = "sha256(" + " || ".join(ENCODED.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"


@query(
    "op12_merkle_manifest",
    f"""
WITH RECURSIVE {CRC_TABLE},
l AS (SELECT doc_id, source, {LEAF.format(ENCODED.format("text"))} AS leaf, {LEAF.format(ENCODED.format("replace(text, chr(10), '')"))} AS other,
  xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, [ord(CAST(doc_id AS VARCHAR)[i])::UBIGINT for i in range(1, length(CAST(doc_id AS VARCHAR)) + 1)]),
    lambda c, b: xor(c >> 8, t.t[(xor(c, b) & 255)::BIGINT + 1]))) % 2 = 0 AS tampered FROM documents, t),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS r, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree FROM l),
q AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY r) - 1 AS p FROM r),
n AS (SELECT 0 AS level, tree, p, leaf AS h, count(*) OVER (PARTITION BY tree) AS size FROM q
  UNION ALL SELECT level + 1, tree, p // 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(size) + 2) // 3 FROM n WHERE size > 1 GROUP BY level, tree, p // 3),
s AS (SELECT tree, tree - 1 AS p, h FROM n WHERE size = 1),
m AS (SELECT 0 AS level, p, h, count(*) OVER () AS size FROM s
  UNION ALL SELECT level + 1, p // 3, sha256(string_agg(h, '' ORDER BY p)), (any_value(size) + 2) // 3 FROM m WHERE size > 1 GROUP BY level, p // 3),
a AS (SELECT q.r, n.level, 0 AS part, coalesce(string_agg(n.h, '' ORDER BY n.p) FILTER (WHERE n.p < q.p // CAST(pow(3, n.level) AS BIGINT)), '') AS lefts,
    coalesce(string_agg(n.h, '' ORDER BY n.p) FILTER (WHERE n.p > q.p // CAST(pow(3, n.level) AS BIGINT)), '') AS rights
  FROM q JOIN n ON n.tree = q.tree AND n.p // 3 = q.p // CAST(pow(3, n.level + 1) AS BIGINT) WHERE n.size > 1 GROUP BY q.r, n.level
  UNION ALL SELECT q.r, m.level, 1, coalesce(string_agg(m.h, '' ORDER BY m.p) FILTER (WHERE m.p < (q.tree - 1) // CAST(pow(3, m.level) AS BIGINT)), ''),
    coalesce(string_agg(m.h, '' ORDER BY m.p) FILTER (WHERE m.p > (q.tree - 1) // CAST(pow(3, m.level) AS BIGINT)), '')
  FROM q JOIN m ON m.p // 3 = (q.tree - 1) // CAST(pow(3, m.level + 1) AS BIGINT) WHERE m.size > 1 GROUP BY q.r, m.level),
w AS (SELECT r, list([lefts, rights] ORDER BY part, level) AS path FROM a GROUP BY r),
x AS (SELECT q.*, s.h AS subroot, (SELECT h FROM m WHERE size = 1) AS root, coalesce(path, []) AS path, CASE WHEN tampered THEN other ELSE leaf END AS start
  FROM q JOIN s ON s.tree = q.tree LEFT JOIN w ON w.r = q.r),
y AS (SELECT r, 0 AS i, start AS h, path FROM x UNION ALL SELECT r, i + 1, sha256(path[i + 1][1] || h || path[i + 1][2]), path FROM y WHERE i < len(path)),
z AS (SELECT r, h AS folded_root FROM y WHERE i = len(path))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string([g[1] || g[2] for g in path], '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM x JOIN z ON z.r = x.r""",
)
def op12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    without_breaks = merkle.leaf_of(text=F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle.manifest(docs, given=F.when(tampered, without_breaks).otherwise(merkle.leaf_of()))
    rows = rows.withColumn("folded_root", merkle.folded(F.col("given"), F.col("path"))).withColumn("proof_sha256", merkle.proof_digest(F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_personal_data")
def op13(spark, sf_dir):
    rows = personal_data.found(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("email", "ip", "card", "phone")]
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return rows.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"))
