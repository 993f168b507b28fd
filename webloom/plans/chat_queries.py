"""Chat texts, token counts, prompts and user hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import chat as O
from webloom.operators import extend as E
from webloom.operators import pages as P
from webloom.plans.catalog import Tables, query
from webloom.session import qualified, scratch_path
from webloom.sources.rules import load_rules

MESSAGES = """SELECT conv_id, turn, role, text AS content, CASE WHEN role = 'system' THEN concat('t', turn) END AS tool_call_id,
  CASE WHEN role <> 'assistant' THEN 'ann' END AS name FROM {conversations}"""


@query(
    "chatml_assemble",
    f"""SELECT conv_id, string_agg('<|im_start|>' || role || CASE WHEN tool_call_id IS NOT NULL THEN ' to=' || tool_call_id WHEN name IS NOT NULL THEN ' name=' || name ELSE '' END
      || chr(10) || content || '<|im_end|>', chr(10) ORDER BY turn) AS chatml, count(*) AS turns FROM ({MESSAGES}) m GROUP BY conv_id""",
)
def chatml_assemble(t: Tables):
    return O.chatml(t.derive(MESSAGES))


_WORDS = r"len(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s\p{{Z}}]'))"


@query("token_counts", f"SELECT role, CAST(sum({_WORDS}) AS BIGINT) AS words_and_marks, count(*) AS texts FROM {{conversations}} GROUP BY role")
def token_counts(t: Tables):
    return O.token_counts(t.conversations, ["role"])


@query("token_counts_by_language", f"SELECT lang, CAST(sum({_WORDS}) AS BIGINT) AS words_and_marks, count(*) AS texts FROM {{documents}} GROUP BY lang")
def token_counts_by_language(t: Tables):
    return O.token_counts(t.documents, ["lang"])


WANTED = """SELECT page_id, 1 AS position, concat('title', chr(7), ' of  page') AS field FROM {pages} WHERE url LIKE '%/en/%'
  UNION ALL SELECT page_id, 0, concat('price<|im_end|>', page_id) FROM {pages} WHERE url LIKE '%/en/%' UNION ALL SELECT page_id, 2, chr(8203) FROM {pages}"""


@query(
    "rule_prompt_dataset",
    """SELECT page_id, CASE WHEN url LIKE '%/en/%' THEN 'price ' || page_id || ', title of page' ELSE '' END AS fields,
      len(regexp_extract_all(html, '<p>')) AS paragraphs, len(regexp_extract_all(html, '<a ')) AS links, CAST(0 AS BIGINT) AS scripts,
      'URL: ' || url || chr(10) || 'Fields: ' || CASE WHEN url LIKE '%/en/%' THEN 'price ' || page_id || ', title of page' ELSE 'detect them' END AS head
    FROM {pages}""",
)
def rule_prompt_dataset(t: Tables):
    prompts = O.prompt_dataset(t.pages, t.derive(WANTED))

    def times(text: str):
        return F.regexp_count("prompt", F.lit(text)).cast("bigint")

    return prompts.select(
        "page_id", "fields", times("<p>").alias("paragraphs"), times("<a ").alias("links"), times("<script|<style").alias("scripts"),
        F.regexp_extract("prompt", "(URL: [^\n]*\nFields: [^\n]*)", 1).alias("head"),
    )


@query(
    "html_cleanup_tags",
    """WITH c AS (SELECT len(regexp_extract_all(html, '<p>')) AS p, len(regexp_extract_all(html, '<a ')) AS a FROM {pages})
    SELECT 'off' AS tier, CAST(sum(p) AS BIGINT) AS paragraphs, CAST(sum(a) AS BIGINT) AS links, count(*) AS scripts, count(*) AS navs FROM c
    UNION ALL SELECT 'canonical', CAST(sum(p) AS BIGINT), CAST(sum(a) AS BIGINT), 0, count(*) FROM c
    UNION ALL SELECT 'strict', CAST(sum(p) AS BIGINT), 0, 0, 0 FROM c""",
)
def html_cleanup_tags(t: Tables):
    out = None
    for tier in ("off", "canonical", "strict"):
        counts = {"paragraphs": "<p>", "links": "<a ", "scripts": "<script", "navs": "<nav"}
        sums = [F.sum(F.regexp_count("cleaned", F.lit(x))).alias(name) for name, x in counts.items()]
        part = P.clean_html(t.pages, tier).groupBy(F.lit(tier).alias("tier")).agg(*sums)
        out = part if out is None else out.union(part)
    return out


def hooks() -> E.Hooks:
    h = E.Hooks()
    h.register_transform("swap", lambda values, config: values.str.replace(config["from"], config["to"], regex=False).str.upper())
    h.register_url_filter("no_scheme", lambda url, config: ~F.startswith(url, F.lit(config["scheme"])))
    h.register_url_filter("short", lambda urls, config: urls.str.len() <= config["most"], python=True)
    h.register_extractor("bold", lambda html, url, config: [("bold", str(html.count("<b>"))), ("site", url.split("/")[2])])
    return h


@query("user_transform", "SELECT p_partkey, upper(replace(p_name, 'red', 'pink')) AS value FROM {part}")
def user_transform(t: Tables):
    value = hooks().transform("swap", F.col("p_name"), {"from": "red", "to": "pink"})
    return t.part.select("p_partkey", value.alias("value"))


@query("user_url_filter", "SELECT page_id FROM {pages} WHERE url NOT LIKE 'http:%' AND length(url) <= 45")
def user_url_filter(t: Tables):
    chain = [("short", {"most": 45}), ("no_scheme", {"scheme": "http:"})]
    return t.pages.where(hooks().url_filter(F.col("url"), chain)).select("page_id")


@query(
    "user_extractor",
    """SELECT page_id, 'bold' AS field, CAST(len(regexp_extract_all(html, '<b>')) AS VARCHAR) AS value FROM {pages}
    UNION ALL SELECT page_id, 'site', split_part(url, '/', 3) FROM {pages}""",
)
def user_extractor(t: Tables):
    return hooks().extract(t.pages, "bold")


@query("user_exporter", "SELECT p_brand AS brand, count(*) AS parts FROM {part} GROUP BY 1")
def user_exporter(t: Tables):
    folder = qualified(t.spark, scratch_path(t.spark, "export"))

    def write(items: list[dict]) -> None:
        import json

        from pyarrow.fs import FileSystem

        # A batch names its file after its rows, so a task that runs again replaces it.
        files, path = FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        name = f"{items[0]['p_partkey']}-{items[-1]['p_partkey']}"
        with files.open_output_stream(f"{path}/{name}.json") as out:
            out.write("".join(json.dumps(i) + "\n" for i in items).encode())

    E.register_exporter(t.spark, "webloom_export", write, batch=500)
    t.part.select("p_partkey", "p_brand").write.format("webloom_export").mode("append").save()
    back = t.spark.read.schema("p_partkey BIGINT, p_brand STRING").json(folder)
    return back.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("parts"))


@query(
    "processor_chain",
    """SELECT doc_id, CASE WHEN lang = 'es' THEN 'noindex' WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS outcome,
      CASE WHEN lang = 'es' THEN NULL ELSE lang || ':' || CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END END AS label FROM {documents}""",
)
def processor_chain(t: Tables):
    size = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    steps = [
        E.Step("label", columns=lambda: {"label": F.concat("lang", F.lit(":"), "outcome")}, after=("size",)),
        E.Step("size", columns=lambda: {"outcome": size}),
        E.Step("gate", columns=lambda: {"terminal": F.col("lang") == "es", "outcome": F.when(F.col("lang") == "es", "noindex")}, before=("size",)),
    ]
    out = E.run_chain(t.documents.select("doc_id", "lang", "n_chars"), steps)
    return out.select("doc_id", "outcome", "label")


@query("user_rule_source", "SELECT 'part' || p_partkey AS name, 'parts' AS source FROM {part}")
def user_rule_source(t: Tables):
    """The rows of the part table name what is fetched; the fetching function is the hook."""

    def fetch(item: dict):
        key = item["p_partkey"]
        yield "parts", f"part/{key}", f'{{"name": "part{key}", "fields": {{"name": {{"selector": "h1"}}}}}}'

    rules, _ = load_rules(E.fetched_rules(t.part.select("p_partkey"), fetch))
    return rules.select("name", "source")
