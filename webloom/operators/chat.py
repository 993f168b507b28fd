"""Chat texts, token counts and prompt datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text as X
from webloom.operators import pages as P

TURNS_PER_PART = 1000

SYSTEM_TEXTS = {
    "type": "Write one extraction rule as JSON. Choose selectors by the kind of content, so the rule fits every page of this kind.",
    "position": "Write one extraction rule as JSON. Choose selectors by the place of the content in this page.",
}


def message_text(role: Column, content: Column, tool_call_id: Column | None = None, name: Column | None = None) -> Column:
    header = role
    if tool_call_id is not None or name is not None:
        tool = F.lit(None).cast("string") if tool_call_id is None else tool_call_id
        who = F.lit(None).cast("string") if name is None else name
        header = (
            F.when(tool.isNotNull(), F.concat(role, F.lit(" to="), tool))
            .when(who.isNotNull(), F.concat(role, F.lit(" name="), who))
            .otherwise(role)
        )
    return F.concat(F.lit("<|im_start|>"), header, F.lit("\n"), content, F.lit("<|im_end|>"))


def chatml(df: DataFrame) -> DataFrame:
    """One text per conversation of ``(conv_id, turn, role, content[, tool_call_id, name])``.

    Turns are joined in parts of a thousand first, parts then in order, so no
    task holds the single messages of a long conversation.
    """
    extra = {c: F.col(c) for c in ("tool_call_id", "name") if c in df.columns}
    messages = df.select("conv_id", "turn", message_text(F.col("role"), F.col("content"), **extra).alias("m"))
    parts = messages.groupBy("conv_id", F.floor(F.col("turn") / TURNS_PER_PART).alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("turn", "m")))["m"], "\n").alias("text"), F.count(F.lit(1)).alias("n")
    )
    return parts.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("part", "text")))["text"], "\n").alias("chatml"), F.sum("n").alias("turns")
    )


def token_counts(
    df: DataFrame,
    by: Sequence[str],
    text_col: str = "text",
    counter: Callable[[Column], Column] = X.word_count,
    name: str = "words_and_marks",
) -> DataFrame:
    """Tokens per group; the column is named after what is counted."""
    return df.groupBy(*by).agg(F.sum(counter(F.col(text_col))).alias(name), F.count(F.lit(1)).alias("texts"))


def prompt_dataset(pages: DataFrame, wanted: DataFrame, mode: str = "type", tier: str = "canonical", system: str | None = None) -> DataFrame:
    """One prompt per page with text: cleaned markup, URL, wanted fields.

    ``wanted`` is (page_id, position, field); a page without rows asks for no
    field by name.
    """
    cleaned = P.clean_html(pages.where(~P.is_blank(F.col("html"))), tier)
    field = X.printable(F.col("field"))
    asked = (
        wanted.select("page_id", "position", field.alias("field"))
        .where("field <> ''")
        .groupBy("page_id")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("position", "field")))["field"], ", ").alias("fields"))
    )
    user = F.concat(
        F.lit("URL: "),
        F.regexp_replace("url", r"[\x00-\x1f\x7f]", ""),
        F.lit("\nFields: "),
        F.coalesce("fields", F.lit("detect them")),
        F.lit("\n\n<html_source>\n"),
        F.col("cleaned"),
        F.lit("\n</html_source>\n\nRule as JSON:"),
    )
    system_text = F.lit(system or SYSTEM_TEXTS[mode])
    prompt = F.concat_ws("\n", message_text(F.lit("system"), system_text), message_text(F.lit("user"), user))
    return (
        cleaned.join(asked, "page_id", "left")
        .select("page_id", "url", F.coalesce("fields", F.lit("")).alias("fields"), prompt.alias("prompt"))
        .withColumn("words_and_marks", X.word_count(F.col("prompt")))
    )
