"""Text expressions. White space means the Unicode classes, as in Python's ``str``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"
_BLANK = r"[[\s\x1c-\x1f]&&[^\n]]"
_LINE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# Fixed value: line added below a text that was cut.
CUT_MARKER = "\n…[已截断]"

# Bidi controls, isolates, C0 without tab and newline, interlinear marks.
HIDDEN_CONTROLS = (
    r"[\u202A-\u202E\u061C\u200E\u200F\u2066-\u2069"
    r"\x00-\x08\x0B-\x1F\x7F\uFFF9-\uFFFB]"
)
# Tab, newline and these categories are printable; chat and CDATA marks are not wanted.
NOT_PRINTABLE = r"[^\p{L}\p{N}\p{P}\p{S}\p{M}\p{Zs}\t\n]"
PROMPT_MARKS = r"<\|im_start\|>|<\|im_end\|>|<!\[CDATA\[|\]\]>"


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}++|{_SPACE}++$", "")


def collapse_space(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){_SPACE}++", " "))


def clean_lines(c: Column) -> Column:
    """Trimmed lines without the empty ones."""
    lines = F.translate(c, _LINE_BREAKS, "\n" * len(_LINE_BREAKS))
    lines = F.regexp_replace(lines, rf"(?U)(?<!{_BLANK}){_BLANK}*+\n{_SPACE}*+", "\n")
    return strip_space(lines)


def cut_chars(c: Column, limit: int | None, marker: str = "") -> Column:
    """At most ``limit`` characters and then the marker; the text itself without a limit."""
    if limit is None:
        return c
    cut = F.concat(F.substring(c, 1, limit), F.lit(marker))
    return F.when(F.length(c) > limit, cut).otherwise(c)


def cut_bytes(c: Column, limit: int | None) -> Column:
    """At most ``limit`` bytes of UTF-8, never ending inside a character; the text itself without a limit."""
    if limit is None:
        return c
    raw = F.encode(c, "UTF-8")

    def starts_char(at: int) -> Column:
        return ~F.hex(F.substring(raw, at, 1)).between("80", "BF")

    # The last place, at most three bytes back, where a character starts right after the cut.
    keep = F.when(starts_char(limit + 1), limit)
    for back in (1, 2):
        keep = keep.when(starts_char(limit + 1 - back), limit - back)
    cut = F.decode(F.substring(raw, F.lit(1), keep.otherwise(limit - 3)), "UTF-8")
    return F.when(F.octet_length(c) > limit, cut).otherwise(c)


def remove_hidden_controls(c: Column) -> Column:
    return F.regexp_replace(c, HIDDEN_CONTROLS, "")


def printable(c: Column) -> Column:
    """Printable text without prompt marks, white space collapsed."""
    return collapse_space(F.regexp_replace(F.regexp_replace(c, NOT_PRINTABLE, ""), PROMPT_MARKS, " "))


def word_count(c: Column) -> Column:
    """Words and single marks; the default token counter."""
    return F.regexp_count(c, F.lit(r"(?U)\w+|[^\w\s]"))
