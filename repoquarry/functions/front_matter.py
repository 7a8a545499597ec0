"""Front matter and flat YAML keys, read with regular expressions (no YAML grammar)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry.functions.text import any_of, strip_space

FENCE = "---"
# fixed values: plain scalars that are false in a condition
_FALSE_SCALARS = ("", "~", "null", "Null", "NULL", "false", "False", "FALSE", "0", "-0", "0.0", ".nan", ".NaN", ".NAN")


def fence_end(content: Column) -> Column:
    """1-based position of the closing fence: the next `---` anywhere after the opening one, else 0."""
    return F.locate(FENCE, content, 4)


def front_matter(content: Column) -> Column:
    """Text between the fences, trimmed; NULL when a fence is missing."""
    end = fence_end(content)
    body = F.substring(content, F.lit(5), F.greatest(end - 5, F.lit(0)))
    return F.when(content.startswith(FENCE) & (end > 0), strip_space(body))


def _inline(text: Column, key: str) -> Column:
    """Text after `key:` on its line, comments removed; NULL when the key is absent."""
    pattern = rf"(?m)^{key}[ \t]*:(?:[ \t]+(.*))?$"
    raw = F.trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\r$", ""))
    quoted = raw.startswith('"') | raw.startswith("'")
    bare = F.trim(F.regexp_replace(raw, r"(^|\s+)#.*$", ""))
    return F.when(text.rlike(pattern), F.when(quoted, raw).otherwise(bare))


def _block_start(text: Column, key: str) -> Column:
    """First character of an indented or dashed block below `key:`; '' without one."""
    pattern = rf"(?m)^{key}[ \t]*:[ \t]*(?:#.*)?\r?\n(?:[ \t]*(?:#.*)?\r?\n)*(?:[ \t]+(?=\S)|(?=-[ \t\r\n]))(\S)"
    return F.regexp_extract(text, pattern, 1)


def value_kind(text: Column, key: str) -> Column:
    """ARRAY, EMPTY_ARRAY, MAP, SCALAR (true in a condition) or NONE."""
    inline, block = _inline(text, key), _block_start(text, key)
    quoted_empty = inline.isin('""', "''")
    return (
        F.when(inline.isNull(), "NONE")
        .when(inline.rlike(r"^\[\s*\]\z"), "EMPTY_ARRAY")
        .when(inline.startswith("["), "ARRAY")
        .when(inline.startswith("{"), "MAP")
        .when((inline == "") & (block == "-"), "ARRAY")
        .when((inline == "") & (block != ""), "MAP")
        .when(quoted_empty | inline.isin(*_FALSE_SCALARS), "NONE")
        .otherwise("SCALAR")
    )


def is_set(text: Column, key: str) -> Column:
    """Present with a value that is true in a condition."""
    return value_kind(text, key) != "NONE"


def scalar(text: Column, key: str) -> Column:
    """Scalar value without its quotes; NULL when absent or not a scalar."""
    inline = _inline(text, key)
    double = (F.char_length(inline) > 1) & any_of(
        [inline.startswith(q) & inline.endswith(q) for q in ('"', "'")]
    )
    bare = F.when(double, F.substring(inline, F.lit(2), F.char_length(inline) - 2)).otherwise(inline)
    return F.when(value_kind(text, key) == "SCALAR", bare)
