"""String helpers as `Column -> Column` functions (no Python in the data path)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry import rules

# White space as ECMAScript defines it; Spark's own trim() only strips U+0020.
WIDE_SPACE = r"[\s\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def any_of(conditions) -> Column:
    """OR together a non-empty list of predicates."""
    return reduce(lambda left, right: left | right, conditions)


def strip_space(col: Column) -> Column:
    """Trim every leading and trailing white-space character, line breaks included."""
    return F.regexp_replace(F.regexp_replace(col, rf"^{WIDE_SPACE}+", ""), rf"{WIDE_SPACE}+\z", "")


def non_empty(col: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(col, F.lit(""))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 code units (an astral character counts as two)."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def utf16_prefix(col: Column, units: int) -> Column:
    """First `units` UTF-16 code units; a pair cut in half becomes U+FFFD.

    Texts whose code points fit and hold no astral characters near the limit
    take the plain `substring` path.
    """
    raw = F.encode(col, "UTF-16BE")
    last_unit = F.substring(raw, 2 * units - 1, 1)
    cut_pair = (F.hex(last_unit) >= "D8") & (F.hex(last_unit) <= "DB")
    exact = F.when(
        cut_pair,
        F.concat(F.decode(F.substring(raw, 1, 2 * units - 2), "UTF-16BE"), F.lit("\ufffd")),
    ).otherwise(F.decode(F.substring(raw, 1, 2 * units), "UTF-16BE"))
    return (
        F.when(F.octet_length(col) <= units, col)
        .when(utf16_length(col) == F.char_length(col), F.substring(col, 1, units))
        .when(utf16_length(col) <= units, col)
        .otherwise(exact)
    )


def sanitize_name(col: Column) -> Column:
    """File-name form: lower case, everything outside `[a-z0-9]` becomes `-` (two for an astral character)."""
    astral = F.regexp_replace(F.lower(col), r"[\x{10000}-\x{10FFFF}]", "--")
    return F.coalesce(non_empty(F.regexp_replace(astral, "[^a-z0-9]", "-")), F.lit("repo"))


def title_case(col: Column) -> Column:
    """`auth-login` -> `Auth Login`; only the first letter of each part changes."""
    return F.array_join(
        F.transform(
            F.split(col, "-"),
            lambda word: F.concat(
                F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.char_length(word))
            ),
        ),
        " ",
    )


def yaml_quote(col: Column) -> Column:
    """Double-quote a scalar that holds YAML syntax or starts with a quote."""
    special = col.rlike(r"[:#{}\[\]&*?|>!%@`]") | col.startswith("'") | col.startswith('"')
    escaped = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(special, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(col)


def category_description(col: Column) -> Column:
    """One line of text per skill category."""
    chain = reduce(
        lambda acc, pair: acc.when(col == pair[0], pair[1]),
        rules.CATEGORY_DESCRIPTIONS[1:],
        F.when(col == rules.CATEGORY_DESCRIPTIONS[0][0], rules.CATEGORY_DESCRIPTIONS[0][1]),
    )
    return chain.otherwise(rules.CATEGORY_FALLBACK)


def json_string(col: Column) -> Column:
    """Quote and escape one string as a JSON literal."""
    quoted = F.to_json(F.array(col))
    return F.substring(quoted, F.lit(2), F.char_length(quoted) - 2)
