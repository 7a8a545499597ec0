"""JSON text to VARIANT under JSON.parse rules, and script-style truth and text of values."""

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from repoquarry.functions.staging import evaluate_once
from repoquarry.functions.text import non_empty


def _canonical_json():
    """Arrow-batched UDF: canonical JSON text, NULL for anything JSON.parse rejects."""

    # nested on purpose: executors get the function by value and need no copy of this package
    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def reject(token):
            raise ValueError(token)

        def convert(text):
            if text is None:
                return None
            try:
                return json.dumps(json.loads(text, parse_constant=reject), ensure_ascii=False)
            except (ValueError, RecursionError):
                return None

        for batch in batches:
            yield pd.Series([convert(text) for text in batch], dtype=object)

    return F.pandas_udf(canonical, T.StringType())


def with_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add VARIANT column `out` parsed from string column `text`; NULL where it is not valid JSON.

    `try_parse_json` alone is too lax (it ignores text after the value) and too
    strict (it refuses repeated keys).  The value is therefore parsed as the
    first element of `[value, "<md5 of the text>"]`: the marker is only reached
    when nothing but the value precedes it.  What that refuses, malformed texts
    and repeated keys, is all that travels to the Arrow UDF; for the other rows
    the UDF column is NULL and the work stays in the JVM.
    """
    raw, rest, mark = "__json_raw", "__json_rest", "__json_mark"
    source, marker = F.col(text), F.col(mark)
    marked = evaluate_once(df, mark, F.md5(source))
    parsed = evaluate_once(
        marked, raw, F.try_parse_json(F.concat(F.lit("["), source, F.lit(',"'), marker, F.lit('"]')))
    )
    fits = (
        (F.try_variant_get(F.col(raw), "$[1]", "string") == marker)
        & F.try_variant_get(F.col(raw), "$[2]", "variant").isNull()
    )
    parsed = evaluate_once(parsed, out, F.when(fits, F.try_variant_get(F.col(raw), "$[0]", "variant"))).drop(raw, mark)
    parsed = parsed.withColumn(rest, _canonical_json()(F.when(F.col(out).isNull(), source)))
    whole = F.coalesce(F.col(out), F.try_parse_json(F.col(rest)))
    kept = [column for column in parsed.columns if column not in (out, rest)]
    return evaluate_once(parsed, "__json_whole", whole).select(*kept, F.col("__json_whole").alias(out))


def field(value: Column, name: str) -> Column:
    """Member of an object as VARIANT; SQL NULL when the key is absent."""
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def elements(value: Column) -> Column:
    """Elements of an array value; NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def elements_of(value: Column, name: str) -> Column:
    """Elements of an array member of an object; NULL for anything else.  Unlike `elements` of `field`, copies them once."""
    return F.try_variant_get(value, f'$["{name}"]', "array<variant>")


def _members(names: Sequence[str]) -> str:
    return f"struct<{','.join(f'`{name}`:variant' for name in names)}>"


def members(value: Column, names: Sequence[str]) -> Column:
    """Some members of an object as a struct, absent ones NULL; NULL for anything but an object.  One pass, however many are read."""
    return F.try_variant_get(value, "$", _members(names))


def members_of_each(value: Column, name: str, names: Sequence[str]) -> Column:
    """`members` of every element of an array member of an object; NULL where there is no such array."""
    return F.try_variant_get(value, f'$["{name}"]', f"array<{_members(names)}>")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<>").isNotNull()


def is_array(value: Column, path: str = "$") -> Column:
    """Whether there is an array at the path, found without a look into its elements."""
    return F.try_variant_get(value, path, "array<struct<>>").isNotNull()


def is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a numeric type name; SQL NULL when absent."""
    return F.substring_index(F.substring_index(F.schema_of_variant(value), "<", 1), "(", 1)


def text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def truthy(value: Column) -> Column:
    """Script truth: absent, null, false, 0 and '' are false."""
    return ~F.coalesce(F.to_json(value), F.lit("null")).rlike(r'^(null|false|""|-?0(\.0*)?(E.*)?)\z')


def _plain(value: Column) -> Column:
    # numbers lose trailing zeros of the fraction; true, false and null print as in JSON
    return F.regexp_replace(F.to_json(value), r"^(-?[0-9]+)(?:\.0*|(\.[0-9]*?[1-9])0*)\z", "$1$2")


def _scalar_string(value: Column) -> Column:
    return (
        F.when(kind(value) == "STRING", text_of(value))
        .when(kind(value) == "OBJECT", "[object Object]")
        .otherwise(_plain(value))
    )


def script_string(value: Column) -> Column:
    """String(value): arrays join their elements by comma, objects print as a tag."""
    joined = F.array_join(
        F.transform(elements(value), lambda item: F.when(kind(item) == "VOID", "").otherwise(_scalar_string(item))), ","
    )
    return F.when(kind(value) == "ARRAY", joined).otherwise(_scalar_string(value))


def strings_of(value: Column) -> Column:
    """Array of strings; anything that is not an array gives the empty array."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(elements(value), script_string), none)


def string_or(value: Column, default: Column) -> Column:
    """String(value) when it is truthy, else the default."""
    text = F.when(kind(value) == "STRING", text_of(value)).when(truthy(value), script_string(value))
    return F.coalesce(non_empty(text), default)
