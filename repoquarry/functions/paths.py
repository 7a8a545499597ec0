"""Path projections and predicates: extension, depth, test/config/ignore flags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.functions.text import any_of, utf16_prefix


def _alternatives(names) -> str:
    return "|".join(re.escape(name) for name in names)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def local_extension(path: Column) -> Column:
    """Extension with its dot; '' for no dot and for names that start with their only dot."""
    return F.regexp_extract(basename(path), r"(?s)^.+(\.[^.]*)\z", 1)


def remote_extension(path: Column) -> Column:
    """A dot plus whatever follows the last dot of the *whole* path."""
    return F.concat(F.lit("."), F.substring_index(path, ".", -1))


def is_test(path: Column) -> Column:
    normal = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    return any_of(
        [normal.contains(marker) for marker in rules.TEST_MARKERS]
        + [normal.startswith(prefix) for prefix in rules.TEST_DIRS]
    )


def is_config(path: Column) -> Column:
    name = basename(path)
    return any_of(
        [path.contains(known) for known in rules.CONFIG_NAMES]
        + [name.rlike(pattern) for pattern in rules.CONFIG_REGEXES]
    )


def is_ignored(path: Column, mode: str = "local") -> Column:
    """Ignore list.  `local` prunes the directories at any depth, `remote` only at the root."""
    if mode == "local":
        inside = path.rlike(rf"(^|/)({_alternatives(rules.IGNORED_DIRS)})/")
        name = basename(path)
        return inside | name.isin(".env", *rules.IGNORED_LOCK_FILES) | path.endswith(".lock")
    inside = any_of([path.startswith(f"{name}/") for name in rules.IGNORED_DIRS])
    return inside | any_of([path.endswith(end) for end in (".lock", *rules.IGNORED_LOCK_FILES)])


def is_hidden(path: Column) -> Column:
    """True when any path segment starts with a dot."""
    return path.startswith(".") | path.contains("/.")


def depth(path: Column, sep: str = "/") -> Column:
    return F.size(F.split(path, re.escape(sep))).cast("long")


def first_segment(path: Column, sep: str = "/") -> Column:
    """Top-level directory, NULL for files at the root."""
    return F.when(path.contains(sep), F.substring_index(path, sep, 1))


def second_segment(path: Column, sep: str = "/") -> Column:
    """Second-level directory, NULL unless the path has at least three segments."""
    parts = F.split(path, re.escape(sep))
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1)))


def truncate_content(content: Column, mode: str = "local") -> Column:
    limit = rules.LOCAL_TEXT_LIMIT if mode == "local" else rules.REMOTE_TEXT_LIMIT
    return utf16_prefix(content, limit)
