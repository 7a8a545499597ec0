"""Repository URL scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoquarry.functions.text import any_of, non_empty

# fixed values: the three accepted spellings of a hosted repository
_HTTPS = "https://github.com/"
_SSH = "git@github.com:"
_BARE = "github.com/"
_OWNER_REPO = r"github\.com[/:]([\w-]+)/([\w.-]+)"


def is_github_url(url: Column) -> Column:
    return any_of([url.startswith(prefix) for prefix in (_HTTPS, _SSH, _BARE)])


def _drop_git_suffix(col: Column) -> Column:
    return F.when(col.endswith(".git"), F.substring(col, F.lit(1), F.char_length(col) - 4)).otherwise(col)


def normalize_github_url(url: Column) -> Column:
    https = (
        F.when(url.startswith(_BARE), F.concat(F.lit("https://"), url))
        .when(url.startswith(_SSH), F.concat(F.lit(_HTTPS), F.substring(url, F.lit(len(_SSH) + 1), F.char_length(url))))
        .otherwise(url)
    )
    return _drop_git_suffix(https)


def repo_name(url: Column) -> Column:
    return F.coalesce(non_empty(F.substring_index(normalize_github_url(url), "/", -1)), F.lit("repo"))


def parse_github_url(url: Column) -> Column:
    """Struct `(owner, repo, ok)`; unusable input gives NULLs and `ok = false`."""
    hosted = url.contains("github.com")
    matched = url.rlike(_OWNER_REPO)
    parts = F.split(url, "/")
    owner = F.when(hosted & matched, F.regexp_extract(url, _OWNER_REPO, 1)).when(
        ~hosted & url.contains("/"), F.get(parts, F.lit(0))
    )
    repo = F.when(hosted & matched, _drop_git_suffix(F.regexp_extract(url, _OWNER_REPO, 2))).when(
        ~hosted & url.contains("/"), F.get(parts, F.lit(1))
    )
    ok = F.coalesce(F.when(hosted, matched).otherwise(url.contains("/")), F.lit(False))
    return F.struct(owner.alias("owner"), repo.alias("repo"), ok.alias("ok"))
