"""Per-repository profile: language, framework, source directories, domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from repoquarry import rules
from repoquarry.functions import json_values as js
from repoquarry.functions import paths
from repoquarry.operators.grouping import SALTS, top_k_per_group

UNKNOWN_LANGUAGE = "Unknown"
MANIFEST_COLUMNS = ("node", "python", "golang")


def _language_table(mode: str):
    skipped = rules.REMOTE_UNSUPPORTED_EXTENSIONS if mode == "remote" else ()
    return [pair for pair in rules.LANGUAGE_BY_EXTENSION if pair[0] not in skipped]


def language_aggregates(mode: str = "local") -> list[Column]:
    """Fixed-width vote: one counter per known extension, so any `groupBy` combines map-side."""
    path = F.col("path")
    extension = paths.local_extension(path) if mode == "local" else paths.remote_extension(path)
    votes = []
    for rank, (ext, _) in enumerate(_language_table(mode)):
        hit = extension == ext
        votes.append(F.count_if(hit).alias(f"votes_{rank}"))
        if mode == "remote":
            votes.append(F.min(F.when(hit, F.col("ord"))).alias(f"first_{rank}"))
    return [*votes, F.bool_or(path.contains("tsconfig")).alias("has_tsconfig")]


def language_of_votes(mode: str = "local") -> Column:
    """Winning language from the counters: most votes, then table order or first seen."""
    ballots = []
    for rank, (_, language) in enumerate(_language_table(mode)):
        tie = F.lit(-rank).cast("long")
        if mode == "remote":
            tie = F.coalesce(-F.col(f"first_{rank}"), F.lit(-(2**62)))
        ballots.append(F.struct(F.col(f"votes_{rank}").alias("n"), tie.alias("tie"), F.lit(language).alias("lang")))
    best = F.greatest(*ballots)
    language = F.when(best["n"] > 0, best["lang"]).otherwise(UNKNOWN_LANGUAGE)
    return F.when((language == "JavaScript") & F.col("has_tsconfig"), "TypeScript").otherwise(language)


def detect_language(files: DataFrame, mode: str = "local") -> DataFrame:
    """(repo_id, language): one shuffle of one small row per repository and map task."""
    votes = files.groupBy("repo_id").agg(*language_aggregates(mode))
    return votes.select("repo_id", language_of_votes(mode).alias("language"))


def _first_match(cases) -> Column:
    (condition, value), *rest = cases
    return reduce(lambda acc, case: acc.when(case[0], case[1]), rest, F.when(condition, value))


def _manifest_matches(files: DataFrame) -> DataFrame:
    """(repo_id, node, python, golang): what each root manifest names."""
    wanted = ("package.json", "requirements.txt", "go.mod")
    # the filter reaches the scan, so `content` is read for these rows' row groups only
    manifests = files.where(F.col("path").isin(*wanted)).select("repo_id", "path", "content")
    is_node = F.col("path") == "package.json"
    parsed = js.with_json(manifests.withColumn("__pkg", F.when(is_node, F.col("content"))), "__pkg", "__json")

    def dependency(name: str) -> Column:
        # the development dependency replaces the plain one even when it is null or empty
        pinned = js.field(js.field(F.col("__json"), "devDependencies"), name)
        return F.coalesce(pinned, js.field(js.field(F.col("__json"), "dependencies"), name))

    node = _first_match([(js.truthy(dependency(dep)), label) for dep, label in rules.NODE_FRAMEWORKS])
    text = F.col("content")
    python = _first_match([(text.contains(word), label) for word, label in rules.PYTHON_FRAMEWORKS])
    golang = _first_match([(text.contains(word), label) for word, label in rules.GO_FRAMEWORKS])
    return parsed.select(
        "repo_id",
        F.when(is_node, node).alias("node"),
        F.when(F.col("path") == "requirements.txt", python).alias("python"),
        F.when(F.col("path") == "go.mod", golang).alias("golang"),
    )


def _manifest_framework(files: DataFrame) -> DataFrame:
    found = _manifest_matches(files)
    per_repo = found.groupBy("repo_id").agg(*[F.max(name).alias(name) for name in MANIFEST_COLUMNS])
    return per_repo.select("repo_id", F.coalesce(*MANIFEST_COLUMNS).alias("framework"))


def _framework_rank() -> Column:
    """Place of a path among the files that give a framework away, or NULL."""
    return _first_match([(F.col("path") == name, F.lit(rank)) for rank, (name, _) in enumerate(rules.FRAMEWORK_FILES)])


def _framework_at(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for _, label in rules.FRAMEWORK_FILES]), rank)


def _path_framework(files: DataFrame) -> DataFrame:
    names = [name for name, _ in rules.FRAMEWORK_FILES]
    best = files.where(F.col("path").isin(*names)).groupBy("repo_id").agg(F.min(_framework_rank()).alias("rank"))
    return best.select("repo_id", _framework_at(F.col("rank")).alias("framework"))


def detect_framework(files: DataFrame, mode: str = "local") -> DataFrame:
    """(repo_id, framework) for every repository; NULL when nothing matches.

    `local` reads root manifests (needs `content`), `remote` only looks at paths.
    """
    found = _manifest_framework(files) if mode == "local" else _path_framework(files)
    return files.select("repo_id").distinct().join(found, "repo_id", "left")


def directory_counts(files: DataFrame, sep: str = "/") -> DataFrame:
    """(repo_id, dir, n, first_ord) over files that are neither tests nor configuration."""
    segment = paths.first_segment(F.col("path"), sep)
    eligible = files.where(~F.col("is_test") & ~F.col("is_config")).select("repo_id", "ord", segment.alias("dir"))
    return (
        eligible.where(F.col("dir").isNotNull())
        .groupBy("repo_id", "dir")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"))
    )


def _source_order() -> list[Column]:
    """Ascending order of directories as source directories, over `dir`, `n` and `first_ord`."""
    index_like = F.col("dir").rlike(r"^(0|[1-9][0-9]{0,9})\z") & (
        F.coalesce(F.expr("try_cast(dir AS bigint)"), F.lit(2**33)) < 2**32 - 1
    )
    common = F.col("dir").isin(*rules.SOURCE_DIRS)
    return [
        F.when(common, 0).otherwise(1),
        F.when(common, F.lit(0)).otherwise(-F.col("n")),
        F.when(common | ~index_like, 1).otherwise(0),
        F.when(~common & index_like, F.expr("try_cast(dir AS bigint)")).otherwise(F.col("first_ord")),
        F.col("first_ord"),
    ]


def source_dirs(files: DataFrame, mode: str = "local", sep: str = "/") -> DataFrame:
    """(repo_id, pos, dir): conventional source directories in first-seen order.

    In `local` mode a repository without any falls back to its three largest
    top-level directories.  Directory names that are array indices come first
    among equals, as they do in the key order the fallback ranks by.
    """
    if mode == "remote":
        segment = paths.first_segment(F.col("path"), sep)
        hits = files.select("repo_id", "ord", segment.alias("dir")).where(F.col("dir").isin(*rules.REMOTE_SOURCE_DIRS))
        seen = hits.groupBy("repo_id", "dir").agg(F.min("ord").alias("first_ord"))
        ranked = top_k_per_group(
            seen, ["repo_id"], [F.col("first_ord")], len(rules.REMOTE_SOURCE_DIRS), ["dir"], salts=1
        )
        return ranked.select("repo_id", (F.col("rank") - 1).alias("pos"), "dir")

    counts = directory_counts(files, sep).withColumn("common", F.col("dir").isin(*rules.SOURCE_DIRS))
    best = top_k_per_group(counts, ["repo_id"], _source_order(), len(rules.SOURCE_DIRS), ["dir"])
    # at most six rows per repository by now, already partitioned by repo_id
    any_common = F.max("common").over(Window.partitionBy("repo_id"))
    kept = best.withColumn("any_common", any_common).where(
        (F.col("common") == F.col("any_common"))
        & (F.col("any_common") | (F.col("rank") <= rules.FALLBACK_SOURCE_DIRS))
    )
    return kept.select("repo_id", (F.col("rank") - 1).alias("pos"), "dir")


def domains(files: DataFrame, sep: str = "/") -> DataFrame:
    """(repo_id, name, path, file_count, first_ord): known top-level areas with more than five files.

    Order within a repository is `file_count` descending, then `first_ord`.
    """
    known = F.lower("dir").isin(*rules.DOMAIN_NAMES)
    counts = directory_counts(files, sep).where(known & (F.col("n") > rules.DOMAIN_MIN_FILES))
    return counts.select(
        "repo_id",
        F.col("dir").alias("name"),
        F.col("dir").alias("path"),
        F.col("n").alias("file_count"),
        "first_ord",
    )


# ------------------------------------------------------------------ mergeable state of repositories


def _merged(columns: list[str]) -> list[Column]:
    """The aggregate that merges each state column, told by its name."""

    def merge(name: str) -> Column:
        if name.startswith(("votes_", "n_")) or name == "n":
            return F.sum(name)
        if name.startswith("has_"):
            return F.bool_or(name)
        return F.max(name) if name in MANIFEST_COLUMNS else F.min(name)

    return [merge(name).alias(name) for name in columns if name not in ("repo_id", "dir")]


def repository_state(files: DataFrame, mode: str = "local", sep: str = "/") -> DataFrame:
    """One row per (repo_id, top-level directory) that holds all a profile needs; states of disjoint file tables merge.

    One pass over the metadata columns, aggregated before its shuffle, and in `local` mode one over the contents of root
    manifests, whose rows stand without a directory.  `dir` is NULL for files in the root.
    """
    eligible = F.col("dir").isNotNull() & ~F.col("is_test") & ~F.col("is_config")
    listed = files.withColumn("dir", paths.first_segment(F.col("path"), sep))
    aggregates = [
        *language_aggregates(mode),
        F.count(F.lit(1)).alias("n_files"),
        F.bool_or("is_test").alias("has_tests"),
        F.bool_or(F.col("path") == "package.json").alias("has_root_package"),
        F.count_if(eligible).alias("n"),
        F.min(F.when(eligible, F.col("ord"))).alias("first_ord"),
        F.min("ord").alias("seen_ord"),
    ]
    if mode == "remote":
        return listed.groupBy("repo_id", "dir").agg(*aggregates, F.min(_framework_rank()).alias("framework_rank"))
    state = listed.groupBy("repo_id", "dir").agg(*aggregates)
    return state.unionByName(_manifest_matches(files), allowMissingColumns=True)


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all files together, from states of parts that share no file."""
    rows = reduce(lambda a, b: a.unionByName(b), states)
    return rows.groupBy("repo_id", "dir").agg(*_merged(rows.columns))


def profile_of_state(state: DataFrame, mode: str = "local") -> DataFrame:
    """`repo_profile` from a state.  Several states go through `merge_states` first, as directories are ranked by their sums.

    A repository may have any number of directories: they are ranked within salts, and only the best of each
    salt, the few known names, and sums go into the repository's row.
    """
    conventional = rules.SOURCE_DIRS if mode == "local" else rules.REMOTE_SOURCE_DIRS
    common = F.col("dir").isin(*conventional)
    if mode == "local":
        candidate, order = F.col("n") > 0, _source_order()
    else:
        candidate, order = common, [F.col("seen_ord")]
    candidate = F.coalesce(candidate & F.col("dir").isNotNull(), F.lit(False))
    salted = state.withColumn("__salt", F.pmod(F.xxhash64("dir"), F.lit(SALTS))).withColumn("__candidate", candidate)
    inside = Window.partitionBy("repo_id", "__salt").orderBy(F.col("__candidate").desc(), *order)
    ranked = salted.withColumn("__rank", F.row_number().over(inside))
    best = F.col("__candidate") & (F.col("__rank") <= len(conventional))
    place = F.struct(*[part.alias(f"o{i}") for i, part in enumerate(order)], F.col("dir").alias("dir"), common.alias("common"))
    known = F.lower("dir").isin(*rules.DOMAIN_NAMES) & (F.col("n") > rules.DOMAIN_MIN_FILES)
    area = F.struct((-F.col("n")).alias("k"), "first_ord", F.col("dir").alias("name"), F.col("n").alias("file_count"))
    columns = [name for name in state.columns if name not in ("n", "first_ord", "seen_ord")]
    one = ranked.groupBy("repo_id").agg(
        *_merged(columns),
        F.array_sort(F.collect_list(F.when(best, place))).alias("places"),
        F.array_sort(F.collect_list(F.when(known, area))).alias("areas"),
    )
    if mode == "local":
        usual = F.filter("places", lambda p: p["common"])
        chosen = F.when(F.size(usual) > 0, usual).otherwise(F.slice("places", 1, rules.FALLBACK_SOURCE_DIRS))
        framework = F.coalesce(*MANIFEST_COLUMNS)
    else:
        chosen, framework = F.col("places"), _framework_at(F.col("framework_rank"))
    domain = F.transform("areas", lambda d: F.struct(d["name"].alias("name"), d["name"].alias("path"), d["file_count"].alias("file_count")))
    return one.select(
        "repo_id", "n_files", "has_tests", "has_root_package", language_of_votes(mode).alias("language"),
        framework.alias("framework"),
        F.transform(chosen, lambda p: p["dir"]).alias("source_dirs"),
        domain.alias("domains"),
    )


def repo_profile(files: DataFrame, mode: str = "local", sep: str = "/") -> DataFrame:
    """One row per repository with everything the default assets are derived from."""
    return profile_of_state(repository_state(files, mode, sep), mode)
