"""Catalogue of skills and agents: build, list, get, scored search, batch search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.operators.grouping import spread_join, top_k_per_group

REGISTRY_SCHEMA = (
    "repo_id string, ord bigint, type string, name string, file string, vs_code_agent string, "
    "description string, category string, triggers array<string>, parent_agent string, "
    "sub_agents array<string>, is_sub_agent boolean"
)
# agents are listed after every skill of their repository: positions are not negative, those of skills are moved below zero
SKILL_OFFSET = -(1 << 63)
GRAM = 3


def build_registry(skills: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Skills then agents as one relation, with the path each entry is filed under.

    `ord` is that of the input for agents; skills keep their order below zero, whatever their positions.
    """
    entries = skills.select(
        "repo_id",
        (F.col("ord") + F.lit(SKILL_OFFSET)).alias("ord"),
        F.lit("skill").alias("type"),
        "name",
        F.concat(F.lit(".github/skills/"), "name", F.lit("/SKILL.md")).alias("file"),
        F.lit(None).cast("string").alias("vs_code_agent"),
        "description",
        "category",
        "triggers",
        F.lit(None).cast("string").alias("parent_agent"),
        F.lit(None).cast("array<string>").alias("sub_agents"),
        F.lit(None).cast("boolean").alias("is_sub_agent"),
    )
    if agents is None:
        return entries
    file = F.concat(F.lit(".github/agents/"), "name", F.lit(".agent.md"))
    return entries.unionByName(
        agents.select(
            "repo_id",
            "ord",
            F.lit("agent").alias("type"),
            "name",
            file.alias("file"),
            file.alias("vs_code_agent"),
            "description",
            F.lit(None).cast("string").alias("category"),
            "triggers",
            "parent_agent",
            "sub_agents",
            "is_sub_agent",
        )
    )


def _contains(text: Column, query: Column) -> Column:
    return F.coalesce(F.lower(text).contains(query), F.lit(False))


def relevance(query: Column) -> Column:
    """Score of a registry row for a lower-cased query."""
    name = F.lower("name")
    trigger_points = F.aggregate(
        F.coalesce("triggers", F.array().cast("array<string>")),
        F.lit(0),
        lambda total, trigger: total
        + F.when(F.lower(trigger).contains(query), rules.SCORE_TRIGGER_CONTAINS).otherwise(0)
        + F.when(F.lower(trigger) == query, rules.SCORE_TRIGGER_EQUALS).otherwise(0),
    )

    def points(condition, value):
        return F.when(condition, value).otherwise(0)

    return (
        points(name == query, rules.SCORE_NAME_EQUALS)
        + points(_contains(F.col("name"), query), rules.SCORE_NAME_CONTAINS)
        + points(_contains(F.col("description"), query), rules.SCORE_DESCRIPTION)
        + trigger_points
        + points(_contains(F.col("category"), query), rules.SCORE_CATEGORY)
        + points(is_root_agent(), rules.SCORE_ROOT_AGENT)
    )


def is_root_agent() -> Column:
    return (F.col("type") == "agent") & ~F.coalesce("is_sub_agent", F.lit(False))


def _check_limit(limit: int) -> None:
    if limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")


def search(
    registry: DataFrame, query: str, type: str | None = None, limit: int = 10, require_match: bool = False
) -> DataFrame:
    """Best entries for a query, with their score; ties keep catalogue order.

    Root agents always score a little, so they are returned for any query;
    `require_match` leaves those without a textual hit out.
    """
    _check_limit(limit)
    entries = registry if type is None else registry.where(F.col("type") == type)
    scored = entries.withColumn("score", relevance(F.lower(F.lit(query))).cast("long"))
    if require_match:
        bonus = F.when(is_root_agent(), rules.SCORE_ROOT_AGENT).otherwise(0)
        scored = scored.where(F.col("score") > bonus)
    hits = scored.where(F.col("score") > 0)
    return hits.orderBy(F.col("score").desc(), "repo_id", "ord").limit(limit)


def list_entries(registry: DataFrame) -> DataFrame:
    return registry.orderBy("repo_id", "ord")


def get_entry(registry: DataFrame, name: str) -> DataFrame:
    """First entry with exactly this name, or no row."""
    return registry.where(F.col("name") == name).orderBy("repo_id", "ord").limit(1)


def _grams(text: Column, sizes: Column) -> Column:
    """All character n-grams of a text for the given sizes."""
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))

    def of_size(chars, n):
        last = F.size(chars) - n + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))

    # the outer array binds the characters to a variable, so they are split once
    nested = F.transform(F.array(characters), lambda chars: F.flatten(F.transform(sizes, lambda n: of_size(chars, n))))
    return F.flatten(nested)


def searched_texts() -> Column:
    """All texts of a registry row that a query is looked for in, in lower case; none is NULL."""
    triggers = F.coalesce(F.transform("triggers", lambda t: F.lower(t)), F.array().cast("array<string>"))
    return F.array_compact(F.concat(F.array(F.lower("name"), F.lower("description"), F.lower("category")), triggers))


def search_batch(
    registry: DataFrame, queries: DataFrame, k: int = 10, type: str | None = None, salts: int = 16
) -> DataFrame:
    """`search` for a whole table of queries `(query_id, query)`: (query_id, rank, score, repo_id, ord).

    A substring can only occur where its own n-grams occur.  The grams of the
    catalogue are counted, every query is filed under the rarest of its own
    (three characters, or the whole query when it is shorter), every entry
    under all grams of its texts, and the two meet in an equi join; only pairs
    that share such a gram are scored.  The query side is repeated over
    `salts`, so a common gram spreads over many tasks.  What needs no textual
    hit is added from a bounded list: root agents, which always score, and
    everything for the empty query.  Equal queries are answered once.
    """
    _check_limit(k)
    entries = registry if type is None else registry.where(F.col("type") == type)
    asked = queries.select(F.lower("query").alias("q")).distinct()
    filled_in = asked.where("q <> ''")
    # at most GRAM numbers: the gram sizes that queries are filed under
    lengths = filled_in.agg(F.collect_set(F.least(F.char_length("q"), F.lit(GRAM)))).scalar()
    sized = entries.withColumn("sizes", F.coalesce(lengths, F.array().cast("array<int>")))
    entry_grams = F.array_distinct(F.flatten(F.transform(F.array_distinct(searched_texts()), lambda t: _grams(t, F.col("sizes")))))
    filed = sized.withColumn("salt", F.pmod(F.xxhash64("repo_id", "ord"), F.lit(salts))).withColumn(
        "gram", F.explode(entry_grams)
    )
    counts = filed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    own = _grams(F.col("q"), F.array(F.least(F.char_length("q"), F.lit(GRAM))))
    # a query with a gram that no entry has is in no entry; the others meet every one of theirs
    met = filled_in.withColumn("gram", F.explode(F.array_distinct(own))).join(counts, "gram", "left")
    rarest = met.groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    keyed = (
        rarest.where("least.n > 0").select("q", F.col("least.gram").alias("gram"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    )
    scored = filed.join(keyed, ["gram", "salt"]).withColumn("score", relevance(F.col("q")).cast("long"))
    bonus = F.when(is_root_agent(), rules.SCORE_ROOT_AGENT).otherwise(0)
    matched = scored.where(F.col("score") > bonus).select("q", "score", "repo_id", "ord")
    order = [F.col("score").desc(), F.col("repo_id"), F.col("ord")]
    best = top_k_per_group(matched, ["q"], order, k, ["repo_id", "ord"]).drop("rank")
    return answer(best, entries, asked, queries, k)


def answer(best: DataFrame, entries: DataFrame, asked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Ranked rows for every query from its textual hits `best (q, score, repo_id, ord)` and what needs none.

    `asked` holds the distinct lower-cased texts `q` of `queries`.
    """
    order = [F.col("score").desc(), F.col("repo_id"), F.col("ord")]
    pair = F.struct("repo_id", "ord", "score")
    roots = (
        entries.where(is_root_agent())
        .select("repo_id", "ord", F.lit(rules.SCORE_ROOT_AGENT).cast("long").alias("score"))
        .orderBy("repo_id", "ord")
        .limit(k)
    )
    everything = search(entries, "", limit=k).select("repo_id", "ord", "score")
    # both lists hold at most k rows and reach the queries as one literal array each
    filled = asked.withColumn(
        "extra",
        F.when(F.col("q") == "", everything.agg(F.collect_list(pair)).scalar()).otherwise(
            roots.agg(F.collect_list(pair)).scalar()
        ),
    )
    extra = filled.select("q", F.explode("extra").alias("e")).select("q", "e.score", "e.repo_id", "e.ord")
    # at most 2k rows per query text; a matched root agent keeps its higher score
    merged = best.unionByName(extra).groupBy("q", "repo_id", "ord").agg(F.max("score").alias("score"))
    answers = top_k_per_group(merged, ["q"], order, k, ["repo_id", "ord"], salts=1)
    asking = queries.select("query_id", F.lower("query").alias("q"))
    return spread_join(asking, answers, ["q"], "query_id").select("query_id", "rank", "score", "repo_id", "ord")
