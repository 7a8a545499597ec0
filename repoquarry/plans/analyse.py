"""End-to-end analysis flows: responses with heuristic fallback, gate, catalogue, documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.operators import catalogue, defaults, documents, responses
from repoquarry.operators.grouping import even_join, spread_join
from repoquarry.operators.licensing import license_gate, metadata_gate
from repoquarry.plans.storage import StageStore


@dataclass
class Analysis:
    """Tables of one analysis; all share `repo_id`."""

    repos: DataFrame  # repo_id, repo_name, summary, language, framework
    skills: DataFrame
    agents: DataFrame
    hooks: DataFrame

    @property
    def tools(self) -> DataFrame:
        return responses.extract_tools(self.agents)

    @property
    def registry(self) -> DataFrame:
        return catalogue.build_registry(self.skills, self.agents)

    def assets(self, **options) -> DataFrame:
        return documents.render_assets(self.repos, self.skills, self.agents, self.hooks, **options)

    def summary(self, single_agent: bool = False) -> DataFrame:
        return documents.run_summary(self.repos, self.skills, self.agents, self.hooks, single_agent)

    def only(self, allowed: DataFrame) -> Analysis:
        """The same tables for the given repositories."""
        keep = allowed.select("repo_id").distinct()

        def kept(table: DataFrame) -> DataFrame:
            return spread_join(table, keep, ["repo_id"], "ord", "left_semi", even=True)

        repos = even_join(self.repos, keep, ["repo_id"], "left_semi")
        return Analysis(repos, kept(self.skills), kept(self.agents), kept(self.hooks))


def _hook_rows(rows: DataFrame, hooks: Column) -> DataFrame:
    exploded = rows.select("repo_id", F.posexplode(hooks).alias("ord", "hook"))
    return exploded.select("repo_id", F.col("ord").cast("long").alias("ord"), "hook.*")


def _dir_rows(profile: DataFrame) -> DataFrame:
    return profile.select("repo_id", F.posexplode("source_dirs").alias("pos", "dir"))


def route(profile: DataFrame, sessions: DataFrame, mode: str = "local") -> DataFrame:
    """Profile rows with their parsed response and `route`: model, heuristic or empty.

    `sessions` is `(repo_id, status, text)`.  Local runs fall back to the
    heuristic on any failure.  Remote runs keep what was streamed, answer an
    unusable response with an empty result, and use the heuristic only when
    there was no session at all.
    """
    parsed = responses.parse_responses(sessions.withColumnRenamed("text", "response"))
    # the texts themselves need not be shuffled for callers that drop them
    answered = parsed.withColumn("__answered", F.col("response").isNotNull())
    joined = even_join(profile, answered, ["repo_id"], "left")
    usable = F.coalesce("valid", F.lit(False))
    if mode == "local":
        chosen = F.when(usable & (F.col("status") == "ok"), "model").otherwise("heuristic")
    else:
        chosen = F.when(usable, "model").when(F.col("__answered"), "empty").otherwise("heuristic")
    return joined.withColumn("route", chosen).drop("__answered")


def _routed(profile: DataFrame, sessions: DataFrame, mode: str, store: StageStore | None) -> DataFrame:
    # every table of the analysis derives from these rows: parse and validate each response once
    rows = route(profile, sessions, mode).drop("response", "violations")
    return (rows if store is None else store.keep(rows, f"routed-{mode}")).withColumn("valid", F.col("route") == "model")


def analyse_local(profile: DataFrame, sessions: DataFrame, sep: str = "/", store: StageStore | None = None) -> Analysis:
    """Analyse checked-out repositories from their profile and session results.

    With a `store` the parsed responses are written to it once, which runs a job
    here unless it holds them already, and the tables can be read until the store
    is discarded; without one every table parses the responses again when it is read.
    """
    routed = _routed(profile, sessions, "local", store)
    heuristic = routed.where("NOT valid")
    by_default = defaults.default_hooks(F.col("language"), F.col("has_tests"))
    given = responses.hooks_of(F.col("body"))
    hooks = F.when(F.col("valid") & (F.size(given) > 0), given).otherwise(by_default)
    summary = F.when(F.col("valid"), responses.response_summary(F.col("body"))).otherwise(
        defaults.summary_sentence("local")
    )
    repos = routed.select(
        "repo_id", F.substring_index("repo_id", "/", -1).alias("repo_name"), summary.alias("summary"),
        F.lit(None).cast("string").alias("language"), F.lit(None).cast("string").alias("framework"),
    )
    return Analysis(
        repos,
        responses.response_skills(routed).unionByName(defaults.default_skills(_dir_rows(heuristic))),
        responses.response_agents(routed).unionByName(defaults.local_agents(heuristic, sep)),
        _hook_rows(routed, hooks),
    )


def analyse_remote(profile: DataFrame, sessions: DataFrame, metadata: DataFrame, store: StageStore | None = None) -> Analysis:
    """Analyse exported repositories; `metadata` adds owner and name.  `store` as in `analyse_local`."""
    named = even_join(profile, metadata.select("repo_id", "owner", "repo"), ["repo_id"])
    routed = _routed(named, sessions, "remote", store)
    heuristic = routed.where(F.col("route") == "heuristic")
    summary = (
        F.when(F.col("valid"), responses.response_summary(F.col("body")))
        .when(F.col("route") == "heuristic", defaults.summary_sentence("remote"))
        .otherwise("")
    )
    repos = routed.select("repo_id", F.col("repo").alias("repo_name"), summary.alias("summary"), "language", "framework")
    # exported listings never count tests, so there is no pre-push hook
    hooks = defaults.default_hooks(F.col("language"), F.lit(False))
    return Analysis(
        repos,
        responses.response_skills(routed).unionByName(defaults.default_skills(_dir_rows(heuristic))),
        responses.response_agents(routed).unionByName(defaults.remote_agents(heuristic)),
        _hook_rows(routed, hooks),
    )


def gated(analysis: Analysis, licences: DataFrame, dry_run: bool = False) -> tuple[Analysis, DataFrame]:
    """Keep repositories with a permissive licence; also return the blocked ones.

    `licences` has either the `license` struct of a resolved text or, for
    exported repositories, the `license` SPDX id.
    """
    structured = dict(licences.dtypes)["license"].startswith("struct")
    allowed, blocked = (license_gate if structured else metadata_gate)(licences, dry_run)
    return analysis.only(allowed), blocked
