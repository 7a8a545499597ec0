"""Prompt inputs for batch inference: one system and one user text per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry.functions.paths import truncate_content
from repoquarry.operators import sampling
from repoquarry.operators.grouping import ordered_concat

RESPONSE_FORMAT = """Answer with one JSON object:
{"skills": [{"name", "description", "sourceDir", "patterns": [], "triggers": [], "category", "examples": []}],
 "agents": [{"name", "description", "skills": [], "tools": [], "isSubAgent", "parentAgent", "subAgents": [], "triggers": [], "sourceDir"}],
 "summary": ""}"""


def system_prompt(language: Column, domain_names: Column | None = None) -> Column:
    """Task description; names the detected domains when there are any."""
    base = F.concat(
        F.lit("Describe this "), language,
        F.lit(" repository as skills, agents with sub-agents, and tools. Reply in JSON only."),
    )
    if domain_names is None:
        return base
    hint = F.concat(F.lit("\nLikely areas: "), F.array_join(domain_names, ", "))
    return F.when(F.size(domain_names) > 0, F.concat(base, hint)).otherwise(base)


def sample_text(samples: DataFrame, mode: str = "local") -> DataFrame:
    """(repo_id, samples): the sampled files with a heading each, in rank order (at most 20)."""
    content = truncate_content(F.col("content"), mode)
    block = F.concat(F.lit("\n--- "), "path", F.lit(" ---\n"), content, F.lit("\n")).alias("block")
    if mode == "remote":
        samples = samples.where(F.col("content") != "")
    pairs = F.array_sort(F.collect_list(F.struct("rank", "block")))
    text = F.array_join(F.transform(pairs, lambda p: p["block"]), "")
    return samples.select("repo_id", "rank", block).groupBy("repo_id").agg(text.alias("samples"))


def config_paths(files: DataFrame) -> DataFrame:
    """(repo_id, config_files): every configuration path, comma separated, in file order."""
    configs = files.where("is_config").select("repo_id", "ord", F.col("path").alias("config_files"))
    return ordered_concat(configs, ["repo_id"], "ord", "config_files", ", ")


def local_prompts(files: DataFrame, contents: DataFrame, profile: DataFrame) -> DataFrame:
    """(repo_id, system, prompt) from `repo_profile(files)`, the file table and its contents."""
    samples = sample_text(sampling.attach_content(sampling.sample_files(files), contents))
    rows = (
        profile.join(sampling.first_paths(files), "repo_id", "left")
        .join(config_paths(files), "repo_id", "left")
        .join(samples, "repo_id", "left")
    )
    none = F.lit("")
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("Language: "), "language"),
        F.concat(F.lit("Framework: "), F.coalesce(F.nullif("framework", none), F.lit("None"))),
        F.concat(F.lit("Source directories: "), F.array_join("source_dirs", ", ")),
        F.concat(F.lit("Config files: "), F.coalesce("config_files", none)),
        F.lit("\nFiles (first 100):"),
        F.coalesce("paths", none),
        F.lit("\nSamples:"),
        F.coalesce("samples", none),
        F.lit(RESPONSE_FORMAT),
    )
    names = F.transform("domains", lambda d: d["name"])
    return rows.select("repo_id", system_prompt(F.col("language"), names).alias("system"), prompt.alias("prompt"))


def remote_prompts(files: DataFrame, contents: DataFrame, profile: DataFrame) -> DataFrame:
    """(repo_id, system, prompt) for exported repositories: priority files instead of samples."""
    samples = sample_text(sampling.attach_content(sampling.priority_files(files), contents), "remote")
    rows = profile.join(sampling.first_paths(files), "repo_id", "left").join(samples, "repo_id", "left")
    none = F.lit("")
    framework = F.nullif("framework", none)
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("Language: "), "language"),
        F.when(framework.isNotNull(), F.concat(F.lit("Framework: "), framework)),
        F.lit("\nFiles (first 100):"),
        F.coalesce("paths", none),
        F.lit("\nFile contents:"),
        F.coalesce("samples", none),
        F.lit("Nest sub-agents as objects.\n" + RESPONSE_FORMAT),
    )
    return rows.select("repo_id", system_prompt(F.col("language")).alias("system"), prompt.alias("prompt"))
