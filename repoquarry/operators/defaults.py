"""Default skills, tools, hooks and agents derived from a repository profile.

All of it is row-level work on the one-row-per-repository profile: literals and
array functions, no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.operators.grouping import spread_join

TOOL_TYPE = "struct<name:string,command:string,description:string>"
HOOK_TYPE = "struct<name:string,event:string,description:string,commands:array<string>,condition:string>"
AGENT_TYPE = (
    "struct<name:string,description:string,skills:array<string>,"
    f"tools:array<{TOOL_TYPE}>,is_sub_agent:boolean,parent_agent:string,"
    "sub_agents:array<string>,triggers:array<string>,source_dir:string>"
)
SKILL_COLUMNS = ("name", "description", "source_dir", "patterns", "triggers", "category", "examples")
VALIDATE_COMMAND = "validate-assets"


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _strings(values=()) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _tools(rows) -> Column:
    items = [
        F.struct(F.lit(name).alias("name"), F.lit(command).alias("command"), F.lit(text).alias("description"))
        for name, command, text in rows
    ]
    return F.array(*items).cast(f"array<{TOOL_TYPE}>")


def default_skills(dirs: DataFrame) -> DataFrame:
    """One skill per source directory row `(repo_id, pos, dir)`."""
    name = F.col("dir")
    return dirs.select(
        "repo_id",
        F.col("pos").cast("long").alias("ord"),
        F.concat(name, F.lit("-patterns")).alias("name"),
        F.concat(F.lit("Patterns and conventions from the "), name, F.lit(" directory")).alias("description"),
        name.alias("source_dir"),
        _strings().alias("patterns"),
        F.array(name).alias("triggers"),
        F.lit("patterns").alias("category"),
        _strings().alias("examples"),
    )


def default_tools(language: Column, has_root_package: Column | None = None) -> Column:
    """Array of tools for a language.

    With `has_root_package` (config-aware form) the Node tools need a root
    package.json; without it the shorter plain table applies.
    """
    table = rules.PLAIN_TOOLS if has_root_package is None else rules.CONFIG_TOOLS
    node = language.isin(*rules.NODE_LANGUAGES)
    if has_root_package is not None:
        node = node & has_root_package
    return (
        F.when(node, _tools(table["node"]))
        .when(language == "Python", _tools(table["Python"]))
        .when(language == "Go", _tools(table["Go"]))
        .otherwise(_tools(()))
    )


def default_hooks(language: Column, has_tests: Column, validate_command: str = VALIDATE_COMMAND) -> Column:
    """Array of hooks: pre-commit by language, pre-push when there are tests, post-generate always."""

    def hook(name, event, description, commands):
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(event).alias("event"),
            F.lit(description).alias("description"),
            _strings(commands).alias("commands"),
            _text(None).alias("condition"),
        )

    none = F.array().cast(f"array<{HOOK_TYPE}>")
    by_language, push_command = none, {}
    for group, (text, commands, push) in rules.HOOK_COMMANDS.items():
        matches = language.isin(*rules.NODE_LANGUAGES) if group == "node" else language == group
        commit = F.array(hook("pre-commit-quality", "pre-commit", text, commands))
        tests = F.array(hook("pre-push-tests", "pre-push", "Run tests before pushing", (push,)))
        both = F.when(has_tests, F.concat(commit, tests)).otherwise(commit)
        by_language = F.when(matches, both).otherwise(by_language)
    always = F.array(
        hook("post-generate-validate", "post-generate",
             "Validate generated agent assets after generation", (validate_command,))
    )
    return F.concat(by_language, always).cast(f"array<{HOOK_TYPE}>")


def _agent(name, description, skills, tools, sub, parent, sub_agents, triggers, source_dir) -> Column:
    return F.struct(
        name.alias("name"), description.alias("description"), skills.alias("skills"), tools.alias("tools"),
        F.lit(sub).alias("is_sub_agent"), parent.alias("parent_agent"), sub_agents.alias("sub_agents"),
        triggers.alias("triggers"), source_dir.alias("source_dir"),
    ).cast(AGENT_TYPE)


def _skill_names(dirs: Column) -> Column:
    return F.transform(dirs, lambda d: F.concat(d, F.lit("-patterns")))


def _agent_rows(df: DataFrame, agents: Column) -> DataFrame:
    exploded = df.select("repo_id", F.posexplode(agents).alias("ord", "agent"))
    return exploded.select("repo_id", F.col("ord").cast("long").alias("ord"), "agent.*")


def local_agents(profile: DataFrame, sep: str = "/") -> DataFrame:
    """Heuristic hierarchy: a root agent plus one sub-agent per domain.

    A domain owns the skills of its directory and of directories below it.  The
    root keeps the skills whose directory starts with no domain path at all;
    that test ignores the separator, so `clients` next to a domain `client`
    belongs to neither.
    """
    dirs, found, language = F.col("source_dirs"), F.col("domains"), F.col("language")
    no_tools = F.array().cast(f"array<{TOOL_TYPE}>")

    def domain_agent(domain):
        inside = F.filter(dirs, lambda d: F.substring_index(d, sep, 1) == domain["path"])
        text = F.concat(F.lit("Agent for the "), domain["name"], F.lit(" domain ("),
                        domain["file_count"].cast("string"), F.lit(" files)"))
        return _agent(domain["name"], text, _skill_names(inside), no_tools, True, F.lit("root"),
                      F.lit(None), F.array(F.lower(domain["name"])), domain["path"])

    outside = F.filter(dirs, lambda d: ~F.exists(found, lambda dom: d.startswith(dom["path"])))
    root = _agent(
        F.lit("root"),
        F.concat(F.lit("Root agent for this "), language, F.lit(" repository")),
        _skill_names(outside),
        default_tools(language, F.col("has_root_package")),
        False, F.lit(None), F.transform(found, lambda d: d["name"]),
        F.array(F.lower(language), F.lit("main"), F.lit("primary")), F.lit(None),
    )
    return _agent_rows(profile, F.concat(F.array(root), F.transform(found, domain_agent)))


def remote_agents(profile: DataFrame) -> DataFrame:
    """A single root agent that owns every default skill; needs columns `owner` and `repo`."""
    language = F.col("language")
    root = _agent(
        F.lit("root"),
        F.concat(F.lit("Root agent for "), F.col("owner"), F.lit("/"), F.col("repo")),
        _skill_names(F.col("source_dirs")),
        default_tools(language),
        False, F.lit(None), _strings(), F.array(F.lower(language)), F.lit(None),
    )
    return _agent_rows(profile, F.array(root))


def summary_sentence(mode: str = "local") -> Column:
    """One sentence about a profile row."""
    framework = F.coalesce(F.nullif(F.col("framework"), F.lit("")), F.lit(""))
    using = F.when(framework != "", F.concat(F.lit(" using "), framework)).otherwise("")
    head = F.concat(F.lit("A "), F.col("language"), F.lit(" repository"), using)
    if mode == "remote":
        return F.concat(head, F.lit("."))
    return F.concat(head, F.lit(" with "), F.size("domains").cast("string"), F.lit(" detected domains."))


def assign_by_prefix(
    items: DataFrame,
    prefixes: DataFrame,
    keys: list[str],
    value: str,
    prefix: str,
    spread: str,
    sep: str | None = None,
) -> DataFrame:
    """Left join each item to every `prefix` its `value` starts with, inside equal `keys`.

    A prefix join planned as an equi join: an item is expanded into its own
    prefixes (at most as many as it has characters) and meets the distinct
    prefixes on the full text, so nothing is compared pairwise within a key.
    With `sep` only the value itself and `prefix + sep` count.  `spread` is a
    column that differs between items, so many equal values share the work.
    """
    length = F.char_length(value)
    ends = F.sequence(F.lit(1), length)
    if sep is not None:
        ends = F.filter(
            ends,
            lambda n: (n == length) | (F.substring(F.col(value), n + 1, F.lit(len(sep))) == sep),
        )
    own = F.transform(ends, lambda n: F.substring(F.col(value), F.lit(1), n))
    expanded = items.withColumn(prefix, F.explode_outer(F.when(length > 0, own)))
    known = prefixes.select(*keys, prefix).distinct()
    matched = spread_join(expanded, known, [*keys, prefix], spread)
    values = matched.select(*keys, value).distinct()
    unmatched = spread_join(items, values, [*keys, value], spread, "left_anti")
    return matched.unionByName(unmatched.withColumn(prefix, F.lit(None).cast("string")))
