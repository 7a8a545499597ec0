"""Data-quality findings over asset files, and their roll-up per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.functions import front_matter as fm
from repoquarry.functions import json_values as js
from repoquarry.functions.text import strip_space
from repoquarry.operators.grouping import number_rows
from repoquarry.sources import assets
from repoquarry.sources.registry_files import registry_lines

ERROR, WARNING = "error", "warning"
FINDINGS_SCHEMA = "repo_id string, area string, severity string, message string"


def _finding(condition: Column, severity: str, *message) -> Column:
    text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), text.alias("message")))


def _explode(df: DataFrame, area: str, checks: list[Column]) -> DataFrame:
    found = F.filter(F.array(*checks), lambda f: f.isNotNull())
    rows = df.select("repo_id", F.explode(found).alias("f"))
    return rows.select("repo_id", F.lit(area).alias("area"), F.col("f.severity").alias("severity"), F.col("f.message").alias("message"))


def _repo_finding(repos: DataFrame, area: str, severity: str, message: Column) -> DataFrame:
    return repos.select("repo_id", F.lit(area).alias("area"), F.lit(severity).alias("severity"), message.alias("message"))


def _document_checks(label: Column, content: Column) -> tuple[Column, list[Column]]:
    """(front matter read, checks) shared by skill and agent documents."""
    opened = content.startswith(fm.FENCE)
    closed = fm.fence_end(content) > 0
    meta = fm.front_matter(content)
    readable = opened & closed & (meta != "")
    return readable, [
        _finding(~opened, ERROR, label, ": Missing YAML frontmatter"),
        _finding(opened & ~closed, ERROR, label, ": Malformed YAML frontmatter"),
        _finding(opened & closed & (meta == ""), ERROR, label, ": Empty YAML frontmatter"),
        _finding(readable & ~fm.is_set(meta, "name"), ERROR, label, ": Missing 'name' in frontmatter"),
        _finding(readable & ~fm.is_set(meta, "description"), WARNING, label, ": Missing 'description' in frontmatter"),
    ]


def _repos_with(files: DataFrame, prefix: str) -> DataFrame:
    return files.where(F.col("path").startswith(prefix)).select("repo_id").distinct()


def _absent(repos: DataFrame, present: DataFrame, area: str, severity: str, message: str) -> DataFrame:
    return _repo_finding(repos.join(present, "repo_id", "left_anti"), area, severity, F.lit(message))


def skill_findings(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Skill documents: readable front matter and a name are required, a description is advised."""
    docs = assets.skill_assets(files)
    label = F.concat("name", F.lit("/SKILL.md"))
    _, checks = _document_checks(label, F.col("content"))
    missing = _finding(F.col("content").isNull(), ERROR, F.col("name"), ": Missing SKILL.md file")
    directory = _repos_with(files, ".github/skills/")
    return (
        _explode(docs, "skills", [missing, *checks])
        .unionByName(
            _absent(directory, docs.select("repo_id").distinct(), "skills", WARNING, "No skills found in .github/skills/")
        )
        .unionByName(_absent(repos, directory, "skills", WARNING, "No .github/skills/ directory found"))
    )


def agent_findings(files: DataFrame, repos: DataFrame) -> DataFrame:
    """Agent documents: as skills, `tools` has to be an array, and at least one readable one must exist."""
    docs = assets.agent_assets(files)
    content = F.col("content")
    readable, checks = _document_checks(F.col("name"), content)
    tools = fm.value_kind(fm.front_matter(content), "tools")
    wrong_tools = _finding(readable & tools.isin("SCALAR", "MAP"), ERROR, F.col("name"), ": 'tools' must be an array")
    directory = _repos_with(files, ".github/agents/")
    counted = docs.where(readable).select("repo_id").distinct()
    return (
        _explode(docs, "agents", [*checks, wrong_tools])
        .unionByName(_absent(directory, counted, "agents", ERROR, "No .agent.md files found in .github/agents/"))
        .unionByName(_absent(repos, directory, "agents", ERROR, "No .github/agents/ directory found"))
    )


def hook_findings(files: DataFrame) -> DataFrame:
    """Hook files: a name, a known event and a non-empty array of commands."""
    docs = assets.hook_assets(files)
    return _explode(docs, "hooks", _hook_checks(F.concat(F.lit("hooks/"), "name"), F.col("content")))


def _hook_checks(label: Column, text: Column) -> list[Column]:
    event = fm.scalar(text, "event")
    readable = strip_space(text) != ""
    return [
        _finding(~readable, ERROR, label, ": Invalid YAML - empty document"),
        _finding(readable & ~fm.is_set(text, "name"), ERROR, label, ": Missing 'name' field"),
        _finding(readable & ~fm.is_set(text, "event"), ERROR, label, ": Missing 'event' field"),
        _finding(
            readable & fm.is_set(text, "event") & ~F.coalesce(event.isin(*rules.HOOK_EVENTS), F.lit(False)),
            ERROR, label, ": Invalid event '", F.coalesce(event, F.lit("")), "'. Must be one of: ",
            ", ".join(rules.HOOK_EVENTS),
        ),
        _finding(
            readable & (fm.value_kind(text, "commands") != "ARRAY"), ERROR, label, ": Missing or empty 'commands' array"
        ),
    ]


def line_findings(lines: DataFrame) -> DataFrame:
    """Registry lines `(repo_id, ord, line)`: JSON with a name and a type, numbered among non-blank lines."""
    filled = lines.where(strip_space(F.col("line")) != "")
    parsed = js.with_json(filled, "line", "body")
    body = F.col("body")
    # reading a member of null fails where the line is otherwise valid JSON
    valid = body.isNotNull() & (js.kind(body) != "VOID")
    named = js.truthy(js.field(body, "name")) & js.truthy(js.field(body, "type"))
    # judged where they are read; only two flags per line are shuffled to be numbered
    judged = parsed.select("repo_id", "ord", valid.alias("valid"), named.alias("named"))
    numbered = number_rows(judged, ["repo_id"], "ord", "number", counted=filled.select("repo_id", "ord"))
    label = F.concat(F.lit("skills-registry.jsonl line "), F.col("number").cast("string"))
    return _explode(
        numbered,
        "registry",
        [
            _finding(~F.col("valid"), ERROR, label, ": Invalid JSON"),
            _finding(F.col("valid") & ~F.col("named"), ERROR, label, ": Missing 'name' or 'type'"),
        ],
    )


def registry_findings(files: DataFrame, repos: DataFrame) -> DataFrame:
    docs = assets.registry_assets(files)
    empty = docs.where(strip_space(F.col("content")) == "").select("repo_id")
    return (
        line_findings(registry_lines(docs))
        .unionByName(_repo_finding(empty, "registry", WARNING, F.lit("skills-registry.jsonl is empty")))
        .unionByName(
            _absent(repos, docs.select("repo_id").distinct(), "registry", WARNING, "No skills-registry.jsonl found")
        )
    )


def _file_findings(files: DataFrame) -> DataFrame:
    """Findings about one file each: every file is read once and judged by the rules of its kind."""
    path, content = F.col("path"), F.col("content")
    skill, agent, hook = (F.regexp_extract(path, p, 1) for p in (assets.SKILL_FILE, assets.AGENT_PATH, assets.HOOK_PATH))
    kind = F.when(skill != "", "skills").when(agent != "", "agents").when(hook != "", "hooks").when(path == assets.REGISTRY_PATH, "registry")
    label = F.when(skill != "", F.concat(skill, F.lit("/SKILL.md"))).when(agent != "", agent).otherwise(F.concat(F.lit("hooks/"), hook))
    known = files.select("repo_id", kind.alias("area"), label.alias("label"), "content").where(F.col("area").isNotNull())
    readable, checks = _document_checks(F.col("label"), content)
    tools = fm.value_kind(fm.front_matter(content), "tools")
    wrong_tools = _finding(readable & tools.isin("SCALAR", "MAP"), ERROR, F.col("label"), ": 'tools' must be an array")
    empty = _finding(strip_space(content) == "", WARNING, "skills-registry.jsonl is empty")
    by_area = {"skills": checks, "agents": [*checks, wrong_tools], "hooks": _hook_checks(F.col("label"), content), "registry": [empty]}
    found = F.array().cast("array<struct<severity:string,message:string>>")
    for area, rules_of_area in by_area.items():
        found = F.when(F.col("area") == area, F.filter(F.array(*rules_of_area), lambda f: f.isNotNull())).otherwise(found)
    rows = known.select("repo_id", "area", F.explode(found).alias("f"))
    return rows.select("repo_id", "area", F.col("f.severity").alias("severity"), F.col("f.message").alias("message"))


def _presence(files: DataFrame) -> DataFrame:
    """(repo_id, skill, and flags of what its files are): one row per skill directory, and one for all other files."""
    path, content = F.col("path"), F.col("content")
    readable, _ = _document_checks(path, content)
    return files.groupBy("repo_id", F.regexp_extract(path, assets.SKILL_PATH, 1).alias("skill")).agg(
        F.bool_or((F.regexp_extract(path, assets.SKILL_FILE, 1) != "") & content.isNotNull()).alias("documented"),
        F.bool_or(path.startswith(".github/skills/")).alias("skills_dir"),
        F.bool_or(path.startswith(".github/agents/")).alias("agents_dir"),
        F.coalesce(F.bool_or((F.regexp_extract(path, assets.AGENT_PATH, 1) != "") & readable), F.lit(False)).alias("agent_read"),
        F.bool_or(path == assets.REGISTRY_PATH).alias("registry"),
    )


def _absence_findings(files: DataFrame, repos: DataFrame | None) -> DataFrame:
    """Findings about what a repository lacks, from flags of one aggregation."""
    present = _presence(files)
    undocumented = present.where((F.col("skill") != "") & ~F.col("documented"))
    missing = _repo_finding(undocumented, "skills", ERROR, F.concat("skill", F.lit(": Missing SKILL.md file")))
    flags = ["skills_dir", "agents_dir", "agent_read", "registry"]
    whole = present.groupBy("repo_id").agg(F.bool_or(F.col("skill") != "").alias("skills"), *[F.bool_or(name).alias(name) for name in flags])
    if repos is None:
        whole = whole.withColumn("listed", F.lit(True))
    else:
        whole = whole.join(repos.select("repo_id", F.lit(True).alias("listed")).distinct(), "repo_id", "full")
        whole = whole.select("repo_id", *[F.coalesce(name, F.lit(False)).alias(name) for name in ("skills", *flags, "listed")])
    has, listed = F.col, F.col("listed")
    checks = [
        ("skills", WARNING, has("skills_dir") & ~has("skills"), "No skills found in .github/skills/"),
        ("skills", WARNING, listed & ~has("skills_dir"), "No .github/skills/ directory found"),
        ("agents", ERROR, has("agents_dir") & ~has("agent_read"), "No .agent.md files found in .github/agents/"),
        ("agents", ERROR, listed & ~has("agents_dir"), "No .github/agents/ directory found"),
        ("registry", WARNING, listed & ~has("registry"), "No skills-registry.jsonl found"),
    ]
    made = [F.when(test, F.struct(F.lit(a).alias("area"), F.lit(s).alias("severity"), F.lit(m).alias("message"))) for a, s, test, m in checks]
    found = F.filter(F.array(*made), lambda f: f.isNotNull())
    return missing.unionByName(whole.select("repo_id", F.inline(found)))


def validate_assets(files: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """All findings `(repo_id, area, severity, message)` over `(repo_id, path, content)` files.

    The rows are those of `skill_findings`, `agent_findings`, `hook_findings` and `registry_findings` together, from one pass
    over the files for findings about a file, one aggregation for what is absent, and the registry's lines.  `repos` are
    the repositories that must not lack anything, by default those with a file.
    """
    lines = line_findings(registry_lines(assets.registry_assets(files)))
    return _file_findings(files).unionByName(_absence_findings(files, repos)).unionByName(lines)


def rollup(findings: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_id, errors, warnings, valid) for every repository."""
    counts = findings.groupBy("repo_id").agg(
        F.count_if(F.col("severity") == ERROR).alias("errors"),
        F.count_if(F.col("severity") == WARNING).alias("warnings"),
    )
    zero = F.lit(0).cast("long")
    joined = repos.select("repo_id").distinct().join(counts, "repo_id", "left")
    errors = F.coalesce("errors", zero)
    return joined.select(
        "repo_id", errors.alias("errors"), F.coalesce("warnings", zero).alias("warnings"), (errors == 0).alias("valid")
    )
