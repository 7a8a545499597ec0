"""Queries over data-quality findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoquarry.functions import front_matter as fm
from repoquarry.operators import quality
from repoquarry.sources import assets
from workload import views
from workload.sql_views import with_views


def _files(spark, sf_dir):
    files = views.asset_files(spark, sf_dir)
    return files, files.select("repo_id").distinct()


def front_matter(spark, sf_dir):
    files, _ = _files(spark, sf_dir)
    meta = fm.front_matter(F.col("content"))
    return files.select("repo_id", "path", F.coalesce(meta, F.lit("(none)")).alias("meta"))


def asset_paths(spark, sf_dir):
    files, _ = _files(spark, sf_dir)
    parts = [
        pick(files).select("repo_id", F.lit(kind).alias("kind"), "name", F.col("content").isNotNull().alias("has_document"))
        for kind, pick in (("skill", assets.skill_assets), ("agent", assets.agent_assets), ("hook", assets.hook_assets))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def skill_findings(spark, sf_dir):
    return quality.skill_findings(*_files(spark, sf_dir))


def agent_findings(spark, sf_dir):
    return quality.agent_findings(*_files(spark, sf_dir))


def hook_findings(spark, sf_dir):
    return quality.hook_findings(_files(spark, sf_dir)[0])


def registry_findings(spark, sf_dir):
    return quality.line_findings(views.catalogue_lines(spark, sf_dir))


def registry_findings_large(spark, sf_dir):
    """Five registries that hold all lines between them; line numbers still count within each."""
    return quality.line_findings(views.catalogue_lines(spark, sf_dir, by_type=True))


def validate_rollup(spark, sf_dir):
    files, repos = _files(spark, sf_dir)
    return quality.rollup(quality.validate_assets(files, repos), repos)


def registry_rollup(spark, sf_dir):
    lines = views.catalogue_lines(spark, sf_dir)
    return quality.rollup(quality.line_findings(lines), lines)


_COMMON = """SELECT repo_id, '{area}' AS area, sev AS severity, label || msg AS message FROM (
  SELECT *, {label} AS label, unnest(CASE variant WHEN 1 THEN [{{'sev': 'warning', 'msg': ': Missing ''description'' in frontmatter'}}]
    WHEN 2 THEN [{{'sev': 'error', 'msg': ': Missing ''name'' in frontmatter'}}{tools}]
    WHEN 3 THEN [{{'sev': 'error', 'msg': ': Missing YAML frontmatter'}}]
    WHEN 4 THEN [{{'sev': 'error', 'msg': ': Malformed YAML frontmatter'}}] ELSE [] END, recursive := true)
  FROM asset_files WHERE kind = {kind})"""
_SKILLS = (
    _COMMON.format(area="skills", label="'s' || doc_id || '/SKILL.md'", tools="", kind=0)
    + """ UNION ALL SELECT repo_id, 'skills', 'error', 't' || doc_id || ': Missing SKILL.md file' FROM asset_files WHERE kind = 3
UNION ALL SELECT DISTINCT repo_id, 'skills', 'warning', 'No .github/skills/ directory found' FROM asset_files
  WHERE repo_id NOT IN (SELECT repo_id FROM asset_files WHERE kind IN (0, 3))"""
)
_AGENTS = (
    _COMMON.format(area="agents", label="'a' || doc_id || '.agent.md'", kind=1, tools=", {'sev': 'error', 'msg': ': ''tools'' must be an array'}")
    + """ UNION ALL SELECT DISTINCT repo_id, 'agents', 'error', 'No .agent.md files found in .github/agents/' FROM asset_files
  WHERE kind = 1 AND repo_id NOT IN (SELECT repo_id FROM asset_files WHERE kind = 1 AND variant < 3)
UNION ALL SELECT DISTINCT repo_id, 'agents', 'error', 'No .github/agents/ directory found' FROM asset_files
  WHERE repo_id NOT IN (SELECT repo_id FROM asset_files WHERE kind = 1)"""
)
_HOOKS = """SELECT repo_id, 'hooks' AS area, 'error' AS severity, 'hooks/h' || doc_id || '.yaml: ' || msg AS message FROM (
  SELECT *, unnest(CASE hook_variant WHEN 1 THEN ['Invalid event ''on-save''. Must be one of: pre-commit, post-commit, pre-push, pre-analyze, post-generate',
    'Missing or empty ''commands'' array'] WHEN 2 THEN ['Missing ''name'' field'] ELSE [] END) AS msg FROM asset_files WHERE kind = 2)"""
_LINES = """SELECT repo_id, 'registry' AS area, 'error' AS severity, 'skills-registry.jsonl line ' || n || CASE WHEN NOT json_valid(line) THEN ': Invalid JSON'
  ELSE ': Missing ''name'' or ''type''' END AS message
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ord) AS n FROM {source} WHERE line <> '')
WHERE NOT json_valid(line) OR coalesce(json_extract_string(line, '$.name'), '') = '' OR coalesce(json_extract_string(line, '$.type'), '') = ''"""
_ROLLUP = """SELECT r.repo_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
  count(*) FILTER (severity = 'error') = 0 AS valid FROM (SELECT DISTINCT repo_id FROM {repos}) r LEFT JOIN f USING (repo_id) GROUP BY r.repo_id"""

SQL = {
    "front_matter": with_views("""SELECT repo_id, path, CASE WHEN kind = 2 OR variant >= 3 THEN '(none)'
  WHEN variant = 0 THEN 'name: n' || doc_id || chr(10) || 'description: d' || chr(10) || 'tools: [''a'', ''b'']'
  WHEN variant = 1 THEN 'name: n' || doc_id ELSE 'description: ''d''' || chr(10) || 'tools: codebase' END AS meta FROM asset_files""", "asset_files"),
    "asset_paths": with_views("""SELECT repo_id, (['skill','agent','hook','skill'])[kind + 1] AS kind,
  (['s' || doc_id, 'a' || doc_id || '.agent.md', 'h' || doc_id || '.yaml', 't' || doc_id])[kind + 1] AS name, kind <> 3 AS has_document FROM asset_files""", "asset_files"),
    "skill_findings": with_views(_SKILLS, "asset_files"),
    "agent_findings": with_views(_AGENTS, "asset_files"),
    "hook_findings": with_views(_HOOKS, "asset_files"),
    "registry_findings": with_views(_LINES.format(source="catalogue_lines"), "catalogue_lines"),
    "registry_findings_large": with_views(
        _LINES.format(source="(SELECT event_type AS repo_id, ord, line FROM catalogue_lines)"), "catalogue_lines"),
    "validate_rollup": with_views(
        f"WITH f AS ({_SKILLS} UNION ALL {_AGENTS} UNION ALL {_HOOKS} UNION ALL SELECT DISTINCT repo_id, 'registry', 'warning', 'No skills-registry.jsonl found' FROM asset_files) "
        + _ROLLUP.format(repos="asset_files"), "asset_files"),
    "registry_rollup": with_views("WITH f AS (" + _LINES.format(source="catalogue_lines") + ") " + _ROLLUP.format(repos="catalogue_lines"), "catalogue_lines"),
}

QUERIES = {
    f.__name__: f
    for f in (
        front_matter, asset_paths, skill_findings, agent_findings, hook_findings, registry_findings,
        registry_findings_large, validate_rollup, registry_rollup,
    )
}
