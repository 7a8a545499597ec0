"""Queries over model responses and the analysis they lead to."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoquarry.operators import defaults, hierarchy, licensing, responses
from repoquarry.operators.catalogue import SKILL_OFFSET
from repoquarry.plans import analyse
from repoquarry.plans.storage import StageStore
from workload import views
from workload.sql_views import with_views


def _joined(name, sep=","):
    return F.coalesce(F.array_join(name, sep), F.lit("(none)")).alias(name)


def _agent_columns(agents):
    return agents.select(
        "repo_id", "ord", "name", "description", _joined("skills"),
        F.array_join(F.transform("tools", lambda t: F.concat_ws("/", t["name"], t["command"], t["description"])), ",").alias("tools"),
        "is_sub_agent", F.coalesce("parent_agent", F.lit("")).alias("parent_agent"), _joined("sub_agents"), _joined("triggers"),
    )


def json_extract(spark, sf_dir):
    parsed = responses.parse_responses(views.model_responses(spark, sf_dir))
    return parsed.select(
        "repo_id", responses.extract_json(F.col("response")).isNotNull().alias("has_braces"),
        F.col("body").isNotNull().alias("is_json"), F.col("valid").alias("valid"),
        F.coalesce(responses.response_summary(F.col("body")), F.lit("")).alias("summary"),
    )


def response_findings(spark, sf_dir):
    return responses.response_findings(responses.parse_responses(views.model_responses(spark, sf_dir)))


def response_skills(spark, sf_dir):
    got = responses.response_skills(responses.parse_responses(views.model_responses(spark, sf_dir)))
    return got.select("repo_id", "ord", "name", "description", "source_dir", _joined("patterns"), _joined("triggers"), "category")


def agent_flatten(spark, sf_dir):
    return _agent_columns(responses.response_agents(responses.parse_responses(views.model_responses(spark, sf_dir))))


def tool_normalise(spark, sf_dir):
    """Tools as strings, objects with and without fields, numbers, and a non-array."""
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit('["make t'), key, F.lit('",{"name":"n'), key, F.lit('"},{"command":"c","description":"d"},'), key, F.lit(",null]"))
    value = F.parse_json(F.when(F.col("p_size") % 10 == 0, F.lit('"scalar"')).otherwise(text))
    rows = views.table(spark, sf_dir, "part").select("p_partkey", value.alias("tools"))
    exploded = rows.select("p_partkey", F.posexplode(responses.normalize_tools(F.col("tools"))).alias("pos", "t"))
    return exploded.select("p_partkey", F.col("pos").cast("long").alias("pos"), "t.name", "t.command", "t.description")


def all_tools(spark, sf_dir):
    return responses.extract_tools(responses.response_agents(responses.parse_responses(views.model_responses(spark, sf_dir))))


def _sessions(spark, sf_dir):
    """Session results per part: an error for every seventh size, none at all for every seventeenth."""
    part = views.table(spark, sf_dir, "part").where(F.col("p_size") % 17 != 0)
    status = F.when(F.col("p_size") % 7 == 0, "error").otherwise("ok")
    sessions = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("repo_id"), status.alias("status"))
    return views.model_responses(spark, sf_dir, sessions).select("repo_id", "status", F.col("response").alias("text"))


def _metadata(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    repo = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    return part.select(repo.alias("repo_id"), F.col("p_brand").alias("owner"), repo.alias("repo"), F.lit("MIT").alias("license"))


def response_routing(spark, sf_dir):
    profile, sessions = views.part_profiles(spark, sf_dir), _sessions(spark, sf_dir)
    local = analyse.route(profile, sessions, "local").select("repo_id", F.col("route").alias("local_route"))
    remote = analyse.route(profile, sessions, "remote").select("repo_id", F.col("route").alias("remote_route"))
    return local.join(remote, "repo_id")


_STORES: dict[tuple[str, str], StageStore] = {}


def _store(spark, sf_dir):
    """One store for all queries over a folder of tables, removed when the application ends."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        _STORES[key] = StageStore(spark, at_exit=True)
    return _STORES[key]


def _local(spark, sf_dir):
    return analyse.analyse_local(views.part_profiles(spark, sf_dir), _sessions(spark, sf_dir), store=_store(spark, sf_dir))


def _remote(spark, sf_dir):
    return analyse.analyse_remote(
        views.part_profiles(spark, sf_dir), _sessions(spark, sf_dir), _metadata(spark, sf_dir), store=_store(spark, sf_dir)
    )


def _licence_files(spark, sf_dir):
    """One file per part that settles its licence, or does not."""
    size = F.col("p_size") % 6
    return views.table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("repo_id"),
        views.pick(["LICENSE", "COPYING", "package.json", "package.json", "README.md", "LICENCE"], size).alias("path"),
        views.pick(
            ["The MIT License", "GNU General Public License v3", '{"license":"Apache-2.0"}', '{"license":"SSPL-1.0"}', "MIT License", "Ask us first."], size
        ).alias("content"),
    )


def _gated_local(spark, sf_dir):
    return analyse.gated(_local(spark, sf_dir), licensing.resolve_license(_licence_files(spark, sf_dir)))


def _gated_remote(spark, sf_dir, dry_run=False):
    given = views.pick(["MIT", "SSPL-1.0", None, "GPL-3.0", ""], F.col("p_size") % 5)
    part = views.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("repo_id"), given.alias("license"))
    return analyse.gated(_remote(spark, sf_dir), part, dry_run)


def gated_registry_local(spark, sf_dir):
    """Checked-out repositories from responses through the licence gate to the catalogue."""
    return _gated_local(spark, sf_dir)[0].registry.select("repo_id", "ord", "type", "name")


def gated_blocked_local(spark, sf_dir):
    return _gated_local(spark, sf_dir)[1]


def gated_skills_remote(spark, sf_dir):
    return _gated_remote(spark, sf_dir)[0].skills.select("repo_id", "ord", "name", "category")


def gated_blocked_remote(spark, sf_dir):
    return _gated_remote(spark, sf_dir)[1]


def gated_dry_run_remote(spark, sf_dir):
    """A dry run keeps every repository and blocks none."""
    run, blocked = _gated_remote(spark, sf_dir, dry_run=True)
    kept = run.repos.select("repo_id", F.lit("").alias("reason"))
    return kept.unionByName(blocked)


def _hook_columns(hooks):
    return hooks.select("repo_id", "ord", "name", "event", F.array_join("commands", "|").alias("commands"))


def analysis_agents_local(spark, sf_dir):
    got = _local(spark, sf_dir).agents
    return got.select("repo_id", "ord", "name", _joined("skills"), "is_sub_agent", F.coalesce("parent_agent", F.lit("")).alias("parent_agent"))


def analysis_hooks_local(spark, sf_dir):
    return _hook_columns(_local(spark, sf_dir).hooks)


def analysis_summary_local(spark, sf_dir):
    return _local(spark, sf_dir).repos.select("repo_id", "repo_name", "summary")


def analysis_counts_local(spark, sf_dir):
    return _local(spark, sf_dir).summary()


def analysis_skills_remote(spark, sf_dir):
    return _remote(spark, sf_dir).skills.select("repo_id", "ord", "name", "category")


def analysis_hooks_remote(spark, sf_dir):
    return _hook_columns(_remote(spark, sf_dir).hooks)


def analysis_summary_remote(spark, sf_dir):
    got = _remote(spark, sf_dir).repos
    return got.select("repo_id", "repo_name", "summary", "language", F.coalesce("framework", F.lit("")).alias("framework"))


def handoff_edges(spark, sf_dir):
    got = hierarchy.handoff_edges(views.agents(spark, sf_dir))
    return got.select("repo_id", "ord", "src", "dst", F.array_join("triggers", ",").alias("triggers"))


def handoff_documents(spark, sf_dir):
    return hierarchy.handoff_documents(hierarchy.handoff_edges(views.agents(spark, sf_dir)))


_LOCAL_OK = "valid AND p_size % 7 <> 0 AND p_size % 17 <> 0"
_REMOTE_OK = "valid AND p_size % 17 <> 0"
_LANG = "(['TypeScript','Python','Go','Rust'])[p_size % 4 + 1]"
_MODEL_SUMMARY = "CASE WHEN p_size % 2 = 0 THEN 'Part ' || p_partkey ELSE 'first' END"
_DEFAULT_HOOKS = f"""
  SELECT repo_id, 0 AS k, 'pre-commit-quality' AS name, 'pre-commit' AS event,
    CASE {_LANG} WHEN 'TypeScript' THEN 'npm run lint|npm run build' WHEN 'Python' THEN 'ruff check .|ruff format --check .'
         ELSE 'go fmt ./...|golangci-lint run' END AS commands
  FROM responses WHERE {{when}} AND {_LANG} <> 'Rust'
  UNION ALL SELECT repo_id, 1, 'pre-push-tests', 'pre-push',
    CASE {_LANG} WHEN 'TypeScript' THEN 'npm test' WHEN 'Python' THEN 'pytest' ELSE 'go test ./...' END
  FROM responses WHERE {{when}} AND {{tests}} AND {_LANG} <> 'Rust'
  UNION ALL SELECT repo_id, 2, 'post-generate-validate', 'post-generate', '{defaults.VALIDATE_COMMAND}' FROM responses WHERE {{when}}"""

_LOCAL_ALLOWED = "p_size % 6 IN (0, 1, 2)"
_LOCAL_REASON = """(['', '', '', 'License "SSPL-1.0" is not permissive.', 'No license file found.', 'License "Unknown" is not permissive.'])[p_size % 6 + 1]"""

SQL = {
    "json_extract": with_views("""WITH x AS (SELECT *, regexp_extract(response, '\\{.*\\}', 0, 's') AS j FROM responses)
SELECT repo_id, j <> '' AS has_braces, j <> '' AND json_valid(j) AS is_json, valid,
  CASE WHEN p_size % 11 = 0 OR p_size % 13 = 0 THEN '' WHEN p_size % 2 = 0 THEN 'Part ' || p_partkey ELSE 'first' END AS summary FROM x""", "responses"),
    "response_findings": with_views("""SELECT repo_id, CASE WHEN p_size % 11 = 0 OR p_size % 13 = 0 THEN '(json)' ELSE 'skills.0.category' END AS path
FROM responses WHERE NOT valid""", "responses"),
    "response_skills": with_views("""SELECT repo_id, 0 AS ord, p_name AS name, p_type AS description, '' AS source_dir, 'a,' || p_partkey AS patterns, '' AS triggers,
  (['architecture','quality','misc','patterns'])[p_size % 4 + 1] AS category FROM responses WHERE valid
UNION ALL SELECT repo_id, 1, 'extra', CAST(p_partkey AS VARCHAR), '', '', '', 'patterns' FROM responses WHERE valid AND p_size % 5 = 0""", "responses"),
    "agent_flatten": with_views("""SELECT repo_id, 0 AS ord, 'lead' || p_partkey AS name, '' AS description, '' AS skills, 'npm/npm test/npm test,build/build/build' AS tools,
  false AS is_sub_agent, '' AS parent_agent, 'ref,' || p_brand AS sub_agents, '' AS triggers FROM responses WHERE valid
UNION ALL SELECT repo_id, 1, p_brand, '', 's', '', true, 'lead' || p_partkey, 'leaf', '' FROM responses WHERE valid
UNION ALL SELECT repo_id, 2, 'leaf', '', '', 'x/x y/x y', true, p_brand, '(none)', '' FROM responses WHERE valid
UNION ALL SELECT repo_id, 3, 'other', '', '', '', true, 'lead' || p_partkey, '(none)', '' FROM responses WHERE valid""", "responses"),
    "tool_normalise": """WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part WHERE p_size % 10 <> 0)
SELECT p_partkey, 0 AS pos, 'make' AS name, 'make t' || k AS command, 'make t' || k AS description FROM p
UNION ALL SELECT p_partkey, 1, 'n' || k, 'n' || k, 'n' || k FROM p UNION ALL SELECT p_partkey, 2, 'unknown', 'c', 'd' FROM p
UNION ALL SELECT p_partkey, 3, 'unknown', k, k FROM p UNION ALL SELECT p_partkey, 4, 'unknown', 'null', 'null' FROM p""",
    "all_tools": with_views("""SELECT repo_id, 0 AS ord, 0 AS pos, 'npm' AS name, 'npm test' AS command, 'npm test' AS description FROM responses WHERE valid
UNION ALL SELECT repo_id, 0, 1, 'build', 'build', 'build' FROM responses WHERE valid
UNION ALL SELECT repo_id, 2, 0, 'x', 'x y', 'x y' FROM responses WHERE valid""", "responses"),
    "response_routing": with_views(f"""SELECT repo_id, CASE WHEN {_LOCAL_OK} THEN 'model' ELSE 'heuristic' END AS local_route,
  CASE WHEN p_size % 17 = 0 THEN 'heuristic' WHEN valid THEN 'model' ELSE 'empty' END AS remote_route FROM responses""", "responses"),
    "analysis_agents_local": with_views(f"""SELECT repo_id, 0 AS ord, 'lead' || p_partkey AS name, '' AS skills, false AS is_sub_agent, '' AS parent_agent FROM responses WHERE {_LOCAL_OK}
UNION ALL SELECT repo_id, 1, p_brand, 's', true, 'lead' || p_partkey FROM responses WHERE {_LOCAL_OK}
UNION ALL SELECT repo_id, 2, 'leaf', '', true, p_brand FROM responses WHERE {_LOCAL_OK}
UNION ALL SELECT repo_id, 3, 'other', '', true, 'lead' || p_partkey FROM responses WHERE {_LOCAL_OK}
UNION ALL SELECT repo_id, 0, 'root', CASE WHEN p_size % 3 = 0 THEN 'src-patterns,lib-patterns' WHEN p_size % 6 = 1 THEN 'clients-patterns' ELSE '' END, false, ''
  FROM responses WHERE NOT ({_LOCAL_OK})
UNION ALL SELECT repo_id, 1, 'client', '', true, 'root' FROM responses WHERE NOT ({_LOCAL_OK}) AND p_size % 2 = 0""", "responses"),
    "analysis_hooks_local": with_views(f"""WITH h AS (SELECT repo_id, 0 AS k, 'h' || p_partkey AS name, 'pre-push' AS event, 'go' AS commands FROM responses WHERE {_LOCAL_OK} AND p_size % 3 = 0
  UNION ALL {_DEFAULT_HOOKS.format(when=f"NOT ({_LOCAL_OK} AND p_size % 3 = 0)", tests="p_size % 2 = 0")})
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY k) - 1 AS ord, name, event, commands FROM h""", "responses"),
    "analysis_summary_local": with_views(f"""SELECT repo_id, repo_id AS repo_name, CASE WHEN {_LOCAL_OK} THEN {_MODEL_SUMMARY}
  ELSE 'A ' || {_LANG} || ' repository' || CASE WHEN p_size % 2 = 0 THEN ' using Flask with 1' ELSE ' with 0' END || ' detected domains.' END AS summary FROM responses""", "responses"),
    "analysis_counts_local": with_views(f"""SELECT repo_id,
  CASE WHEN {_LOCAL_OK} THEN CASE WHEN p_size % 5 = 0 THEN 2 ELSE 1 END ELSE CASE p_size % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END END AS n_skills,
  CASE WHEN {_LOCAL_OK} THEN 4 WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS n_agents,
  CASE WHEN {_LOCAL_OK} AND p_size % 3 = 0 THEN 1 WHEN {_LANG} = 'Rust' THEN 1 WHEN p_size % 2 = 0 THEN 3 ELSE 2 END AS n_hooks FROM responses""", "responses"),
    "analysis_skills_remote": with_views(f"""SELECT repo_id, 0 AS ord, p_name AS name, (['architecture','quality','misc','patterns'])[p_size % 4 + 1] AS category FROM responses WHERE {_REMOTE_OK}
UNION ALL SELECT repo_id, 1, 'extra', 'patterns' FROM responses WHERE {_REMOTE_OK} AND p_size % 5 = 0
UNION ALL SELECT repo_id, 0, CASE p_size % 3 WHEN 0 THEN 'src-patterns' ELSE 'clients-patterns' END, 'patterns' FROM responses WHERE p_size % 17 = 0 AND p_size % 3 < 2
UNION ALL SELECT repo_id, 1, 'lib-patterns', 'patterns' FROM responses WHERE p_size % 17 = 0 AND p_size % 3 = 0""", "responses"),
    "analysis_hooks_remote": with_views(f"""WITH h AS ({_DEFAULT_HOOKS.format(when="true", tests="false")})
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY k) - 1 AS ord, name, event, commands FROM h""", "responses"),
    "analysis_summary_remote": with_views(f"""SELECT repo_id, repo_id AS repo_name, CASE WHEN {_REMOTE_OK} THEN {_MODEL_SUMMARY}
  WHEN p_size % 17 = 0 THEN 'A ' || {_LANG} || ' repository' || CASE WHEN p_size % 2 = 0 THEN ' using Flask.' ELSE '.' END ELSE '' END AS summary,
  {_LANG} AS language, CASE WHEN p_size % 2 = 0 THEN 'Flask' ELSE '' END AS framework FROM responses""", "responses"),
    "gated_registry_local": with_views(f"""WITH k AS (
  SELECT repo_id, p_size, 0 AS ord, p_name AS name FROM responses WHERE {_LOCAL_OK}
  UNION ALL SELECT repo_id, p_size, 1, 'extra' FROM responses WHERE {_LOCAL_OK} AND p_size % 5 = 0
  UNION ALL SELECT repo_id, p_size, 0, CASE p_size % 3 WHEN 0 THEN 'src-patterns' ELSE 'clients-patterns' END FROM responses WHERE NOT ({_LOCAL_OK}) AND p_size % 3 < 2
  UNION ALL SELECT repo_id, p_size, 1, 'lib-patterns' FROM responses WHERE NOT ({_LOCAL_OK}) AND p_size % 3 = 0),
a AS (SELECT repo_id, p_size, 0 AS ord, 'lead' || p_partkey AS name FROM responses WHERE {_LOCAL_OK}
  UNION ALL SELECT repo_id, p_size, 1, p_brand FROM responses WHERE {_LOCAL_OK}
  UNION ALL SELECT repo_id, p_size, 2, 'leaf' FROM responses WHERE {_LOCAL_OK}
  UNION ALL SELECT repo_id, p_size, 3, 'other' FROM responses WHERE {_LOCAL_OK}
  UNION ALL SELECT repo_id, p_size, 0, 'root' FROM responses WHERE NOT ({_LOCAL_OK})
  UNION ALL SELECT repo_id, p_size, 1, 'client' FROM responses WHERE NOT ({_LOCAL_OK}) AND p_size % 2 = 0)
SELECT repo_id, CAST(ord + ({SKILL_OFFSET}) AS BIGINT) AS ord, 'skill' AS type, name FROM k WHERE {_LOCAL_ALLOWED}
UNION ALL SELECT repo_id, CAST(ord AS BIGINT), 'agent', name FROM a WHERE {_LOCAL_ALLOWED}""", "responses"),
    "gated_blocked_local": f"SELECT 'p' || p_partkey AS repo_id, {_LOCAL_REASON} AS reason FROM part WHERE NOT ({_LOCAL_ALLOWED})",
    "gated_skills_remote": with_views(f"""WITH k AS (
  SELECT repo_id, p_size, 0 AS ord, p_name AS name, (['architecture','quality','misc','patterns'])[p_size % 4 + 1] AS category FROM responses WHERE {_REMOTE_OK}
  UNION ALL SELECT repo_id, p_size, 1, 'extra', 'patterns' FROM responses WHERE {_REMOTE_OK} AND p_size % 5 = 0
  UNION ALL SELECT repo_id, p_size, 0, CASE p_size % 3 WHEN 0 THEN 'src-patterns' ELSE 'clients-patterns' END, 'patterns' FROM responses WHERE p_size % 17 = 0 AND p_size % 3 < 2
  UNION ALL SELECT repo_id, p_size, 1, 'lib-patterns', 'patterns' FROM responses WHERE p_size % 17 = 0 AND p_size % 3 = 0)
SELECT repo_id, ord, name, category FROM k WHERE p_size % 5 IN (0, 3)""", "responses"),
    "gated_blocked_remote": """SELECT 'p' || p_partkey AS repo_id, CASE p_size % 5 WHEN 1 THEN 'License "SSPL-1.0" is not permissive.' ELSE 'No license detected.' END AS reason
FROM part WHERE p_size % 5 IN (1, 2, 4)""",
    "gated_dry_run_remote": "SELECT 'p' || p_partkey AS repo_id, '' AS reason FROM part",
    "handoff_edges": with_views("""SELECT repo_id, ord, CASE WHEN coalesce(parent_agent, '') = '' THEN 'repo-root' ELSE parent_agent END AS src, name AS dst,
  CASE WHEN len(triggers) = 0 THEN name ELSE array_to_string(triggers, ',') END AS triggers FROM agents WHERE is_sub_agent""", "agents"),
    "handoff_documents": with_views("""WITH e AS (SELECT repo_id, ord, '    {' || chr(10) || '      "from": "' || CASE WHEN coalesce(parent_agent, '') = '' THEN 'repo-root' ELSE parent_agent END
  || '",' || chr(10) || '      "to": "' || name || '",' || chr(10) || '      "triggers": [' || chr(10)
  || array_to_string(['        "' || t || '"' FOR t IN CASE WHEN len(triggers) = 0 THEN [name] ELSE triggers END], ',' || chr(10)) || chr(10) || '      ]' || chr(10) || '    }' AS item
  FROM agents WHERE is_sub_agent)
SELECT repo_id, '{' || chr(10) || '  "handoffs": [' || chr(10) || string_agg(item, ',' || chr(10) ORDER BY ord) || chr(10) || '  ]' || chr(10) || '}' || chr(10) AS content
FROM e GROUP BY repo_id""", "agents"),
}

QUERIES = {
    f.__name__: f
    for f in (
        json_extract, response_findings, response_skills, agent_flatten, tool_normalise, all_tools, response_routing,
        analysis_agents_local, analysis_hooks_local, analysis_summary_local, analysis_counts_local,
        analysis_skills_remote, analysis_hooks_remote, analysis_summary_remote, gated_registry_local, gated_blocked_local,
        gated_skills_remote, gated_blocked_remote, gated_dry_run_remote, handoff_edges, handoff_documents,
    )
}
