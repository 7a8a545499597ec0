"""Queries over the catalogue of skills and agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoquarry.operators import catalogue, search_index
from repoquarry.plans.storage import working_dir
from repoquarry.sources import registry_files
from workload import views
from workload.sql_views import with_views


def _registry(spark, sf_dir):
    return catalogue.build_registry(views.skills(spark, sf_dir), views.agents(spark, sf_dir))


def registry_build(spark, sf_dir):
    return _entries(_registry(spark, sf_dir))


def registry_roundtrip(spark, sf_dir):
    """The catalogue written as lines, read back and parsed."""
    path = working_dir(spark, "registry")
    registry_files.write_registry(_registry(spark, sf_dir), path)
    return _entries(registry_files.parse_registry(registry_files.read_registry(spark, path))[0])


def _entries(registry):
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("(none)")).alias(name)

    return registry.select(
        "repo_id", "ord", "type", "name", "file", text("vs_code_agent"), "description", text("category"),
        F.array_join("triggers", ",").alias("triggers"), text("parent_agent"),
        F.coalesce(F.array_join("sub_agents", ","), F.lit("(none)")).alias("sub_agents"), text("is_sub_agent"),
    )


def registry_list(spark, sf_dir):
    return catalogue.list_entries(_registry(spark, sf_dir)).select("repo_id", "ord", "type", "name")


def registry_json(spark, sf_dir):
    return _registry(spark, sf_dir).select("repo_id", "ord", registry_files.registry_line().alias("line"))


def registry_scan(spark, sf_dir):
    entries, _ = registry_files.parse_registry(views.catalogue_lines(spark, sf_dir))
    none = F.lit("(none)")
    return entries.select(
        "repo_id", "ord", F.coalesce("type", none).alias("type"), F.coalesce("name", none).alias("name"),
        F.coalesce("description", none).alias("description"), F.coalesce(F.array_join("triggers", ","), none).alias("triggers"),
    )


def registry_scan_strict(spark, sf_dir):
    entries, _ = registry_files.parse_registry(views.catalogue_lines(spark, sf_dir), strict=True)
    return entries.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_entries"))


def registry_quarantine(spark, sf_dir):
    return registry_files.parse_registry(views.catalogue_lines(spark, sf_dir))[1]


def _hits(found):
    return found.select("repo_id", "ord", "type", "name", "score")


def registry_search(spark, sf_dir):
    return _hits(catalogue.search(_registry(spark, sf_dir), "Blue"))


def registry_search_agents(spark, sf_dir):
    return _hits(catalogue.search(_registry(spark, sf_dir), "nation 1", type="agent", limit=25))


def registry_search_unmatched(spark, sf_dir):
    """No entry holds the words; root agents come back all the same."""
    return _hits(catalogue.search(_registry(spark, sf_dir), "nothing like this", limit=5))


def registry_search_matched(spark, sf_dir):
    """Only entries that hold the words: root agents without them are left out."""
    return _hits(catalogue.search(_registry(spark, sf_dir), "nation 1", limit=25, require_match=True))


def registry_lookup(spark, sf_dir):
    return catalogue.get_entry(_registry(spark, sf_dir), "red-bolt").select("repo_id", "ord", "type", "name", "description")


def _asked(spark, sf_dir):
    """One query per part: a word, a type, a fragment, nothing, or a full name."""
    size, word = F.col("p_size") % 6, F.substring_index("p_name", " ", 1)
    text = (
        F.when(size == 0, word).when(size == 1, F.col("p_type")).when(size == 2, F.lit("gi")).when(size == 3, F.lit(""))
        .when(size == 4, F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))).otherwise(F.concat(F.lit("agent-"), F.col("p_size").cast("string")))
    )
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), text.alias("query"))


def _ranked(found):
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "score", "repo_id", "ord")


def registry_search_batch(spark, sf_dir):
    return _ranked(catalogue.search_batch(views.spread(_registry(spark, sf_dir)), _asked(spark, sf_dir), k=10))


def registry_search_indexed(spark, sf_dir):
    """The same answers from an index that was written in two parts, skills and then agents."""
    path, registry = working_dir(spark, "index"), _registry(spark, sf_dir)
    search_index.write_index(registry.where("type = 'skill'"), path)
    search_index.write_index(registry.where("type = 'agent'"), path)
    return _ranked(search_index.search_indexed(search_index.read_index(spark, path), _asked(spark, sf_dir), k=10))


_REGISTRY = f"""WITH reg AS (
  SELECT repo_id, CAST(ord + ({catalogue.SKILL_OFFSET}) AS BIGINT) AS ord, 'skill' AS type, name, '.github/skills/' || name || '/SKILL.md' AS file, CAST(NULL AS VARCHAR) AS vs_code_agent, description, category,
    triggers, CAST(NULL AS VARCHAR) AS parent_agent, CAST(NULL AS VARCHAR[]) AS sub_agents, CAST(NULL AS BOOLEAN) AS is_sub_agent FROM skills
  UNION ALL SELECT repo_id, ord, 'agent', name, '.github/agents/' || name || '.agent.md', '.github/agents/' || name || '.agent.md',
    description, NULL, triggers, parent_agent, sub_agents, is_sub_agent FROM agents)"""


def _score(q: str) -> str:
    return f"""(CASE WHEN lower(name) = {q} THEN 100 ELSE 0 END + CASE WHEN contains(lower(name), {q}) THEN 50 ELSE 0 END
  + CASE WHEN contains(lower(description), {q}) THEN 30 ELSE 0 END
  + 20 * len([t FOR t IN triggers IF contains(lower(t), {q})]) + 40 * len([t FOR t IN triggers IF lower(t) = {q}])
  + CASE WHEN contains(lower(coalesce(category, '')), {q}) AND category IS NOT NULL THEN 10 ELSE 0 END
  + CASE WHEN type = 'agent' AND NOT is_sub_agent THEN 5 ELSE 0 END)"""


def _search(q: str, limit: int, where: str = "true") -> str:
    return with_views(
        _REGISTRY + f""" SELECT repo_id, ord, type, name, CAST({_score("'" + q + "'")} AS BIGINT) AS score FROM reg
  WHERE {where} AND {_score("'" + q + "'")} > 0 ORDER BY score DESC, repo_id, ord LIMIT {limit}""", "skills", "agents")


_QUERY_TEXT = """CASE p_size % 6 WHEN 0 THEN string_split(p_name, ' ')[1] WHEN 1 THEN p_type WHEN 2 THEN 'gi' WHEN 3 THEN ''
  WHEN 4 THEN replace(p_name, ' ', '-') ELSE 'agent-' || p_size END"""

SQL = {
    "registry_build": with_views(_REGISTRY + """ SELECT repo_id, ord, type, name, file, coalesce(vs_code_agent, '(none)') AS vs_code_agent, description,
  coalesce(category, '(none)') AS category, array_to_string(triggers, ',') AS triggers, coalesce(parent_agent, '(none)') AS parent_agent,
  coalesce(array_to_string(sub_agents, ','), '(none)') AS sub_agents, coalesce(CAST(is_sub_agent AS VARCHAR), '(none)') AS is_sub_agent FROM reg""", "skills", "agents"),
    "registry_list": with_views(_REGISTRY + " SELECT repo_id, ord, type, name FROM reg ORDER BY repo_id, ord", "skills", "agents"),
    "registry_json": with_views(_REGISTRY + """ SELECT repo_id, ord, '{"type":"' || type || '","name":"' || name || '","file":"' || file || '"'
  || CASE WHEN type = 'agent' THEN ',"vsCodeAgent":"' || vs_code_agent || '"' ELSE '' END || ',"description":"' || description || '"'
  || coalesce(',"category":"' || category || '"', '') || ',"triggers":[' || array_to_string(['"' || t || '"' FOR t IN triggers], ',') || ']'
  || CASE WHEN type = 'agent' THEN ',"isSubAgent":' || is_sub_agent ELSE '' END || coalesce(',"parentAgent":"' || parent_agent || '"', '')
  || coalesce(',"subAgents":[' || array_to_string(['"' || s || '"' FOR s IN sub_agents], ',') || ']', '') || '}' AS line FROM reg""", "skills", "agents"),
    "registry_scan": with_views("""SELECT repo_id, ord, CASE way WHEN 6 THEN '' WHEN 7 THEN '(none)' ELSE 'skill' END AS type,
  CASE WHEN way = 7 THEN '(none)' ELSE event_type END AS name, CASE WHEN way IN (6, 7) THEN '(none)' ELSE CAST(user_id AS VARCHAR) END AS description,
  CASE WHEN way IN (6, 7) THEN '(none)' ELSE 't' END AS triggers FROM catalogue_lines WHERE way NOT IN (4, 5)""", "catalogue_lines"),
    "registry_scan_strict": with_views("""SELECT repo_id, count(*) AS n_entries FROM catalogue_lines WHERE line <> ''
  AND repo_id NOT IN (SELECT repo_id FROM catalogue_lines WHERE line <> '' AND NOT json_valid(line)) GROUP BY repo_id""", "catalogue_lines"),
    "registry_quarantine": with_views("SELECT repo_id, ord, line FROM catalogue_lines WHERE line <> '' AND NOT json_valid(line)", "catalogue_lines"),
    "registry_search": _search("blue", 10),
    "registry_search_agents": _search("nation 1", 25, "type = 'agent'"),
    "registry_search_unmatched": _search("nothing like this", 5),
    "registry_search_matched": _search("nation 1", 25, f"""{_score("'nation 1'")} > CASE WHEN type = 'agent' AND NOT is_sub_agent THEN 5 ELSE 0 END"""),
    "registry_lookup": with_views(_REGISTRY + " SELECT repo_id, ord, type, name, description FROM reg WHERE name = 'red-bolt' ORDER BY repo_id, ord LIMIT 1", "skills", "agents"),
    "registry_search_batch": with_views(_REGISTRY + f""", ask AS (SELECT p_partkey AS query_id, lower({_QUERY_TEXT}) AS q FROM part),
scored AS (SELECT q, repo_id, ord, CAST({_score("q")} AS BIGINT) AS score FROM (SELECT DISTINCT q FROM ask) CROSS JOIN reg),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, repo_id, ord) AS rank FROM scored WHERE score > 0)
SELECT query_id, rank, score, repo_id, ord FROM ask JOIN top USING (q) WHERE rank <= 10""", "skills", "agents"),
}

SQL["registry_roundtrip"] = SQL["registry_build"]
SQL["registry_search_indexed"] = SQL["registry_search_batch"]

QUERIES = {
    f.__name__: f
    for f in (
        registry_build, registry_roundtrip, registry_list, registry_json, registry_scan, registry_scan_strict, registry_quarantine,
        registry_search, registry_search_agents, registry_search_unmatched, registry_search_matched,
        registry_lookup, registry_search_batch, registry_search_indexed,
    )
}
