"""Queries over rendered documents and the collection operators behind them."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoquarry import rules
from repoquarry.functions import text as tx
from repoquarry.operators import documents as docs
from repoquarry.plans.storage import working_dir
from repoquarry.sources.assets import read_assets, upsert_assets, write_assets
from workload import views
from workload.sql_views import with_views


def text_scalars(spark, sf_dir):
    """Name and quoting helpers over part names, types and document first lines."""
    part = views.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat("p_brand", F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("s"))
    docs_ = views.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("s"))
    s = F.col("s")
    return part.unionByName(docs_).select(
        "id", F.md5(tx.sanitize_name(s)).alias("sanitized"), F.md5(tx.title_case(s)).alias("titled"), F.md5(tx.yaml_quote(s)).alias("quoted")
    )


def category_texts(spark, sf_dir):
    return views.skills(spark, sf_dir).select("repo_id", "ord", tx.category_description(F.col("category")).alias("text"))


def skill_documents(spark, sf_dir):
    return docs.skill_documents(views.skills(spark, sf_dir)).select("repo_id", "ord", "path", "content")


def hook_documents(spark, sf_dir):
    return docs.hook_documents(views.hooks(spark, sf_dir)).select("repo_id", "ord", "path", "content")


def _shape(spark, sf_dir, single=False):
    return docs.repo_shape(views.brands(spark, sf_dir), views.agents(spark, sf_dir), single)


def document_modes(spark, sf_dir):
    got = _shape(spark, sf_dir)
    return got.select("repo_id", "multi", "has_root", F.coalesce("root_description", F.lit("")).alias("root_description"))


def main_agent_documents(spark, sf_dir):
    shape = _shape(spark, sf_dir, single=True)
    got = docs.main_agent_documents(shape, views.skills(spark, sf_dir), views.agents(spark, sf_dir))
    return got.select("repo_id", "path", "content")


def root_agent_documents(spark, sf_dir):
    got = docs.root_agent_documents(_shape(spark, sf_dir), views.skills(spark, sf_dir), views.agents(spark, sf_dir))
    return got.select("repo_id", "path", "content")


def sub_agent_documents(spark, sf_dir):
    return docs.sub_agent_documents(views.agents(spark, sf_dir), views.skills(spark, sf_dir)).select("repo_id", "ord", "path", "content")


def instruction_documents(spark, sf_dir):
    return docs.instruction_blocks(_shape(spark, sf_dir), views.skills(spark, sf_dir), views.agents(spark, sf_dir))


def conventions(spark, sf_dir):
    got = docs.conventions(views.skills(spark, sf_dir))
    return got.select("repo_id", F.col("rank").cast("long").alias("rank"), "pattern")


def text_conventions(spark, sf_dir):
    """The same over every line of every document, per source."""
    lines = views.table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "pattern")
    )
    numbered = lines.select("repo_id", F.struct("doc_id", "pos").alias("position"), "pattern")
    got = docs.distinct_patterns(numbered)
    return got.select("repo_id", F.col("rank").cast("long").alias("rank"), "pattern")


def distinct_tools(spark, sf_dir):
    got = docs.distinct_tools(docs.numbered_tools(views.agents(spark, sf_dir)))
    return got.select("repo_id", "command", "position.ord", F.col("position.pos").cast("long").alias("pos"), "description")


def first_seen_orders(spark, sf_dir):
    """First line item per ship date and return flag: the same operator over the largest table."""
    items = views.table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("repo_id"), F.col("l_shipdate").cast("date").cast("string").alias("command"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("position"), F.col("l_partkey").cast("string").alias("description"),
    )
    return docs.distinct_tools(items)


def structure(spark, sf_dir):
    return docs.structure(views.skills(spark, sf_dir)).select("repo_id", "source_dir", "ord", "description")


def testing_info(spark, sf_dir):
    got = docs.testing_info(views.skills(spark, sf_dir), docs.numbered_tools(views.agents(spark, sf_dir)))
    return got.select("repo_id", F.col("tier").cast("long").alias("tier"), "position.ord", F.col("position.pos").cast("long").alias("pos"), "info")


def pattern_language(spark, sf_dir):
    return docs.pattern_language(docs.numbered_patterns(views.skills(spark, sf_dir)))


def managed_merge(spark, sf_dir):
    """Documents as existing files: with both markers, with one, or with none."""
    start, end = f"<!-- {docs.MANAGED_TAG} -->", f"<!-- /{docs.MANAGED_TAG} -->"
    way, text = F.col("doc_id") % 4, F.col("text")
    old = (
        F.when(way == 0, F.concat(text, F.lit(start), text, F.lit(end), text)).when(way == 1, F.concat(F.lit(start), text))
        .when(way == 2, text)
    )
    table = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("repo_id"), F.lit("x").alias("path"), old.alias("content"), "n_chars")
    existing = table.where(F.col("content").isNotNull()).select("repo_id", "path", "content")
    block = F.concat(F.lit(start), F.col("n_chars").cast("string"), F.lit(end))
    got = docs.merge_managed(existing, table.select("repo_id", "path", block.alias("content")))
    return got.select("repo_id", F.md5("content").alias("content_md5"), F.char_length("content").cast("long").alias("length"))


def run_summary(spark, sf_dir):
    return docs.run_summary(views.brands(spark, sf_dir), views.skills(spark, sf_dir), views.agents(spark, sf_dir), views.hooks(spark, sf_dir))


def rendered_assets(spark, sf_dir):
    """The whole document table, one row per path."""
    got = docs.render_assets(views.brands(spark, sf_dir), views.skills(spark, sf_dir), views.agents(spark, sf_dir), views.hooks(spark, sf_dir))
    return got.select("repo_id", "path", F.md5("content").alias("content_md5"))


def stored_assets(spark, sf_dir):
    """The document table written to buckets of repositories, and read back with the bucket a reader would look in."""
    path = working_dir(spark, "assets")
    brands, skills, agents, hooks = (view(spark, sf_dir) for view in (views.brands, views.skills, views.agents, views.hooks))
    rendered = docs.render_assets(brands, skills, agents, hooks, buckets=16)
    write_assets(rendered, path, buckets=16)
    right = F.col("bucket") == F.pmod(F.xxhash64("repo_id"), F.lit(16))
    return read_assets(spark, path).select("repo_id", "path", F.md5("content").alias("content_md5"), right.alias("in_bucket"))


def assets_upsert(spark, sf_dir):
    """Documents as stored files, two thirds of them upserted: half by a managed block, half by a new text; then the same again."""
    start, end = f"<!-- {docs.MANAGED_TAG} -->", f"<!-- /{docs.MANAGED_TAG} -->"
    way, text, number = F.col("doc_id") % 4, F.col("text"), F.col("doc_id").cast("string")
    old = F.when(way == 0, F.concat(text, F.lit(start), text, F.lit(end), text)).when(way == 1, F.concat(F.lit(start), text)).otherwise(text)
    place = F.concat(F.when(F.col("doc_id") % 8 < 4, "m/").otherwise("w/"), number)
    table = views.table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), place.alias("path"), "doc_id", old.alias("content"), "n_chars")
    path = working_dir(spark, "upserted")
    write_assets(table.where("doc_id % 4 < 3"), path, buckets=16)
    block = F.concat(F.lit(start), F.col("n_chars").cast("string"), F.lit(end))
    given = table.where("doc_id % 3 > 0").select("repo_id", "path", block.alias("content"))
    for _ in range(2):
        upsert_assets(given, path, buckets=16, managed=F.col("path").startswith("m/"))
    return read_assets(spark, path).select("repo_id", "path", F.md5("content").alias("content_md5"))


# ------------------------------------------------------------------ the same in SQL

_NL = "chr(10)"


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _title(x: str) -> str:
    return f"array_to_string([upper(w[1]) || w[2:] FOR w IN string_split({x}, '-')], ' ')"


def _quote(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '[:#{{}}\\[\\]&*?|>!%@`]') OR starts_with({x}, '''') OR starts_with({x}, '\"') "
        f"THEN '\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"' ELSE {x} END"
    )


def _sanitize(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]', '-', 'g')"


_CATEGORY = """CASE category WHEN 'architecture' THEN 'Structural patterns and system design' WHEN 'reliability' THEN 'Error handling, recovery, and fault tolerance'
  WHEN 'quality' THEN 'Testing, validation, and code quality' WHEN 'security' THEN 'Authentication, authorization, and data protection'
  WHEN 'patterns' THEN 'Common code patterns and conventions' ELSE 'General patterns' END"""

_SKILL_DOC = f"""'---' || {_NL} || 'name: ' || {_quote("name")} || {_NL} || 'description: ' || {_quote("description")} || {_NL} || '---' || {_NL} || {_NL}
  || '# ' || {_title("name")} || {_NL} || {_NL} || description || {_NL} || {_NL} || '## When to Use' || {_NL} || {_NL}
  || '- Working with code in `' || source_dir || '/`' || {_NL}
  || array_to_string(['- User mentions "' || t || '"' FOR t IN triggers], {_NL}) || {_NL} || {_NL} || '## Patterns' || {_NL} || {_NL}
  || CASE WHEN len(patterns) > 0 THEN array_to_string(['- ' || p FOR p IN patterns], {_NL}) ELSE '{rules.DEFAULT_PATTERNS}' END || {_NL} || {_NL}
  || '## Examples' || {_NL} || {_NL}
  || CASE WHEN len(examples) > 0 THEN array_to_string(['```' || {_NL} || e || {_NL} || '```' FOR e IN examples], {_NL} || {_NL}) ELSE '{rules.DEFAULT_EXAMPLES}' END
  || {_NL} || {_NL} || '## Category' || {_NL} || {_NL} || '**' || category || '** - ' || {_CATEGORY} || {_NL}"""
_SKILL_ROWS = f"SELECT repo_id, ord, '.github/skills/' || name || '/SKILL.md' AS path, {_SKILL_DOC} AS content FROM skills"

_HOOK_ROWS = f"""SELECT repo_id, ord, '.github/hooks/' || name || '.yaml' AS path,
  'name: ' || name || {_NL} || 'event: ' || event || {_NL} || 'description: ' || description || {_NL} || {_NL} || 'commands:' || {_NL}
  || array_to_string(['  - "' || c || '"' FOR c IN commands], {_NL}) || {_NL}
  || CASE WHEN condition IS NULL THEN '' ELSE {_NL} || 'condition: "' || condition || '"' || {_NL} END AS content FROM hooks"""

_LINK = f"'- [' || {_title('name')} || '](../skills/' || name || '/SKILL.md): ' || description"
_LISTS = f"""shape AS (
  SELECT b.*, coalesce(a.has_subs, false) AS multi, a.root IS NOT NULL AS has_root, coalesce(a.root, '') AS root_description
  FROM brands b LEFT JOIN (SELECT repo_id, bool_or(is_sub_agent) AS has_subs, arg_min(description, ord) FILTER (NOT is_sub_agent) AS root
    FROM agents GROUP BY repo_id) a USING (repo_id)),
links AS (SELECT repo_id, string_agg({_LINK}, {_NL} ORDER BY ord) AS skill_links FROM skills GROUP BY repo_id),
dtools AS (SELECT repo_id, command, min(ord) AS ord, arg_min(pos, (ord, pos)) AS pos, arg_min(description, (ord, pos)) AS description
  FROM tools GROUP BY repo_id, command),
cmds AS (SELECT repo_id, string_agg('- `' || command || '`', {_NL} ORDER BY ord, pos) AS commands FROM dtools GROUP BY repo_id),
subs AS (SELECT repo_id, string_agg('- `@' || name || '` for '
  || CASE WHEN len(triggers) > 0 THEN array_to_string(triggers, ', ') ELSE 'any task' END || ': ' || description, {_NL} ORDER BY ord) AS delegation
  FROM agents WHERE is_sub_agent GROUP BY repo_id)"""


def _head(title: str, description: str, tools) -> str:
    listed = "tools: [" + ", ".join(f"'{t}'" for t in tools) + "]"
    return (
        f"'---' || {_NL} || 'name: ' || {title} || {_NL} || 'description: ' || {_quote(description)} || {_NL} || {_lit(listed)} || {_NL} || '---'"
        f" || {_NL} || {_NL} || '# ' || {title} || ' Agent' || {_NL} || {_NL}"
    )


_SKILLS_AND_COMMANDS = f"""'## Skills' || {_NL} || {_NL} || coalesce(skill_links, '{rules.DEFAULT_SKILLS}') || {_NL} || {_NL}
  || '## Commands' || {_NL} || {_NL} || coalesce(commands, '{rules.DEFAULT_COMMANDS}') || {_NL} || {_lit(docs._MAIN_GUIDE)}"""
_JOINED = "FROM d LEFT JOIN links USING (repo_id) LEFT JOIN cmds USING (repo_id) LEFT JOIN subs USING (repo_id)"


def _described(name: str, fallback: str) -> str:
    return f"""d AS (SELECT *, {name} AS n, CASE WHEN root_description <> '' THEN root_description WHEN summary <> '' THEN summary
  ELSE '{fallback}' END AS described FROM shape)"""


def _main_rows(where: str) -> str:
    return f"""SELECT repo_id, '.github/agents/' || n || '.agent.md' AS path, {_head(_title("n"), "described", rules.EDITOR_TOOLS)}
  || described || {_NL} || {_NL} || {_SKILLS_AND_COMMANDS} || {_NL} AS content {_JOINED} WHERE {where}"""


_MAIN_D = _described(_sanitize("repo_name"), "Helper for work on this code base")
_ROOT_D = _described(_sanitize("repo_name") + " || '-root'", "Entry point that hands work to the other agents")
_ROOT_ROWS = f"""SELECT repo_id, '.github/agents/' || n || '.agent.md' AS path, {_head(_title("n"), "described", (*rules.EDITOR_TOOLS, rules.DELEGATE_TOOL))}
  || described || {_NL} || {_NL} || '## Hand-offs' || {_NL} || {_NL} || delegation || {_NL} || {_NL}
  || {_SKILLS_AND_COMMANDS} || {_NL} || {_lit(docs._DELEGATE_GUIDE)} || {_NL} AS content {_JOINED} WHERE multi AND has_root"""

_SUB_LINKS = f"""sub_links AS (SELECT a.repo_id, a.ord, string_agg({_LINK.replace("name", "s.name").replace("description", "s.description")}, {_NL} ORDER BY s.ord) AS skill_links
  FROM agents a JOIN skills s ON s.repo_id = a.repo_id AND list_contains(a.skills, s.name) WHERE a.is_sub_agent GROUP BY a.repo_id, a.ord)"""
_SUB_ROWS = f"""SELECT a.repo_id, a.ord, '.github/agents/' || {_sanitize("name")} || '.agent.md' AS path,
  {_head(_title("name"), "description", rules.EDITOR_TOOLS)} || 'Specialist for the ' || name || ' domain.' || {_NL} || {_NL}
  || description || {_NL} || {_NL} || '## Skills' || {_NL} || {_NL} || coalesce(skill_links, '{rules.DEFAULT_SKILLS}') || {_NL} || {_NL} || '## Commands' || {_NL} || {_NL}
  || CASE WHEN len(commands) > 0 THEN array_to_string(['- `' || c || '`' FOR c IN commands], {_NL}) ELSE '{rules.DEFAULT_SUB_COMMANDS}' END
  || {_NL} || {_NL} || '## Instructions' || {_NL} || {_NL} || CASE WHEN source_dir IS NOT NULL THEN 'Work in `' || source_dir || '/`.' || {_NL} ELSE '' END
  || {_lit(docs._SUB_GUIDE)} || {_NL} AS content FROM agents a LEFT JOIN sub_links l USING (repo_id, ord) WHERE is_sub_agent"""

_TESTING = f"""test_cmds AS (SELECT repo_id, 0 AS tier, ord, pos, 'Run tests: `' || command || '`' AS info FROM tools
  WHERE regexp_matches(lower(command), 'test|jest')),
test_rows AS (SELECT * FROM test_cmds UNION ALL
  SELECT p.repo_id, 1, ord, pos, pattern FROM (SELECT repo_id, ord, pos, pattern,
      row_number() OVER (PARTITION BY repo_id ORDER BY ord, pos) AS rn FROM patterns WHERE category = 'quality' OR contains(name, 'test')) p
  LEFT JOIN (SELECT repo_id, count(*) AS n FROM test_cmds GROUP BY repo_id) t USING (repo_id) WHERE rn + coalesce(n, 0) <= 8)"""
_CONVENTIONS = """conv AS (SELECT repo_id, pattern, row_number() OVER (PARTITION BY repo_id ORDER BY o, p) AS rank
  FROM (SELECT repo_id, pattern, min(ord) AS o, arg_min(pos, (ord, pos)) AS p FROM patterns GROUP BY repo_id, pattern))"""
_STRUCTURE = """layout AS (SELECT repo_id, source_dir, min(ord) AS ord, arg_min(description, ord) AS description FROM skills
  WHERE source_dir <> '' GROUP BY repo_id, source_dir)"""
_PATTERN_LANGUAGE = """plang AS (SELECT repo_id, arg_min(lang, (ord, pos)) AS language FROM (SELECT *, CASE
    WHEN regexp_matches(lower(pattern), 'typescript|\\.ts') THEN 'TypeScript' WHEN regexp_matches(lower(pattern), 'python|\\.py') THEN 'Python'
    WHEN regexp_matches(lower(pattern), 'javascript|\\.js') THEN 'JavaScript' WHEN regexp_matches(lower(pattern), 'golang|\\.go') THEN 'Go'
    WHEN regexp_matches(lower(pattern), 'rust|\\.rs') THEN 'Rust' END AS lang FROM patterns) WHERE lang IS NOT NULL GROUP BY repo_id)"""


def _section(title: str, column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '' ELSE '## {title}' || {_NL} || {_NL} || {column} || {_NL} || {_NL} END"


_INSTRUCTIONS = f"""{_CONVENTIONS}, {_STRUCTURE}, {_TESTING}, {_PATTERN_LANGUAGE},
c1 AS (SELECT repo_id, string_agg('- ' || pattern, {_NL} ORDER BY rank) AS c1 FROM conv WHERE rank <= 15 GROUP BY repo_id),
c2 AS (SELECT repo_id, string_agg('- `' || source_dir || '/` -- ' || description, {_NL} ORDER BY ord) AS c2 FROM layout GROUP BY repo_id),
c3 AS (SELECT repo_id, string_agg('- ' || info, {_NL} ORDER BY tier, ord, pos) AS c3 FROM test_rows GROUP BY repo_id),
c4 AS (SELECT repo_id, string_agg('- `' || command || '` -- ' || description, {_NL} ORDER BY ord, pos) AS c4 FROM dtools GROUP BY repo_id),
instr AS (SELECT s.repo_id, '<!-- {docs.MANAGED_TAG} -->' || {_NL} || '# About this code base' || {_NL} || {_NL}
  || CASE WHEN summary <> '' THEN summary || {_NL} || {_NL} ELSE '' END || '## Stack' || {_NL} || {_NL}
  || '- Language: ' || coalesce(s.language, plang.language, 'unknown') || {_NL} || '- Framework: ' || coalesce(framework, 'unknown') || {_NL} || {_NL}
  || {_section("Conventions in use", "c1")} || {_section("Layout", "c2")} || {_section("Tests", "c3")} || {_section("Commands and tools", "c4")}
  || '<!-- /{docs.MANAGED_TAG} -->' AS content
  FROM shape s LEFT JOIN c1 USING (repo_id) LEFT JOIN c2 USING (repo_id) LEFT JOIN c3 USING (repo_id) LEFT JOIN c4 USING (repo_id) LEFT JOIN plang USING (repo_id))"""

_HANDOFF_ROWS = f"""SELECT repo_id, '.github/copilot/handoffs.json' AS path, '{{' || {_NL} || '  "handoffs": [' || {_NL}
  || string_agg('    {{' || {_NL} || '      "from": "' || CASE WHEN coalesce(parent_agent, '') = '' THEN 'repo-root' ELSE parent_agent END
  || '",' || {_NL} || '      "to": "' || name || '",' || {_NL} || '      "triggers": [' || {_NL}
  || array_to_string(['        "' || t || '"' FOR t IN CASE WHEN len(triggers) = 0 THEN [name] ELSE triggers END], ',' || {_NL}) || {_NL} || '      ]' || {_NL} || '    }}',
  ',' || {_NL} ORDER BY ord) || {_NL} || '  ]' || {_NL} || '}}' || {_NL} AS content FROM agents WHERE is_sub_agent GROUP BY repo_id"""

_ALL = ("skills", "agents", "tools", "patterns", "brands", "hooks")

# of the rows with one path the last written stays: by section, then position; the root document stands where the last root agent does
_WRITTEN = f""", written AS (SELECT repo_id, path, 0 AS sec, ord, content FROM ({_SKILL_ROWS})
  UNION ALL SELECT repo_id, path, 1, 0, content FROM (WITH {_MAIN_D} {_main_rows("NOT multi")})
  UNION ALL SELECT repo_id, path, 1, last_root, content FROM (WITH {_ROOT_D} {_ROOT_ROWS})
    JOIN (SELECT repo_id, max(ord) AS last_root FROM agents WHERE NOT is_sub_agent GROUP BY repo_id) USING (repo_id)
  UNION ALL SELECT repo_id, path, 1, ord, content FROM ({_SUB_ROWS})
  UNION ALL SELECT repo_id, path, 2, 0, content FROM ({_HANDOFF_ROWS})
  UNION ALL SELECT repo_id, '.github/copilot-instructions.md', 3, 0, content FROM instr
  UNION ALL SELECT repo_id, path, 4, ord, content FROM ({_HOOK_ROWS}))
SELECT repo_id, path, md5(arg_max(content, (sec, ord))) AS content_md5 FROM written GROUP BY repo_id, path"""

SQL = {
    "text_scalars": f"""WITH x AS (SELECT 'p' || p_partkey AS id, p_brand || ' ' || replace(p_name, ' ', '-') AS s FROM part UNION ALL SELECT 'd' || doc_id, text FROM documents)
SELECT id, md5({_sanitize("s")}) AS sanitized, md5({_title("s")}) AS titled, md5({_quote("s")}) AS quoted FROM x""",
    "category_texts": with_views(f"SELECT repo_id, ord, {_CATEGORY} AS text FROM skills", "skills"),
    "skill_documents": with_views(_SKILL_ROWS, "skills"),
    "hook_documents": with_views(_HOOK_ROWS, "hooks"),
    "document_modes": with_views("WITH " + _LISTS + " SELECT repo_id, multi, has_root, root_description FROM shape", *_ALL),
    "main_agent_documents": with_views("WITH " + _LISTS + ", " + _MAIN_D + " " + _main_rows("true"), *_ALL),
    "root_agent_documents": with_views("WITH " + _LISTS + ", " + _ROOT_D + " " + _ROOT_ROWS, *_ALL),
    "sub_agent_documents": with_views("WITH " + _SUB_LINKS + " " + _SUB_ROWS, *_ALL),
    "instruction_documents": with_views("WITH " + _LISTS + ", " + _INSTRUCTIONS + " SELECT repo_id, content FROM instr", *_ALL),
    "conventions": with_views("WITH " + _CONVENTIONS + " SELECT repo_id, rank, pattern FROM conv WHERE rank <= 15", "patterns"),
    "text_conventions": """WITH l AS (SELECT source, doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT source, doc_id, i, ls[i] AS pattern FROM (SELECT *, unnest(generate_series(1, len(ls))) AS i FROM l)),
f AS (SELECT source, pattern, min((doc_id, i)) AS k FROM e GROUP BY source, pattern)
SELECT source AS repo_id, row_number() OVER (PARTITION BY source ORDER BY k) AS rank, pattern FROM f QUALIFY rank <= 15""",
    "distinct_tools": with_views("WITH " + _LISTS + " SELECT repo_id, command, ord, pos, description FROM dtools", *_ALL),
    "first_seen_orders": """SELECT l_returnflag || l_linestatus AS repo_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS command,
  min(l_orderkey * 8 + l_linenumber) AS position, arg_min(CAST(l_partkey AS VARCHAR), (l_orderkey * 8 + l_linenumber, CAST(l_partkey AS VARCHAR))) AS description
FROM lineitem GROUP BY ALL""",
    "structure": with_views("WITH " + _STRUCTURE + " SELECT * FROM layout", "skills"),
    "testing_info": with_views("WITH " + _TESTING + " SELECT * FROM test_rows", "tools", "patterns"),
    "pattern_language": with_views("WITH " + _PATTERN_LANGUAGE + " SELECT * FROM plang", "patterns"),
    "managed_merge": f"""WITH m AS (SELECT doc_id, '<!-- {docs.MANAGED_TAG} -->' || n_chars || '<!-- /{docs.MANAGED_TAG} -->' AS block, text FROM documents),
r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || block || text WHEN 1 THEN block || chr(10) || chr(10) || '<!-- {docs.MANAGED_TAG} -->' || text
  WHEN 2 THEN block || chr(10) || chr(10) || text ELSE block END AS content FROM m)
SELECT CAST(doc_id AS VARCHAR) AS repo_id, md5(content) AS content_md5, length(content) AS length FROM r""",
    "assets_upsert": f"""WITH m AS (SELECT source, doc_id, '<!-- {docs.MANAGED_TAG} -->' || n_chars || '<!-- /{docs.MANAGED_TAG} -->' AS block,
    '<!-- {docs.MANAGED_TAG} -->' AS s, '<!-- /{docs.MANAGED_TAG} -->' AS e, text FROM documents),
r AS (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 4 WHEN 0 THEN text || s || text || e || text WHEN 1 THEN s || text ELSE text END
    WHEN doc_id % 8 >= 4 THEN block
    ELSE CASE doc_id % 4 WHEN 0 THEN text || block || text WHEN 1 THEN block || chr(10) || chr(10) || s || text
      WHEN 2 THEN block || chr(10) || chr(10) || text ELSE block END END AS content FROM m WHERE doc_id % 3 > 0 OR doc_id % 4 < 3)
SELECT source AS repo_id, CASE WHEN doc_id % 8 < 4 THEN 'm/' ELSE 'w/' END || doc_id AS path, md5(content) AS content_md5 FROM r""",
    "run_summary": with_views("WITH " + _LISTS + """ SELECT s.repo_id, (SELECT count(*) FROM skills k WHERE k.repo_id = s.repo_id) AS n_skills,
  CASE WHEN multi THEN (SELECT count(*) FROM agents a WHERE a.repo_id = s.repo_id) ELSE 1 END AS n_agents,
  (SELECT count(*) FROM hooks h WHERE h.repo_id = s.repo_id) AS n_hooks FROM shape s""", *_ALL),
    "rendered_assets": with_views(
        "WITH " + _LISTS + ", " + _INSTRUCTIONS + ", " + _SUB_LINKS
        + _WRITTEN, *_ALL),
    "stored_assets": with_views(
        "WITH " + _LISTS + ", " + _INSTRUCTIONS + ", " + _SUB_LINKS
        + _WRITTEN.replace("AS content_md5", "AS content_md5, TRUE AS in_bucket"), *_ALL),
}

QUERIES = {
    f.__name__: f
    for f in (
        text_scalars, category_texts, skill_documents, hook_documents, document_modes, main_agent_documents,
        root_agent_documents, sub_agent_documents, instruction_documents, conventions, text_conventions, distinct_tools,
        first_seen_orders, structure, testing_info, pattern_language, managed_merge, run_summary, rendered_assets, stored_assets, assets_upsert,
    )
}
