"""Queries over file listings: paths, licences, languages, directories, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from repoquarry.functions import licences as lic
from repoquarry.functions import paths, urls
from repoquarry.operators import defaults, licensing, profile, sampling
from repoquarry.plans import prompts
from repoquarry.plans.storage import working_dir
from repoquarry.sources import exports
from repoquarry.sources.files import scan_repositories, write_files
from workload import views
from workload.sql_views import with_views

_text_or_empty = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)


def license_classify(spark, sf_dir):
    docs = views.spread(views.table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = lic.classify_license(docs, "text")
    return found.select(
        "doc_id",
        F.col("license.detected").alias("detected"),
        F.coalesce("license.name", F.lit("")).alias("name"),
        F.coalesce("license.spdx_id", F.lit("")).alias("spdx_id"),
        F.col("license.permissive").alias("permissive"),
    )


def license_gate_by_source(spark, sf_dir):
    docs = views.spread(views.table(spark, sf_dir, "documents").select("source", "text"))
    found = lic.classify_license(docs, "text")
    permissive = lic.is_permissive(F.col("license.spdx_id"))
    return found.groupBy("source").agg(
        F.count_if(permissive).alias("permissive"),
        F.count_if(~permissive).alias("blocked"),
        F.count_if(F.col("license.name") == lic.PROPRIETARY).alias("proprietary"),
    )


def license_resolution(spark, sf_dir):
    got = licensing.resolve_license(views.manifest_files(spark, sf_dir))
    return got.select(
        "repo_id", "license.detected", F.coalesce("license.name", F.lit("")).alias("name"),
        F.coalesce("license.spdx_id", F.lit("")).alias("spdx_id"), "license.permissive",
        F.coalesce("license.file", F.lit("")).alias("file"),
    )


def license_blocked(spark, sf_dir):
    resolved = licensing.resolve_license(views.manifest_files(spark, sf_dir))
    return licensing.license_gate(resolved)[1]


def metadata_blocked(spark, sf_dir):
    ids = ["MIT", "apache-2.0", "SSPL-1.0", "", None, "gpl-3.0", "NOASSERTION"]
    orders = views.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("repo_id"),
        views.pick(ids, F.col("o_orderkey") % 7).alias("license"),
    )
    return licensing.metadata_gate(orders)[1]


def file_inventory(spark, sf_dir):
    path = F.col("path")
    return views.local_files(spark, sf_dir).select(
        "repo_id", "ord", "path", "ext", "is_test", "is_config", paths.depth(path).alias("depth"),
        F.coalesce(paths.first_segment(path), F.lit("")).alias("first_dir"),
        F.coalesce(paths.second_segment(path), F.lit("")).alias("second_dir"),
    )


def scanned_files(spark, sf_dir):
    """Every document written as a file of its repository, and what a scan of these folders finds."""
    root = working_dir(spark, "repositories")
    write_files(views.plain_files(spark, sf_dir), root)
    found = scan_repositories(spark, root)
    return found.select("repo_id", "ord", "path", "size", F.md5("content").alias("content_md5"))


def remote_inventory(spark, sf_dir):
    return views.remote_files(spark, sf_dir).select("repo_id", "ord", "path", "ext", "is_test", "is_config")


def content_truncation(spark, sf_dir):
    text = F.col("text")
    local, remote = paths.truncate_content(text, "local"), paths.truncate_content(text, "remote")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(local).alias("local_md5"), F.char_length(local).cast("long").alias("local_length"),
        F.md5(remote).alias("remote_md5"), F.char_length(remote).cast("long").alias("remote_length"),
    )


def content_decode(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    packed = F.when(F.col("doc_id") % 3 == 0, F.base64(F.encode("text", "UTF-8"))).when(F.col("doc_id") % 3 == 1, F.col("text"))
    encoding = F.when(F.col("doc_id") % 3 == 0, "base64").otherwise("utf-8")
    exported = docs.select("doc_id", packed.alias("content"), encoding.alias("encoding"))
    text = exports.decode_content(F.col("encoding"), F.col("content"))
    return exported.select("doc_id", F.md5(text).alias("text_md5"), F.char_length(text).cast("long").alias("n_chars"))


def git_tree(spark, sf_dir):
    """One exported tree per document: a blob, its directory and a submodule entry."""
    files = views.plain_files(spark, sf_dir)

    def item(path, kind, size):
        return F.struct(path.alias("path"), F.lit(kind).alias("type"), size.cast("bigint").alias("size"), F.md5(path).alias("sha"))

    items = F.array(
        item(F.col("path"), "blob", F.col("size")),
        item(F.substring_index("path", "/", 1), "tree", F.lit(None)),
        item(F.lit("vendor"), "commit", F.lit(None)),
    )
    trees = files.select(F.concat("repo_id", F.lit("/"), F.col("ord").cast("string")).alias("repo_id"), items.alias("tree"))
    got = exports.git_tree(trees)
    return got.select("repo_id", "ord", "path", "type", F.coalesce("size", F.lit(-1)).alias("size"), "sha")


def repo_metadata(spark, sf_dir):
    size = F.col("p_size")
    raw = views.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("owner"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("repo"),
        views.pick(["main", "master"], size % 2).alias("default_branch"),
        F.when(size % 3 > 0, F.struct(views.pick(["MIT", "GPL-3.0"], size % 2).alias("spdx_id"))).alias("license"),
    )
    return exports.repo_metadata(raw).select("repo_id", "owner", "repo", "default_branch", _text_or_empty("license"))


def language_vote(spark, sf_dir):
    return profile.detect_language(views.local_files(spark, sf_dir))


def language_vote_remote(spark, sf_dir):
    return profile.detect_language(views.remote_files(spark, sf_dir), "remote")


def framework_manifests(spark, sf_dir):
    return profile.detect_framework(views.local_files(spark, sf_dir)).select("repo_id", _text_or_empty("framework"))


def framework_paths(spark, sf_dir):
    return profile.detect_framework(views.remote_files(spark, sf_dir), "remote").select("repo_id", _text_or_empty("framework"))


def source_dirs(spark, sf_dir):
    got = profile.source_dirs(views.local_files(spark, sf_dir))
    return got.select("repo_id", F.col("pos").cast("long").alias("pos"), "dir")


def source_dirs_remote(spark, sf_dir):
    got = profile.source_dirs(views.remote_files(spark, sf_dir), "remote")
    return got.select("repo_id", F.col("pos").cast("long").alias("pos"), "dir")


def domain_boundaries(spark, sf_dir):
    return profile.domains(views.local_files(spark, sf_dir))


def sample_files(spark, sf_dir):
    got = sampling.sample_files(views.local_files(spark, sf_dir))
    return got.select("repo_id", "ord", "path", "size", F.col("rank").cast("long").alias("rank"))


def sample_contents(spark, sf_dir):
    files = views.local_files(spark, sf_dir)
    got = sampling.attach_content(sampling.sample_files(files), files)
    return got.select("repo_id", "path", F.md5("content").alias("content_md5"))


def priority_files(spark, sf_dir):
    got = sampling.priority_files(views.remote_files(spark, sf_dir))
    return got.select("repo_id", "ord", "path", F.col("rank").cast("long").alias("rank"))


def prompt_paths(spark, sf_dir):
    return sampling.first_paths(views.local_files(spark, sf_dir))


def prompts_local(spark, sf_dir):
    files = views.local_files(spark, sf_dir)
    got = prompts.local_prompts(files, files, profile.repo_profile(files))
    return got.select("repo_id", "system", F.md5("prompt").alias("prompt_md5"), F.char_length("prompt").cast("long").alias("prompt_length"))


def prompts_remote(spark, sf_dir):
    files = views.remote_files(spark, sf_dir)
    got = prompts.remote_prompts(files, files, profile.repo_profile(files, "remote"))
    return got.select("repo_id", "system", F.md5("prompt").alias("prompt_md5"), F.char_length("prompt").cast("long").alias("prompt_length"))


def default_skills(spark, sf_dir):
    got = defaults.default_skills(profile.source_dirs(views.local_files(spark, sf_dir)))
    return got.select("repo_id", "ord", "name", "description", "source_dir", F.array_join("triggers", ",").alias("triggers"), "category")


def _tool_rows(rows, tools):
    exploded = rows.select("repo_id", F.posexplode(tools).alias("pos", "t"))
    return exploded.select("repo_id", F.col("pos").cast("long").alias("pos"), "t.name", "t.command", "t.description")


def default_tools(spark, sf_dir):
    rows = views.part_profiles(spark, sf_dir)
    return _tool_rows(rows, defaults.default_tools(F.col("language"), F.col("has_root_package")))


def default_tools_remote(spark, sf_dir):
    return _tool_rows(views.part_profiles(spark, sf_dir), defaults.default_tools(F.col("language")))


def default_hooks(spark, sf_dir):
    rows = views.part_profiles(spark, sf_dir)
    hooks = defaults.default_hooks(F.col("language"), F.col("has_tests"))
    exploded = rows.select("repo_id", F.posexplode(hooks).alias("pos", "h"))
    return exploded.select(
        "repo_id", F.col("pos").cast("long").alias("pos"), "h.name", "h.event", "h.description",
        F.array_join("h.commands", "|").alias("commands"),
    )


def merged_profiles(spark, sf_dir):
    """Profiles from the states of two halves of the files, each of which cuts through the repositories."""
    files = views.local_files(spark, sf_dir)
    halves = [profile.repository_state(files.where(F.col("ord") % 2 == half)) for half in (0, 1)]
    return _profile_row(profile.profile_of_state(profile.merge_states(*halves)))


def repo_profiles(spark, sf_dir):
    return _profile_row(profile.repo_profile(views.local_files(spark, sf_dir)))


def _profile_row(got):
    return got.select(
        "repo_id", "language", _text_or_empty("framework"), "n_files", "has_tests", "has_root_package",
        F.array_join("source_dirs", ",").alias("source_dirs"),
        F.array_join(F.transform("domains", lambda d: F.concat(d["name"], F.lit(":"), d["file_count"].cast("string"))), ",").alias("domains"),
        defaults.summary_sentence("local").alias("summary"),
    )


def heuristic_agents(spark, sf_dir):
    got = defaults.local_agents(profile.repo_profile(views.local_files(spark, sf_dir)))
    return _agent_columns(got)


def heuristic_agents_remote(spark, sf_dir):
    rows = profile.repo_profile(views.remote_files(spark, sf_dir), "remote")
    named = rows.withColumn("owner", F.lit("own")).withColumn("repo", F.col("repo_id"))
    return _agent_columns(defaults.remote_agents(named))


def _agent_columns(agents):
    return agents.select(
        "repo_id", "ord", "name", "description", F.array_join("skills", ",").alias("skills"),
        F.array_join(F.transform("tools", lambda t: t["command"]), ",").alias("commands"), "is_sub_agent",
        _text_or_empty("parent_agent"), F.coalesce(F.array_join("sub_agents", ","), F.lit("(none)")).alias("sub_agents"),
        F.array_join("triggers", ",").alias("triggers"), _text_or_empty("source_dir"),
    )


def prefix_assign(spark, sf_dir):
    parts = views.table(spark, sf_dir, "part").select("p_partkey", F.lit("all").alias("repo_id"), F.col("p_brand").alias("source_dir"))
    known = parts.select("repo_id", F.col("source_dir").alias("prefix")).where(~F.col("prefix").endswith("5"))
    got = defaults.assign_by_prefix(parts, known, ["repo_id"], "source_dir", "prefix", "p_partkey")
    return got.select("p_partkey", "source_dir", _text_or_empty("prefix"))


def url_checks(spark, sf_dir):
    url = F.col("url")
    return views.repo_urls(spark, sf_dir).select(
        "page_id", urls.is_github_url(url).alias("is_hosted"), urls.normalize_github_url(url).alias("normal"),
        urls.repo_name(url).alias("repo_name"),
    )


def url_parts(spark, sf_dir):
    got = views.repo_urls(spark, sf_dir).select("page_id", urls.parse_github_url(F.col("url")).alias("p"))
    return got.select("page_id", F.coalesce("p.owner", F.lit("")).alias("owner"), F.coalesce("p.repo", F.lit("")).alias("repo"), "p.ok")


# ------------------------------------------------------------------ the same in SQL

_LICENSE_CASE = """CASE
  WHEN l LIKE '%mit license%' OR l LIKE '%mit-license%' THEN 'MIT'
  WHEN l LIKE '%apache license%' OR l LIKE '%apache-2.0%' OR l LIKE '%apache 2.0%' THEN 'Apache-2.0'
  WHEN l LIKE '%bsd 2-clause%' OR l LIKE '%bsd-2-clause%' OR l LIKE '%simplified bsd%' OR l LIKE '%freebsd license%' THEN 'BSD-2-Clause'
  WHEN l LIKE '%bsd 3-clause%' OR l LIKE '%bsd-3-clause%' OR l LIKE '%new bsd%' OR l LIKE '%modified bsd%' THEN 'BSD-3-Clause'
  WHEN l LIKE '%zero-clause bsd%' OR l LIKE '%0bsd%' THEN '0BSD'
  WHEN l LIKE '%gnu general public license v2%' OR l LIKE '%gpl-2.0%' OR l LIKE '%gplv2%' OR l LIKE '%gnu gpl v2%' THEN 'GPL-2.0'
  WHEN l LIKE '%gnu general public license v3%' OR l LIKE '%gpl-3.0%' OR l LIKE '%gplv3%' OR l LIKE '%gnu gpl v3%' THEN 'GPL-3.0'
  WHEN l LIKE '%gnu lesser general public license v2.1%' OR l LIKE '%lgpl-2.1%' OR l LIKE '%lgplv2.1%' THEN 'LGPL-2.1'
  WHEN l LIKE '%gnu lesser general public license v3%' OR l LIKE '%lgpl-3.0%' OR l LIKE '%lgplv3%' THEN 'LGPL-3.0'
  WHEN l LIKE '%gnu affero general public license%' OR l LIKE '%agpl-3.0%' OR l LIKE '%agplv3%' THEN 'AGPL-3.0'
  WHEN l LIKE '%isc license%' THEN 'ISC'
  WHEN l LIKE '%mozilla public license%' OR l LIKE '%mpl-2.0%' OR l LIKE '%mpl 2.0%' THEN 'MPL-2.0'
  WHEN l LIKE '%unlicense%' OR l LIKE '%this is free and unencumbered software%' THEN 'Unlicense'
  WHEN l LIKE '%cc0%' OR l LIKE '%creative commons zero%' THEN 'CC0-1.0'
  WHEN l LIKE '%wtfpl%' OR l LIKE '%do what the fuck you want%' THEN 'WTFPL'
  WHEN l LIKE '%zlib license%' THEN 'Zlib'
  WHEN l LIKE '%blue oak model license%' THEN 'BlueOak-1.0.0'
  WHEN (l LIKE '%all rights reserved%' OR l LIKE '%proprietary%' OR l LIKE '%confidential%'
        OR l LIKE '%not for redistribution%' OR l LIKE '%may not be copied%') AND l NOT LIKE '%mit%' THEN 'Proprietary'
  ELSE '' END"""

_SPDX = """('mit','apache-2.0','bsd-2-clause','bsd-3-clause','0bsd','gpl-2.0','gpl-3.0','lgpl-2.1','lgpl-3.0','agpl-3.0',
  'isc','mpl-2.0','unlicense','cc0-1.0','wtfpl','zlib','blueoak-1.0.0')"""

_RESOLVED = f"""WITH cand AS (
  SELECT repo_id, path, content, lower(content) AS l,
    list_position(['LICENSE','LICENSE.md','LICENSE.txt','LICENCE','LICENCE.md','LICENCE.txt','license','license.md',
                   'license.txt','COPYING','COPYING.md','COPYING.txt','package.json','pyproject.toml'], path) AS prio
  FROM manifest_files),
named AS (
  SELECT repo_id, path, prio, CASE
    WHEN prio <= 12 THEN CASE WHEN {_LICENSE_CASE} = '' THEN 'Unknown' ELSE {_LICENSE_CASE} END
    WHEN prio = 13 THEN CASE WHEN json_valid(content) THEN
         CASE WHEN json_type(content, '$.license') = 'VARCHAR' AND json_extract_string(content, '$.license') <> ''
              THEN json_extract_string(content, '$.license') END END
    WHEN prio = 14 AND regexp_matches(content, '(?i)license\\s*=\\s*["{{][^"}}]+["}}]')
      THEN trim(regexp_extract(content, '(?i)license\\s*=\\s*["{{]([^"}}]+)["}}]', 1)) END AS name
  FROM cand WHERE prio IS NOT NULL AND prio > 0),
best AS (SELECT repo_id, arg_min(name, prio) AS name, arg_min(path, prio) AS file FROM named WHERE name IS NOT NULL GROUP BY repo_id),
resolved AS (
  SELECT r.repo_id, b.name IS NOT NULL AS detected, coalesce(b.name, '') AS name,
    CASE WHEN b.name IN ('Unknown', 'Proprietary') THEN '' ELSE coalesce(b.name, '') END AS spdx_id,
    coalesce(lower(b.name) IN {_SPDX}, false) AS permissive, coalesce(b.file, '') AS file
  FROM (SELECT DISTINCT repo_id FROM manifest_files) r LEFT JOIN best b USING (repo_id))"""

_LANG = """(VALUES ('.ts','TypeScript',0),('.tsx','TypeScript',1),('.js','JavaScript',2),('.jsx','JavaScript',3),('.py','Python',4),
  ('.go','Go',5),('.rs','Rust',6),('.java','Java',7),('.cs','C#',8),('.rb','Ruby',9)"""


def _vote(view: str, extra: str, tie: str) -> str:
    return f"""WITH votes AS (
  SELECT repo_id, lang, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, {tie}) AS rn
  FROM {view} JOIN {_LANG}{extra}) m(e, lang, prio) ON ext = e GROUP BY repo_id, e, lang, prio)
SELECT r.repo_id, CASE WHEN v.lang = 'JavaScript' AND r.ts THEN 'TypeScript' ELSE coalesce(v.lang, 'Unknown') END AS language
FROM (SELECT repo_id, bool_or(contains(path, 'tsconfig')) AS ts FROM {view} GROUP BY repo_id) r
LEFT JOIN votes v ON v.repo_id = r.repo_id AND rn = 1"""


def _dep(name: str) -> str:
    key = f'"{name}"'
    return f"coalesce(json_extract_string(content, '$.devDependencies.{key}'), json_extract_string(content, '$.dependencies.{key}'), '') <> ''"


_FRAMEWORK = f"""WITH m AS (SELECT repo_id, path, CASE
  WHEN path = 'package.json' AND json_valid(content) THEN CASE
    WHEN {_dep('next')} THEN 'Next.js' WHEN {_dep('react')} THEN 'React' WHEN {_dep('vue')} THEN 'Vue'
    WHEN {_dep('@angular/core')} THEN 'Angular' WHEN {_dep('express')} THEN 'Express.js'
    WHEN {_dep('fastify')} THEN 'Fastify' WHEN {_dep('nestjs')} THEN 'NestJS' END
  WHEN path = 'requirements.txt' THEN CASE WHEN contains(content, 'django') THEN 'Django'
    WHEN contains(content, 'flask') THEN 'Flask' WHEN contains(content, 'fastapi') THEN 'FastAPI' END
  WHEN path = 'go.mod' THEN CASE WHEN contains(content, 'gin-gonic') THEN 'Gin'
    WHEN contains(content, 'echo') THEN 'Echo' WHEN contains(content, 'fiber') THEN 'Fiber' END END AS fw
  FROM local_files)
SELECT repo_id, coalesce(max(fw) FILTER (path = 'package.json'), max(fw) FILTER (path = 'requirements.txt'),
                         max(fw) FILTER (path = 'go.mod'), '') AS framework
FROM m GROUP BY repo_id"""

_DIRS = """WITH d AS (
  SELECT repo_id, string_split(path, '/')[1] AS dir, count(*) AS n, min(ord) AS first_ord
  FROM local_files WHERE NOT is_test AND NOT is_config AND contains(path, '/') GROUP BY ALL),
c AS (SELECT *, dir IN ('src','lib','app','pkg','internal','cmd') AS common, regexp_matches(dir, '^(0|[1-9][0-9]*)$') AS idx FROM d),
anyc AS (SELECT repo_id, bool_or(common) AS a FROM c GROUP BY repo_id),
ranked AS (
  SELECT repo_id, dir, row_number() OVER (PARTITION BY repo_id ORDER BY first_ord) - 1 AS pos FROM c WHERE common
  UNION ALL
  SELECT * FROM (
    SELECT c.repo_id, dir, row_number() OVER (PARTITION BY c.repo_id ORDER BY n DESC, NOT idx,
      CASE WHEN idx THEN CAST(dir AS BIGINT) ELSE first_ord END) - 1 AS pos
    FROM c JOIN anyc USING (repo_id) WHERE NOT a) WHERE pos < 3)"""

_DOMAINS = """domain_rows AS (
  SELECT repo_id, dir AS name, dir AS path, n AS file_count, first_ord FROM (
    SELECT repo_id, string_split(path, '/')[1] AS dir, count(*) AS n, min(ord) AS first_ord
    FROM {view} WHERE NOT is_test AND NOT is_config AND contains(path, '/') GROUP BY ALL)
  WHERE n > 5 AND lower(dir) IN ('api','auth','backend','frontend','core','common','shared','services','handlers','controllers',
    'models','views','routes','components','hooks','utils','lib','pkg','internal','cmd','client','server','admin','public','private','modules'))"""

_SAMPLES = """WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id
    ORDER BY is_config DESC, len(string_split(path, '/')), ord) AS rank FROM local_files WHERE NOT is_test)"""

_PRIORITY = """WITH hit AS (
  SELECT *, list_position(['package.json','tsconfig.json','pyproject.toml','setup.py','go.mod','Cargo.toml','README.md'],
                          string_split(path, '/')[-1]) AS slot FROM remote_files),
firsts AS (SELECT *, row_number() OVER (PARTITION BY repo_id, slot ORDER BY ord) AS rn FROM hit WHERE slot > 0),
known AS (SELECT repo_id, ord, path, size, 0 AS tier, slot AS place FROM firsts WHERE rn = 1 AND size < 50000),
src AS (SELECT repo_id, ord, path, size, 1 AS tier, len(string_split(path, '/')) AS place FROM hit h
  WHERE regexp_matches(path, '\\.(ts|js|py|go|rs|java)$') AND size < 50000
    AND NOT EXISTS (SELECT 1 FROM known k WHERE k.repo_id = h.repo_id AND k.path = h.path)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY tier, place, ord) AS rank
  FROM (SELECT * FROM known UNION ALL SELECT * FROM src))"""

_PROFILE_PARTS = """SELECT 'p' || p_partkey AS repo_id, (['TypeScript','Python','Go','Rust'])[p_size % 4 + 1] AS language,
  p_size % 2 = 0 AS has_tests, p_size % 5 = 0 AS has_root_package FROM part"""

_TOOL_TABLE = """(VALUES ('TypeScript',0,'install','npm install','Install dependencies'),('TypeScript',1,'build','npm run build','Build{p}'),
 ('TypeScript',2,'test','npm test','Run tests'){lint},
 ('Python',0,'install','pip install -e .','Install{d}'),('Python',1,'test','pytest','Run tests'){ruff},
 ('Go',0,'build','go build ./...','Build{p}'),('Go',1,'test','go test ./...','Run tests'){golint}) t(language, pos, name, command, description)"""
_CONFIG_TOOLS = _TOOL_TABLE.format(
    p=" the project", d=" dependencies", lint=",('TypeScript',3,'lint','npm run lint','Run linter')",
    ruff=",('Python',2,'lint','ruff check .','Run linter')", golint=",('Go',2,'lint','golangci-lint run','Run linter')",
)
_PLAIN_TOOLS = _TOOL_TABLE.format(p="", d="", lint="", ruff="", golint="")

_LOCAL_PROFILE = (
    _DIRS
    + ", " + _DOMAINS.format(view="local_files")
    + ", langs AS (" + _vote("local_files", ",('.php','PHP',10)", "prio") + ")"
    + ", fws AS (" + _FRAMEWORK + ")"
    + """, prof AS (
  SELECT r.*, l.language, f.framework, coalesce(sd.dirs, []) AS dirs, coalesce(dm.doms, []) AS doms, coalesce(dm.labels, '') AS labels
  FROM (SELECT repo_id, count(*) AS n_files, bool_or(is_test) AS has_tests, bool_or(path = 'package.json') AS has_root_package
        FROM local_files GROUP BY repo_id) r
  JOIN langs l USING (repo_id) JOIN fws f USING (repo_id)
  LEFT JOIN (SELECT repo_id, list(dir ORDER BY pos) AS dirs FROM ranked GROUP BY repo_id) sd USING (repo_id)
  LEFT JOIN (SELECT repo_id, list({'name': name, 'n': file_count} ORDER BY file_count DESC, first_ord) AS doms,
                    string_agg(name || ':' || file_count, ',' ORDER BY file_count DESC, first_ord) AS labels
             FROM domain_rows GROUP BY repo_id) dm USING (repo_id))"""
)

_AGENTS_LOCAL = _LOCAL_PROFILE + f"""
SELECT repo_id, 0 AS ord, 'root' AS name, 'Root agent for this ' || language || ' repository' AS description,
  array_to_string([d || '-patterns' FOR d IN dirs IF len([x FOR x IN doms IF starts_with(d, x.name)]) = 0], ',') AS skills,
  coalesce((SELECT string_agg(command, ',' ORDER BY pos) FROM {_CONFIG_TOOLS}
   WHERE t.language = replace(prof.language, 'JavaScript', 'TypeScript') AND (t.language <> 'TypeScript' OR has_root_package)), '') AS commands,
  false AS is_sub_agent, '' AS parent_agent, array_to_string([x.name FOR x IN doms], ',') AS sub_agents,
  lower(language) || ',main,primary' AS triggers, '' AS source_dir
FROM prof
UNION ALL
SELECT repo_id, i, doms[i].name, 'Agent for the ' || doms[i].name || ' domain (' || doms[i].n || ' files)',
  array_to_string([d || '-patterns' FOR d IN dirs IF d = doms[i].name OR starts_with(d, doms[i].name || '/')], ','),
  '', true, 'root', '(none)', lower(doms[i].name), doms[i].name
FROM (SELECT *, unnest(generate_series(1, len(doms))) AS i FROM prof)"""

_REMOTE_DIRS = """WITH d AS (SELECT repo_id, string_split(path, '/')[1] AS dir, min(ord) AS o FROM remote_files WHERE contains(path, '/') GROUP BY ALL),
dirs AS (SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY o) - 1 AS pos, dir FROM d WHERE dir IN ('src','lib','app','pkg','cmd'))"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NL = "chr(10)"
_SYSTEM = "'Describe this ' || language || ' repository as skills, agents with sub-agents, and tools. Reply in JSON only.'"
_LISTED = """listed AS (SELECT repo_id, string_agg(path, chr(10) ORDER BY ord) AS paths FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ord) AS rn FROM {view}) WHERE rn <= 100 GROUP BY repo_id)"""
_BLOCK = "chr(10) || '--- ' || path || ' ---' || chr(10) || {content} || chr(10)"
_PROMPTS_LOCAL = (
    _LOCAL_PROFILE
    + ", " + _LISTED.format(view="local_files")
    + ", ordered AS (" + _SAMPLES + " SELECT * FROM ranked WHERE rank <= 20 AND size <= 10000)"
    + f""", sampled AS (SELECT repo_id, string_agg({_BLOCK.format(content="left(content, 10000)")}, '' ORDER BY rank) AS samples FROM ordered GROUP BY repo_id),
configs AS (SELECT repo_id, string_agg(path, ', ' ORDER BY ord) AS config_files FROM local_files WHERE is_config GROUP BY repo_id),
made AS (SELECT repo_id, {_SYSTEM} || CASE WHEN len(doms) > 0 THEN chr(10) || 'Likely areas: ' || array_to_string([x.name FOR x IN doms], ', ') ELSE '' END AS system,
  'Language: ' || language || {_NL} || 'Framework: ' || CASE WHEN framework = '' THEN 'None' ELSE framework END || {_NL} || 'Source directories: '
  || array_to_string(dirs, ', ') || {_NL} || 'Config files: ' || coalesce(config_files, '') || {_NL} || {_NL} || 'Files (first 100):' || {_NL} || coalesce(paths, '')
  || {_NL} || {_NL} || 'Samples:' || {_NL} || coalesce(samples, '') || {_NL} || {_quoted(prompts.RESPONSE_FORMAT)} AS prompt
  FROM prof LEFT JOIN listed USING (repo_id) LEFT JOIN configs USING (repo_id) LEFT JOIN sampled USING (repo_id))
SELECT repo_id, system, md5(prompt) AS prompt_md5, length(prompt) AS prompt_length FROM made"""
)
_PROMPTS_REMOTE = (
    "WITH langs AS (" + _vote("remote_files", "", "min(ord)") + "), "
    + _LISTED.format(view="remote_files")
    + ", chosen AS (" + _PRIORITY + " SELECT r.*, f.content FROM ranked r JOIN remote_files f USING (repo_id, ord) WHERE rank <= 15)"
    + f""", sampled AS (SELECT repo_id, string_agg({_BLOCK.format(content="left(content, 5000)")}, '' ORDER BY rank) AS samples FROM chosen
  WHERE content <> '' GROUP BY repo_id),
fw AS (SELECT repo_id, CASE WHEN bool_or(path IN ('next.config.js', 'next.config.mjs')) THEN 'Next.js' WHEN bool_or(path = 'angular.json') THEN 'Angular'
  WHEN bool_or(path = 'vue.config.js') THEN 'Vue' WHEN bool_or(path IN ('nuxt.config.ts', 'nuxt.config.js')) THEN 'Nuxt' END AS framework FROM remote_files GROUP BY repo_id),
made AS (SELECT repo_id, {_SYSTEM} AS system, 'Language: ' || language || {_NL} || coalesce('Framework: ' || framework || {_NL}, '') || {_NL}
  || 'Files (first 100):' || {_NL} || coalesce(paths, '') || {_NL} || {_NL} || 'File contents:' || {_NL} || coalesce(samples, '') || {_NL}
  || {_quoted("Nest sub-agents as objects." + chr(10) + prompts.RESPONSE_FORMAT)} AS prompt
  FROM langs LEFT JOIN fw USING (repo_id) LEFT JOIN listed USING (repo_id) LEFT JOIN sampled USING (repo_id))
SELECT repo_id, system, md5(prompt) AS prompt_md5, length(prompt) AS prompt_length FROM made"""
)

SQL = {
    "prompts_local": with_views(_PROMPTS_LOCAL, "local_files"),
    "prompts_remote": with_views(_PROMPTS_REMOTE, "remote_files"),
    "license_classify": f"""SELECT doc_id, name <> '' AS detected, name,
  CASE WHEN name = 'Proprietary' THEN '' ELSE name END AS spdx_id, name NOT IN ('', 'Proprietary') AS permissive
FROM (SELECT doc_id, {_LICENSE_CASE} AS name FROM (SELECT doc_id, lower(text) AS l FROM documents))""",
    "license_gate_by_source": f"""SELECT source, count(*) FILTER (name NOT IN ('', 'Proprietary')) AS permissive,
  count(*) FILTER (name IN ('', 'Proprietary')) AS blocked, count(*) FILTER (name = 'Proprietary') AS proprietary
FROM (SELECT source, {_LICENSE_CASE} AS name FROM (SELECT source, lower(text) AS l FROM documents)) GROUP BY source""",
    "license_resolution": with_views(_RESOLVED + " SELECT * FROM resolved", "manifest_files"),
    "license_blocked": with_views(
        _RESOLVED + """ SELECT repo_id, CASE WHEN NOT detected THEN 'No license file found.'
  ELSE 'License "' || name || '" is not permissive.' END AS reason FROM resolved WHERE NOT permissive""", "manifest_files"),
    "metadata_blocked": """SELECT 'o/' || o_orderkey AS repo_id, CASE WHEN coalesce(lic, '') = '' THEN 'No license detected.'
  ELSE 'License "' || lic || '" is not permissive.' END AS reason
FROM (SELECT o_orderkey, (['MIT','apache-2.0','SSPL-1.0','',NULL,'gpl-3.0','NOASSERTION'])[o_orderkey % 7 + 1] AS lic FROM orders)
WHERE coalesce(lic, '') NOT IN ('MIT', 'apache-2.0', 'gpl-3.0')""",
    "file_inventory": with_views("""SELECT repo_id, ord, path, ext, is_test, is_config, len(string_split(path, '/')) AS depth,
  CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS first_dir,
  CASE WHEN len(string_split(path, '/')) > 2 THEN string_split(path, '/')[2] ELSE '' END AS second_dir FROM local_files""", "local_files"),
    "scanned_files": with_views("""SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY path) - 1 AS ord, path,
  CAST(octet_length(encode(coalesce(content, ''))) AS BIGINT) AS size, md5(coalesce(content, '')) AS content_md5 FROM plain_files""", "plain_files"),
    "remote_inventory": with_views("SELECT repo_id, ord, path, ext, is_test, is_config FROM remote_files", "remote_files"),
    "content_truncation": """SELECT doc_id, md5(left(text, 10000)) AS local_md5, length(left(text, 10000)) AS local_length,
  md5(left(text, 5000)) AS remote_md5, length(left(text, 5000)) AS remote_length FROM documents""",
    "content_decode": """SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN '' ELSE text END AS t FROM documents)""",
    "git_tree": with_views("""SELECT repo_id || '/' || ord AS repo_id, 0 AS ord, path, 'file' AS type, size, md5(path) AS sha FROM plain_files
UNION ALL SELECT repo_id || '/' || ord, 1, string_split(path, '/')[1], 'dir', -1, md5(string_split(path, '/')[1]) FROM plain_files""", "plain_files"),
    "repo_metadata": """SELECT p_brand || '/r' || p_partkey AS repo_id, p_brand AS owner, 'r' || p_partkey AS repo,
  (['main','master'])[p_size % 2 + 1] AS default_branch,
  CASE WHEN p_size % 3 > 0 THEN (['MIT','GPL-3.0'])[p_size % 2 + 1] ELSE '' END AS license FROM part""",
    "language_vote": with_views(_vote("local_files", ",('.php','PHP',10)", "prio"), "local_files"),
    "language_vote_remote": with_views(_vote("remote_files", "", "min(ord)"), "remote_files"),
    "framework_manifests": with_views(_FRAMEWORK, "local_files"),
    "framework_paths": with_views("""SELECT repo_id, CASE
  WHEN bool_or(path IN ('next.config.js', 'next.config.mjs')) THEN 'Next.js' WHEN bool_or(path = 'angular.json') THEN 'Angular'
  WHEN bool_or(path = 'vue.config.js') THEN 'Vue' WHEN bool_or(path IN ('nuxt.config.ts', 'nuxt.config.js')) THEN 'Nuxt' ELSE '' END AS framework
FROM remote_files GROUP BY repo_id""", "remote_files"),
    "source_dirs": with_views(_DIRS + " SELECT repo_id, pos, dir FROM ranked", "local_files"),
    "source_dirs_remote": with_views(_REMOTE_DIRS + " SELECT * FROM dirs", "remote_files"),
    "domain_boundaries": with_views("WITH " + _DOMAINS.format(view="local_files") + " SELECT * FROM domain_rows", "local_files"),
    "sample_files": with_views(_SAMPLES + " SELECT repo_id, ord, path, size, rank FROM ranked WHERE rank <= 20 AND size <= 10000", "local_files"),
    "sample_contents": with_views(_SAMPLES + " SELECT repo_id, path, md5(content) AS content_md5 FROM ranked WHERE rank <= 20 AND size <= 10000", "local_files"),
    "priority_files": with_views(_PRIORITY + " SELECT repo_id, ord, path, rank FROM ranked WHERE rank <= 15", "remote_files"),
    "prompt_paths": with_views("""SELECT repo_id, string_agg(path, chr(10) ORDER BY ord) AS paths
FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY ord) AS rn FROM local_files) WHERE rn <= 100 GROUP BY repo_id""", "local_files"),
    "default_skills": with_views(_DIRS + """ SELECT repo_id, pos AS ord, dir || '-patterns' AS name,
  'Patterns and conventions from the ' || dir || ' directory' AS description, dir AS source_dir, dir AS triggers, 'patterns' AS category FROM ranked""", "local_files"),
    "default_tools": f"""SELECT repo_id, pos, name, command, description FROM ({_PROFILE_PARTS}) p JOIN {_CONFIG_TOOLS}
  ON t.language = p.language AND (t.language <> 'TypeScript' OR has_root_package)""",
    "default_tools_remote": f"SELECT repo_id, pos, name, command, description FROM ({_PROFILE_PARTS}) p JOIN {_PLAIN_TOOLS} ON t.language = p.language",
    "default_hooks": f"""WITH p AS ({_PROFILE_PARTS}), h AS (
  SELECT repo_id, 0 AS k, 'pre-commit-quality' AS name, 'pre-commit' AS event,
    CASE WHEN language = 'TypeScript' THEN 'Run linting and type checking before commit' ELSE 'Run linting and formatting before commit' END AS description,
    CASE language WHEN 'TypeScript' THEN 'npm run lint|npm run build' WHEN 'Python' THEN 'ruff check .|ruff format --check .' ELSE 'go fmt ./...|golangci-lint run' END AS commands
  FROM p WHERE language <> 'Rust'
  UNION ALL SELECT repo_id, 1, 'pre-push-tests', 'pre-push', 'Run tests before pushing',
    CASE language WHEN 'TypeScript' THEN 'npm test' WHEN 'Python' THEN 'pytest' ELSE 'go test ./...' END FROM p WHERE language <> 'Rust' AND has_tests
  UNION ALL SELECT repo_id, 2, 'post-generate-validate', 'post-generate', 'Validate generated agent assets after generation', '{defaults.VALIDATE_COMMAND}' FROM p)
SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY k) - 1 AS pos, name, event, description, commands FROM h""",
    **dict.fromkeys(("repo_profiles", "merged_profiles"), with_views(_LOCAL_PROFILE + """ SELECT repo_id, language, framework, n_files, has_tests, has_root_package,
  array_to_string(dirs, ',') AS source_dirs, labels AS domains,
  'A ' || language || ' repository' || CASE WHEN framework <> '' THEN ' using ' || framework ELSE '' END || ' with ' || len(doms) || ' detected domains.' AS summary
FROM prof""", "local_files")),
    "heuristic_agents": with_views(_AGENTS_LOCAL, "local_files"),
    "heuristic_agents_remote": with_views(_REMOTE_DIRS + ", langs AS (" + _vote("remote_files", "", "min(ord)") + f""")
SELECT l.repo_id, 0 AS ord, 'root' AS name, 'Root agent for own/' || l.repo_id AS description,
  coalesce(s.skills, '') AS skills, coalesce((SELECT string_agg(command, ',' ORDER BY pos) FROM {_PLAIN_TOOLS}
    WHERE t.language = replace(l.language, 'JavaScript', 'TypeScript')), '') AS commands,
  false AS is_sub_agent, '' AS parent_agent, '' AS sub_agents, lower(l.language) AS triggers, '' AS source_dir
FROM langs l LEFT JOIN (SELECT repo_id, string_agg(dir || '-patterns', ',' ORDER BY pos) AS skills FROM dirs GROUP BY repo_id) s USING (repo_id)""", "remote_files"),
    "prefix_assign": """WITH k AS (SELECT DISTINCT p_brand AS prefix FROM part WHERE p_brand NOT LIKE '%5')
SELECT p_partkey, p_brand AS source_dir, prefix FROM part JOIN k ON starts_with(p_brand, prefix)
UNION ALL SELECT p_partkey, p_brand, '' FROM part WHERE NOT EXISTS (SELECT 1 FROM k WHERE starts_with(p_brand, prefix))""",
    "url_checks": with_views(r"""WITH n AS (SELECT page_id, url, regexp_matches(url, '^(https://github\.com/|git@github\.com:|github\.com/)') AS is_hosted,
  regexp_replace(regexp_replace(url, '^(git@github\.com:|github\.com/)', 'https://github.com/'), '\.git$', '') AS normal FROM repo_urls)
SELECT page_id, is_hosted, normal, CASE WHEN list_last(string_split(normal, '/')) = '' THEN 'repo' ELSE list_last(string_split(normal, '/')) END AS repo_name FROM n""", "repo_urls"),
    "url_parts": with_views(r"""SELECT page_id,
  CASE WHEN contains(url, 'github.com') THEN regexp_extract(url, 'github\.com[/:]([\w-]+)/([\w.-]+)', 1) WHEN contains(url, '/') THEN string_split(url, '/')[1] ELSE '' END AS owner,
  CASE WHEN contains(url, 'github.com') THEN regexp_replace(regexp_extract(url, 'github\.com[/:]([\w-]+)/([\w.-]+)', 2), '\.git$', '') WHEN contains(url, '/') THEN string_split(url, '/')[2] ELSE '' END AS repo,
  CASE WHEN contains(url, 'github.com') THEN regexp_matches(url, 'github\.com[/:]([\w-]+)/([\w.-]+)') ELSE contains(url, '/') END AS ok
FROM repo_urls""", "repo_urls"),
}

QUERIES = {
    f.__name__: f
    for f in (
        license_classify, license_gate_by_source, license_resolution, license_blocked, metadata_blocked,
        file_inventory, scanned_files, remote_inventory, content_truncation, content_decode, git_tree, repo_metadata,
        language_vote, language_vote_remote, framework_manifests, framework_paths, source_dirs, source_dirs_remote,
        domain_boundaries, sample_files, sample_contents, priority_files, prompt_paths, prompts_local, prompts_remote,
        default_skills, default_tools, default_tools_remote, default_hooks, repo_profiles, merged_profiles, heuristic_agents,
        heuristic_agents_remote, prefix_assign, url_checks, url_parts,
    )
}
