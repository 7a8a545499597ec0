"""The views of `views.py` as SQL common table expressions for the DuckDB check."""

from __future__ import annotations

_PATH_FLAGS = r"""
    CASE WHEN regexp_matches(lower(path), '(\.test\.|\.spec\.|_test\.|test_)')
           OR regexp_matches(lower(path), '^(tests|test|__tests__)/') THEN true ELSE false END AS is_test,
    CASE WHEN regexp_matches(path, '(package\.json|tsconfig\.json|pyproject\.toml|setup\.py|go\.mod|Cargo\.toml|Dockerfile)')
           OR regexp_matches(regexp_extract(path, '[^/]*$'), '.eslintrc.*|.prettierrc.*|docker-compose.*.yml')
         THEN true ELSE false END AS is_config"""

VIEWS = {
    "plain_files": """
  SELECT source AS repo_id, doc_id AS ord,
         (['src','lib','api','tests','docs','node_modules'])[(doc_id // 20) % 6 + 1] || '/f' || doc_id
         || (['.ts','.tsx','.js','.py','.go','.md','.test.ts'])[doc_id % 7 + 1] AS path,
         n_chars AS size, text AS content
  FROM documents""",
    "manifest_files": """
  SELECT 'r' || g AS repo_id, doc_id AS ord,
    CASE s
      WHEN 0 THEN (['LICENSE','LICENSE.md','COPYING','license.txt','docs/LICENSE'])[g % 5 + 1]
      WHEN 1 THEN (['app/package.json','package.json','package.json'])[g % 3 + 1]
      WHEN 2 THEN (['pyproject.toml','pyproject.toml','setup.cfg'])[g % 3 + 1]
      WHEN 3 THEN (['requirements.txt','requirements.txt','src/app.py','main.py'])[g % 4 + 1]
      WHEN 4 THEN (['go.mod','cmd/main.go'])[g % 2 + 1]
      WHEN 5 THEN (['tsconfig.json','next.config.js','angular.json','vue.config.js','nuxt.config.ts','.eslintrc.js'])[g % 6 + 1]
      WHEN 6 THEN (['src','web','2024','client'])[g % 4 + 1] || '/index' || (['.js','.ts','.py','.go','.php'])[g % 5 + 1]
      WHEN 7 THEN (['packages/a/node_modules/x.js','yarn.lock','latest_news.js','Dockerfile'])[g % 4 + 1]
      WHEN 8 THEN (['clients','client','web','lib'])[g % 4 + 1] || '/u' || doc_id || (['.js','.py','.rs'])[g % 3 + 1]
      ELSE (['README.md','docs/README.md','docker-compose.dev.yml','pkg/a/b.go'])[g % 4 + 1]
    END AS path,
    n_chars AS size,
    CASE s
      WHEN 1 THEN '{"name":"p","license":' || (['"MIT"','"SSPL-1.0"','{"type":"MIT"}','""','"apache-2.0"'])[g % 5 + 1]
        || ',"dependencies":{"' || deps[g % 9 + 1] || '":"^1.0"},"devDependencies":{"' || deps[(g * 7 + 5) % 9 + 1]
        || '":"' || (['^2.0',''])[g % 2 + 1] || '"}' || (['}','}','}','','} x'])[(doc_id // 30) % 5 + 1]
      WHEN 2 THEN (['license = "Apache-2.0"','license = {text = "MIT"}','LICENSE="  Weird  "','name = ''x'''])[g % 4 + 1] || chr(10) || text
      WHEN 3 THEN (['django==4','flask','fastapi','numpy'])[(doc_id // 40) % 4 + 1] || chr(10) || text
      WHEN 4 THEN (['gin-gonic/gin','labstack/echo','gofiber/fiber','plain'])[(doc_id // 20) % 4 + 1] || chr(10) || text
      ELSE text
    END AS content
  FROM (SELECT *, doc_id // 10 AS g, doc_id % 10 AS s,
               ['next','react','vue','@angular/core','express','fastify','nestjs','left-pad','lodash'] AS deps
        FROM documents)""",
    "tree": "\n  SELECT * FROM plain_files UNION ALL SELECT * FROM manifest_files",
    "local_files": rf"""
  SELECT *, regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]*)$', 1) AS ext, {_PATH_FLAGS}
  FROM tree
  WHERE NOT regexp_matches(path, '(^|/)(node_modules|\.git|dist|build|\.next|coverage|__pycache__|\.venv|venv)/')
    AND NOT regexp_matches(path, '(^|/)(\.env|[^/]*\.lock|package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$')
    AND NOT regexp_matches(path, '(^|/)\.')""",
    "remote_files": rf"""
  SELECT *, '.' || list_last(string_split(path, '.')) AS ext, {_PATH_FLAGS}
  FROM tree
  WHERE NOT regexp_matches(path, '^(node_modules|\.git|dist|build|\.next|coverage|__pycache__|\.venv|venv)/')
    AND NOT regexp_matches(path, '(\.lock|package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$')""",
    "repo_urls": """
  SELECT page_id, CASE page_id % 6
      WHEN 0 THEN 'https://github.com/' || owner || '/r' || page_id || '.x'
      WHEN 1 THEN 'git@github.com:' || owner || '/r' || page_id || '.x.git'
      WHEN 2 THEN 'github.com/' || owner || '/r' || page_id || '.x.git'
      WHEN 3 THEN url
      WHEN 4 THEN owner || '/r' || page_id || '.x'
      ELSE 'https://github.com/' || owner || '/' END AS url
  FROM (SELECT page_id, url, replace(regexp_extract(url, '://([^/]+)', 1), '.', '-') AS owner FROM pages)""",
    "skills": """
  SELECT p_brand AS repo_id, p_partkey AS ord, replace(p_name, ' ', '-') AS name,
         p_name || ' for ' || lower(p_type) || CASE WHEN p_size % 5 = 0 THEN ': #' || p_size ELSE '' END AS description,
         CASE WHEN p_size % 4 = 0 THEN '' ELSE words[1] END AS source_dir,
         CASE WHEN p_size % 3 = 0 THEN [] ELSE [lower(p_type) || ' ' || p_size, words[2] || (['.py','.ts','',' in Rust'])[p_size % 4 + 1]] END AS patterns,
         CASE WHEN p_size % 7 = 0 THEN [] ELSE words END AS triggers,
         (['architecture','reliability','quality','security','patterns','misc'])[p_size % 6 + 1] AS category,
         CASE WHEN p_size % 2 = 0 THEN [] ELSE ['use ' || p_name] END AS examples
  FROM (SELECT *, string_split(p_name, ' ') AS words FROM part)""",
    "agents": """
  SELECT 'Brand#' || b AS repo_id, s_suppkey AS ord, 'agent-' || s_suppkey AS name,
         CASE WHEN n % 7 = 0 THEN '' ELSE 'Handles nation ' || n END AS description,
         [adj[n % 8 + 1] || '-' || thing[s_suppkey % 8 + 1], adj[(n + 3) % 8 + 1] || '-' || thing[(s_suppkey + 1) % 8 + 1],
          adj[n % 8 + 1] || '-' || thing[s_suppkey % 8 + 1]] AS skills,
         CASE WHEN n % 3 = 0 THEN [] ELSE [cmd[n % 5 + 1], cmd[(n + s_suppkey) % 5 + 1]] END AS commands,
         'step ' || s_suppkey AS step,
         b % 5 <> 0 AND n % 4 <> 0 AS is_sub_agent,
         CASE WHEN n % 4 = 1 THEN '' WHEN n % 4 = 2 THEN NULL ELSE 'root' END AS parent_agent,
         CASE WHEN n % 5 = 0 THEN ['agent-' || (s_suppkey + 25)] END AS sub_agents,
         CASE WHEN n % 2 = 0 THEN [] ELSE ['n' || n, 'all'] END AS triggers,
         CASE WHEN n % 3 = 1 THEN 'src/n' || n END AS source_dir
  FROM (SELECT *, s_suppkey % 25 + 1 AS b, s_nationkey AS n,
               ['red','blue','hot','cold','old','new','small','large'] AS adj,
               ['bolt','plate','ring','gear','widget','rod','anvil','gizmo'] AS thing,
               ['npm test','make build','Pytest -q','go vet ./...','npm run lint'] AS cmd
        FROM supplier)""",
    "hooks": """
  SELECT 'Brand#' || (c_custkey % 25 + 1) AS repo_id, c_custkey AS ord, 'hook-' || c_custkey AS name,
         (['pre-commit','post-commit','pre-push','pre-analyze','post-generate'])[c_custkey % 5 + 1] AS event,
         'For ' || lower(c_mktsegment) AS description, ['run ' || c_custkey, 'check'] AS commands,
         CASE WHEN c_custkey % 3 = 0 THEN 'file:' || lower(c_mktsegment) END AS condition
  FROM customer""",
    "brands": """
  SELECT repo_id, 'My ' || repo_id AS repo_name, CASE WHEN k % 3 = 0 THEN '' ELSE 'Repository ' || repo_id END AS summary,
         CASE WHEN k % 2 = 0 THEN 'Go' END AS language, CASE WHEN k % 4 = 0 THEN 'Gin' END AS framework
  FROM (SELECT DISTINCT p_brand AS repo_id, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS k FROM part)""",
    "tools": """
  SELECT repo_id, ord, idx - 1 AS pos, commands[idx] AS command, step AS description
  FROM (SELECT repo_id, ord, commands, step, unnest(generate_series(1, len(commands))) AS idx FROM agents)""",
    "patterns": """
  SELECT repo_id, ord, idx - 1 AS pos, patterns[idx] AS pattern, name, category
  FROM (SELECT *, unnest(generate_series(1, len(patterns))) AS idx FROM skills)""",
    "responses": """
  SELECT 'p' || p_partkey AS repo_id, p_partkey, p_name, p_type, p_brand, p_size,
    CASE WHEN p_size % 11 = 0 THEN '{"a":1} and {"b":2}'
         WHEN p_size % 13 = 0 THEN 'no json at all'
         ELSE 'Here it is:' || chr(10) || '{"summary":"first","skills":[{"name":"' || p_name || '","description":"' || p_type
           || '","category":"' || (['architecture','quality','misc','patterns'])[p_size % 4 + 1] || '","patterns":["a","' || p_partkey || '"]}'
           || CASE WHEN p_size % 5 = 0 THEN ',{"name":"extra","description":"' || p_partkey || '"}' ELSE '' END
           || '],"agents":[{"name":"lead' || p_partkey || '","tools":["npm test",{"name":"build"}],"subAgents":["ref",{"name":"' || p_brand
           || '","skills":["s"],"subAgents":[{"name":"leaf","tools":["x y"]}]}]},{"name":"other","isSubAgent":true,"parentAgent":"lead' || p_partkey || '"}]'
           || CASE WHEN p_size % 3 = 0 THEN ',"hooks":[{"name":"h' || p_partkey || '","event":"pre-push","commands":["go"]}]' ELSE '' END
           || CASE WHEN p_size % 2 = 0 THEN ',"summary":"Part ' || p_partkey || '"' ELSE '' END || '}' || chr(10) || 'Done.'
    END AS response,
    p_size % 11 <> 0 AND p_size % 13 <> 0 AND p_size % 4 <> 2 AS valid
  FROM part""",
    "asset_files": """
  SELECT 'q' || (doc_id // 12) AS repo_id, doc_id, doc_id % 4 AS kind, (doc_id // 20) % 5 AS variant, (doc_id // 20) % 3 AS hook_variant,
    (['.github/skills/s','.github/agents/a','.github/hooks/h','.github/skills/t'])[doc_id % 4 + 1] || doc_id
      || (['/SKILL.md','.agent.md','.yaml','/notes.md'])[doc_id % 4 + 1] AS path,
    CASE WHEN doc_id % 4 = 2 THEN
      CASE (doc_id // 20) % 3
        WHEN 0 THEN 'name: h' || doc_id || chr(10) || 'event: pre-push' || chr(10) || 'commands:' || chr(10) || '  - "x"' || chr(10)
        WHEN 1 THEN 'name: h' || doc_id || chr(10) || 'event: on-save' || chr(10) || 'commands: []' || chr(10)
        ELSE 'event: ''pre-commit''' || chr(10) || 'commands: [a, b]' || chr(10) END
    ELSE CASE (doc_id // 20) % 5
        WHEN 0 THEN '---' || chr(10) || 'name: n' || doc_id || chr(10) || 'description: d' || chr(10) || 'tools: [''a'', ''b'']' || chr(10) || '---' || chr(10) || text
        WHEN 1 THEN '---' || chr(10) || 'name: n' || doc_id || chr(10) || '---' || chr(10) || text
        WHEN 2 THEN '---' || chr(10) || 'description: ''d''' || chr(10) || 'tools: codebase' || chr(10) || '---' || chr(10) || text
        WHEN 3 THEN 'no front matter' || chr(10) || replace(text, '---', '')
        ELSE '---' || chr(10) || 'name: n' || chr(10) || replace(text, '---', '') END
    END AS content
  FROM documents""",
    "catalogue_lines": """
  SELECT 'u' || (event_id // 3) AS repo_id, event_id AS ord, event_id % 9 AS way, event_type, user_id,
    CASE event_id % 9
      WHEN 4 THEN '' WHEN 5 THEN props || ' x'
      WHEN 6 THEN '{"type":"","name":"' || event_type || '"}' WHEN 7 THEN props
      ELSE '{"type":"skill","name":"' || event_type || '","description":"' || user_id || '","triggers":["t"],"props":' || props || '}'
    END AS line
  FROM events""",
    "session_events": """
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq, conv_id * 60 + turn * 30 AS secs, type,
         CASE WHEN type = 'assistant.message' THEN CASE WHEN conv_id % 2 = 0 THEN '' ELSE text END END AS content,
         CASE WHEN type = 'assistant.message_delta' THEN text END AS delta
  FROM (SELECT *, CASE WHEN turn < 2 OR role = 'system' THEN 'assistant.message_delta'
                       WHEN (conv_id + turn * 3) % 7 = 3 THEN 'error'
                       WHEN (conv_id + turn * 3) % 7 = 5 THEN 'session.idle'
                       WHEN (conv_id + turn * 3) % 7 = 6 THEN 'assistant.message'
                       ELSE 'assistant.message_delta' END AS type FROM conversations)""",
    "timed_events": """
  SELECT * FROM (SELECT *, min(secs) OVER (PARTITION BY session_id) AS started FROM session_events) WHERE secs < started + 120""",
}

# views another view reads
_NEEDS = {
    "tree": ("plain_files", "manifest_files"),
    "local_files": ("tree",),
    "remote_files": ("tree",),
    "tools": ("agents",),
    "patterns": ("skills",),
    "timed_events": ("session_events",),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the named views and whatever they need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    sql = sql.strip()
    more = ", " + sql[len("WITH ") :] if sql.startswith("WITH ") else "\n" + sql
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name]}\n)" for name in ordered) + more
