"""Model responses: extraction, validation, tools, flattening, routing."""

import json
import time

import pytest
from pyspark.sql import functions as F

from repoquarry.functions import json_values as js
from repoquarry.operators import responses
from repoquarry.plans import analyse

AGENT = {"name": "a1"}
SKILL = {"name": "s1", "description": "Skill one"}


def _deep(levels):
    node = {"name": f"n{levels}"}
    for i in range(levels - 1, -1, -1):
        node = {"name": f"n{i}", "subAgents": [node]}
    return node


RESPONSES = {
    "plain": (json.dumps({"skills": [SKILL], "agents": [AGENT], "hooks": [], "summary": "A repo"}), True),
    "fenced": ('Sure:\n```json\n{"skills":[{"name":"embedded","description":"d"}]}\n```\n', True),
    "no_json": ("No JSON here at all", False),
    "invalid": ("{invalid json!!!}", False),
    "summary_only": ('{"summary":"test"}', True),
    "empty_skills": ('{"skills":[]}', True),
    "two_objects": ('{"a":1} and {"b":2}', False),
    "name_64": (json.dumps({"skills": [{**SKILL, "name": "x" * 64}]}), True),
    "name_65": (json.dumps({"skills": [{**SKILL, "name": "x" * 65}]}), False),
    "astral_33": (json.dumps({"skills": [{**SKILL, "name": "😀" * 33}]}, ensure_ascii=False), False),
    "category": (json.dumps({"skills": [{**SKILL, "category": "misc"}]}), False),
    "null_field": (json.dumps({"skills": [{**SKILL, "sourceDir": None}]}), False),
    "no_description": (json.dumps({"skills": [{"name": "s"}]}), False),
    "number_pattern": (json.dumps({"skills": [{**SKILL, "patterns": ["a", 1]}]}), False),
    "null_pattern": (json.dumps({"skills": [{**SKILL, "patterns": ["a", None]}]}), False),
    "skills_object": ('{"skills":{}}', False),
    "root_null_summary": ('{"summary":null}', False),
    "bad_nested": (json.dumps({"agents": [{"name": "r", "subAgents": [{"name": "c", "subAgents": [{"x": 1}]}]}]}), False),
    "nested_null": (json.dumps({"agents": [{"name": "r", "subAgents": [None]}]}), False),
    "tool_kinds": (json.dumps({"agents": [{"name": "r", "tools": ["npm test", {"name": "b"}]}]}), True),
    "empty_tool": (json.dumps({"agents": [{"name": "r", "tools": [""]}]}), False),
    "tool_number": (json.dumps({"agents": [{"name": "r", "tools": [1]}]}), False),
    "flag_text": (json.dumps({"agents": [{"name": "r", "isSubAgent": "yes"}]}), False),
    "hook": (json.dumps({"hooks": [{"name": "h", "event": "pre-push", "condition": "file:x"}]}), True),
    "hook_event": (json.dumps({"hooks": [{"name": "h"}]}), False),
    "extra_keys": (json.dumps({"skills": [{**SKILL, "extra": 1}], "other": 2}), True),
    "repeated": ('{"summary":"a","summary":"b"}', True),
    "nan": ('{"summary":NaN}', False),
    "deep": (json.dumps({"agents": [_deep(30)]}), True),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(repo, text) for repo, (text, _) in RESPONSES.items()]
    return responses.parse_responses(spark.createDataFrame(rows, "repo_id string, response string")).cache()


def test_validity(parsed):
    got = {r["repo_id"]: r["valid"] for r in parsed.select("repo_id", "valid").collect()}
    assert got == {repo: valid for repo, (_, valid) in RESPONSES.items()}


def test_violation_paths(parsed):
    found = {}
    for r in responses.response_findings(parsed).collect():
        found.setdefault(r["repo_id"], []).append(r["path"])
    assert found["category"] == ["skills.0.category"]
    assert found["no_json"] == found["two_objects"] == ["(json)"]
    assert "agents.0.subAgents.0.subAgents.0.name" in found["bad_nested"]


def test_typed_tables(parsed):
    skills = {r["repo_id"]: r for r in responses.response_skills(parsed).collect()}
    assert (skills["plain"]["category"], skills["plain"]["source_dir"], skills["plain"]["patterns"]) == ("patterns", "", [])
    assert skills["fenced"]["name"] == "embedded" and "category" not in skills
    summary = {r["repo_id"]: r["s"] for r in parsed.where("valid").select("repo_id", responses.response_summary(F.col("body")).alias("s")).collect()}
    assert summary["plain"] == "A repo" and summary["empty_skills"] == "" and summary["repeated"] == "b"


def test_any_depth_is_flattened(parsed):
    rows = responses.response_agents(parsed.where("repo_id = 'deep'")).orderBy("ord").collect()
    assert [r["name"] for r in rows] == [f"n{i}" for i in range(31)]
    assert [r["parent_agent"] for r in rows] == [None] + [f"n{i}" for i in range(30)]


def _flatten(spark, agents):
    df = spark.createDataFrame([("r", json.dumps(agents))], "repo_id string, j string").select("repo_id", F.parse_json("j").alias("agents"))
    return responses.flatten_agents(df).orderBy("ord").collect()


def test_flatten_agents(spark):
    child = {"name": "child", "description": "Child agent", "skills": [], "tools": [], "triggers": []}
    root, sub = _flatten(spark, [{"name": "root", "description": "Root", "subAgents": [child]}])
    assert (root["name"], root["sub_agents"], root["is_sub_agent"], root["parent_agent"]) == ("root", ["child"], False, None)
    assert (sub["name"], sub["is_sub_agent"], sub["parent_agent"], sub["sub_agents"]) == ("child", True, "root", None)
    assert _flatten(spark, []) == []
    mixed = _flatten(spark, [{"name": "root", "subAgents": ["string-ref", {"name": "object-child"}, {"no": "name"}, None, 7]}])
    assert [r["name"] for r in mixed] == ["root", "object-child"] and mixed[0]["sub_agents"] == ["string-ref", "object-child"]
    levels = _flatten(spark, [{"name": "root", "subAgents": [{"name": "level1", "subAgents": [{"name": "level2"}]}, {"name": "late"}]}, {"name": "second"}])
    assert [r["name"] for r in levels] == ["root", "level1", "level2", "late", "second"] and levels[2]["parent_agent"] == "level1"
    odd = _flatten(spark, [None, "not-an-object", 42, {"name": "valid", "description": "ok"}, {"description": "No name"}])
    assert [r["name"] for r in odd] == ["valid", "unknown"]
    loose = _flatten(spark, [{"name": 5, "isSubAgent": 1, "parentAgent": "", "skills": [1, True, None, [1, 2]], "triggers": "x", "sourceDir": 0}])
    assert (loose[0]["name"], loose[0]["is_sub_agent"], loose[0]["parent_agent"]) == ("5", True, None)
    assert (loose[0]["skills"], loose[0]["triggers"], loose[0]["source_dir"]) == (["1", "true", "null", "1,2"], [], None)


def test_normalize_tools(spark):
    cases = {
        "null": ("null", []), "empty": ("[]", []), "text": ('["npm install","npm test"]', [("npm", "npm install", "npm install"), ("npm", "npm test", "npm test")]),
        "full": ('[{"name":"build","command":"npm run build","description":"Build the project"}]', [("build", "npm run build", "Build the project")]),
        "partial": ('[{"name":"deploy"}]', [("deploy",) * 3]), "nameless": ('[{"command":"c"}]', [("unknown", "c", "")]),
        "number": ("[42, 1.0, 2.5]", [("unknown", "42", "42"), ("unknown", "1", "1"), ("unknown", "2.5", "2.5")]), "scalar": ('"x"', []),
        "mixed": ('["npm test",{"name":"lint","command":"eslint ."}]', [("npm", "npm test", "npm test"), ("lint", "eslint .", "lint")]),
    }
    df = spark.createDataFrame([(k, v) for k, (v, _) in cases.items()], "k string, j string")
    got = df.select("k", responses.normalize_tools(F.parse_json("j")).alias("t")).collect()
    assert {r["k"]: [tuple(t) for t in r["t"]] for r in got} == {k: e for k, (_, e) in cases.items()}


def test_strict_json(spark):
    texts = {"ok": '{"a":1}', "space": ' \n{"a":1}\t', "trailing": '{"a":1} x', "second": "1] [2", "pair": "1, 2", "repeated": '{"a":1,"a":2}',
             "empty": "", "bom": "﻿{}", "nan": "NaN", "single": "{'a':1}", "null": "null", "control": '"a\nb"', "comma": "[1,]"}
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {r["k"]: r["v"] for r in js.with_json(df, "t", "v").select("k", F.to_json("v").alias("v")).collect()}
    assert {k for k, v in got.items() if v is not None} == {"ok", "space", "repeated", "null"}
    assert got["repeated"] == '{"a":2}'


def test_routes_and_hooks(spark):
    profile = spark.createDataFrame(
        [(r, "Python", "Flask", True, False, ["src"], []) for r in ("good", "bad", "error", "none", "own_hooks")],
        "repo_id string, language string, framework string, has_tests boolean, has_root_package boolean, source_dirs array<string>, "
        "domains array<struct<name:string,path:string,file_count:bigint>>")
    good = json.dumps({"skills": [SKILL], "agents": [AGENT], "summary": "S"})
    own = json.dumps({"hooks": [{"name": "h", "event": "pre-push"}]})
    sessions = spark.createDataFrame([("good", "ok", good), ("bad", "ok", "oops"), ("error", "error", good), ("own_hooks", "ok", own)], "repo_id string, status string, text string")
    meta = spark.createDataFrame([(r, "o", r) for r in ("good", "bad", "error", "none", "own_hooks")], "repo_id string, owner string, repo string")
    local = analyse.analyse_local(profile, sessions)
    names = sorted((r["repo_id"], r["name"]) for r in local.agents.collect())
    assert names == [("bad", "root"), ("error", "root"), ("good", "a1"), ("none", "root")]
    hooks = {}
    for r in local.hooks.orderBy("repo_id", "ord").collect():
        hooks.setdefault(r["repo_id"], []).append(r["event"])
    assert hooks["own_hooks"] == ["pre-push"] and hooks["good"] == ["pre-commit", "pre-push", "post-generate"]
    remote = analyse.analyse_remote(profile, sessions, meta)
    assert sorted((r["repo_id"], r["name"]) for r in remote.agents.collect()) == [("error", "a1"), ("good", "a1"), ("none", "root")]
    assert {r["repo_id"]: r["summary"] for r in remote.repos.collect()} == {"good": "S", "error": "S", "bad": "", "own_hooks": "", "none": "A Python repository using Flask."}
    assert {r["event"] for r in remote.hooks.collect()} == {"pre-commit", "post-generate"}
    licences = spark.createDataFrame([("good", "MIT"), ("bad", None)], "repo_id string, license string")
    kept, blocked = analyse.gated(remote, licences)
    assert [r["repo_id"] for r in kept.repos.collect()] == ["good"] and blocked.count() == 1


def test_depth_of_lists(spark):
    texts = {"[]": 1, "{}": 1, "[[],[[]]]": 3, '["[[[["]': 1, '[{"a":"\\\\\\"[[","b":[1]}]': 2, '[{"subAgents":[{"subAgents":[]}]}]': 3, "null": 1}
    df = spark.createDataFrame(list(texts.items()), "t string, n int").select("t", "n", F.try_parse_json("t").alias("v"))
    assert [(r["t"], r["n"]) for r in df.where(responses._list_depth(F.col("v")) != F.col("n")).collect()] == []


def test_thousands_of_sub_agents_keep_their_order(spark):
    """Wide, with an empty list in every agent, beside a deep chain; the walk takes as many rounds as there are levels."""
    wide = [{"name": f"w{i}", "subAgents": []} for i in range(8000)]
    text = json.dumps({"agents": [{"name": "top", "subAgents": wide}, _deep(40)]})
    parsed = responses.parse_responses(spark.createDataFrame([("r", text)], "repo_id string, response string"))
    start = time.monotonic()
    got = [(r["name"], r["parent_agent"]) for r in responses.response_agents(parsed.where("valid")).orderBy("ord").collect()]
    spent = time.monotonic() - start
    assert [n for n, _ in got] == ["top", *[f"w{i}" for i in range(8000)], *[f"n{i}" for i in range(41)]]
    assert {p for n, p in got if n[0] == "w"} == {"top"} and got[-1][1] == "n39"
    assert spent < 15


def test_members_are_taken_out_once(spark):
    """The check reads the members of an object in one pass, and walks no more levels than there are lists of agents."""
    text = responses.violations("body")._jc.toString()
    assert text.count("variant_get") < 50 and text.count("schema_of_variant") < 30
    trees = ['[{"tools":[[[["x"]]]]}]', '[{"subAgents":[{"subAgents":["r"]}]},"\\"subAgents\\""]', "[]", json.dumps([{"subAgents": []}] * 9), '{"a":1}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(trees)], "i int, t string").select("i", F.parse_json("t").alias("v"))
    got = [r[0] for r in rows.orderBy("i").select(responses._level_limit(F.col("v"))).collect()]
    assert got[0] == 1 and got[1] >= 3 and got[2:] == [1, 2, 1]


def test_repositories_are_joined_in_small_parts(spark, tmp_path):
    """Tables with a row per repository grow with the input: none is broadcast, and no response text goes through a shuffle."""
    spark.range(60).selectExpr("concat('o/r', id) AS repo_id", "'Go' AS language", "'' AS framework", "false AS has_tests",
                               "array('src') AS source_dirs", "'o' AS owner", "concat('r', id) AS repo", "'MIT' AS license",
                               "'ok' AS status", "'{\"skills\":[{\"name\":\"a\",\"description\":\"d\"}]}' AS text").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    profile = table.select("repo_id", "language", "framework", "has_tests", "source_dirs")
    sessions = table.select("repo_id", "status", "text").where("repo_id <> 'o/r7'")
    run, _ = analyse.gated(analyse.analyse_remote(profile, sessions, table.select("repo_id", "owner", "repo")), table.select("repo_id", "license"))
    for part in (run.repos, run.skills, run.agents, run.hooks):
        assert "Broadcast" not in part._jdf.queryExecution().executedPlan().toString()
    assert run.repos.count() == 60 and sorted(r[0] for r in run.skills.select("name").collect()) == ["a"] * 59 + ["src-patterns"]
    plan = analyse.route(profile, sessions, "remote").drop("response", "violations")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sides = [i for i, line in enumerate(plan) if "RepartitionByExpression" in line]
    shuffled = plan[sides[0] + 1].split("[", 1)[1]
    assert shuffled.startswith("repo_id#") and "__answered#" in shuffled and ", response#" not in shuffled
