"""Registry build, scan, search and batch search."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from repoquarry.operators import catalogue
from repoquarry.sources import registry_files

ROWS = [
    ("r", 0, "skill", "auth-patterns", "f", None, "Authentication patterns for the project", "security", ["auth", "login"], None, None, None),
    ("r", 1, "agent", "backend", "f", "f", "Backend domain agent for API services", None, ["backend", "api"], None, None, False),
    ("r", 2, "agent", "auth", "f", "f", "Auth sub-agent", None, ["auth"], "backend", None, True),
]


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(ROWS, catalogue.REGISTRY_SCHEMA).cache()


def _names(df):
    return [r["name"] for r in df.collect()]


def test_search_scores(registry):
    got = [(r["name"], r["score"]) for r in catalogue.search(registry, "auth").collect()]
    assert got == [("auth", 240), ("auth-patterns", 140), ("backend", 5)]
    assert _names(catalogue.search(registry, "AUTH-patterns"))[0] == "auth-patterns"
    assert _names(catalogue.search(registry, "API services"))[0] == "backend"
    assert _names(catalogue.search(registry, "login"))[0] == "auth-patterns"
    assert _names(catalogue.search(registry, "auth", type="skill")) == ["auth-patterns"]
    assert len(_names(catalogue.search(registry, "auth", limit=1))) == 1
    assert _names(catalogue.search(registry, "nonexistent-xyz")) == ["backend"]
    assert _names(catalogue.search(registry, "nonexistent-xyz", require_match=True)) == []
    assert _names(catalogue.search(registry, "nonexistent-xyz", type="skill")) == []
    assert len(_names(catalogue.search(registry, ""))) == 3
    assert _names(catalogue.search(registry, "auth", limit=0)) == []
    with pytest.raises(ValueError):
        catalogue.search(registry, "auth", limit=-1)


def test_list_and_get(registry):
    assert _names(catalogue.list_entries(registry)) == ["auth-patterns", "backend", "auth"]
    assert _names(catalogue.get_entry(registry, "auth")) == ["auth"]
    assert _names(catalogue.get_entry(registry, "Auth")) == []


def test_batch_equals_single(spark):
    rng = random.Random(7)
    words = ["auth", "api", "log", "db", "ui", "go", "test"]
    rows = []
    for i in range(120):
        kind = rng.choice(["skill", "agent"])
        name = "-".join(rng.sample(words, 2))
        rows.append((f"r{i % 5}", i, kind, name, "f", None, f"About {rng.choice(words)} and {rng.choice([*words, '日本語😀'])}", rng.choice(["security", None]),
                     rng.sample(words, rng.randint(0, 3)), None, None, rng.choice([True, False, None]) if kind == "agent" else None))
    registry = spark.createDataFrame(rows, catalogue.REGISTRY_SCHEMA).cache()
    texts = ["auth", "API", "g", "", "zzz", "db-ui", "About log", "curity", "o", "日本語"]
    queries = spark.createDataFrame(list(enumerate(texts)) + [(99, "auth")], "query_id bigint, query string")
    for k, type_ in ((7, None), (3, "agent"), (0, None)):
        batch = {}
        for r in catalogue.search_batch(registry, queries, k, type_, salts=3).orderBy("query_id", "rank").collect():
            batch.setdefault(r["query_id"], []).append((r["score"], r["repo_id"], r["ord"]))
        for i, text in [*enumerate(texts), (99, "auth")]:
            single = [(r["score"], r["repo_id"], r["ord"]) for r in catalogue.search(registry, text, type_, k).collect()]
            assert batch.get(i, []) == single, (k, type_, text)


def test_build_and_lines(spark, tmp_path):
    skills = spark.createDataFrame([("2024", 0, "s", "d", "patterns", ["t"])], "repo_id string, ord bigint, name string, description string, category string, triggers array<string>")
    agents = spark.createDataFrame([("2024", 0, "a", "d", ["t"], None, ["x"], False)],
                                   "repo_id string, ord bigint, name string, description string, triggers array<string>, parent_agent string, sub_agents array<string>, is_sub_agent boolean")
    built = catalogue.build_registry(skills, agents)
    lines = [r["l"] for r in built.orderBy("ord").select(registry_files.registry_line().alias("l")).collect()]
    assert lines == [
        '{"type":"skill","name":"s","file":".github/skills/s/SKILL.md","description":"d","category":"patterns","triggers":["t"]}',
        '{"type":"agent","name":"a","file":".github/agents/a.agent.md","vsCodeAgent":".github/agents/a.agent.md","description":"d","triggers":["t"],"isSubAgent":false,"subAgents":["x"]}',
    ]
    path = str(tmp_path / "registry")
    registry_files.write_registry(built, path)
    entries, bad = registry_files.parse_registry(registry_files.read_registry(spark, path))
    assert sorted(_names(entries)) == ["a", "s"] and bad.count() == 0
    assert {(r["repo_id"], r["ord"], r["name"]) for r in entries.collect()} == {(r["repo_id"], r["ord"], r["name"]) for r in built.collect()}
    registry_files.write_registry(built.limit(0), path + "-empty")
    assert registry_files.read_registry(spark, path + "-empty").count() == 0
    assert _names(catalogue.build_registry(skills)) == ["s"]


def test_bad_lines(spark):
    files = spark.createDataFrame([("good", '{"name":"a","type":"skill"}\n\n  \n{"name":"b","type":"skill"}\n'), ("bad", '{"name":"c","type":"skill"}\n{oops\n'), ("blank", " \n")],
                                  "repo_id string, content string")
    lines = registry_files.registry_lines(files)
    entries, bad = registry_files.parse_registry(lines)
    assert sorted(_names(entries)) == ["a", "b", "c"]
    assert [(r["repo_id"], r["line"]) for r in bad.collect()] == [("bad", "{oops")]
    strict, _ = registry_files.parse_registry(lines, strict=True)
    assert sorted(_names(strict)) == ["a", "b"]


def test_batch_meets_on_the_rarest_gram(spark):
    """Queries that share their first letters with every entry are compared with few of them."""
    n = 2000
    rows = [("r", i, "skill", f"agent-{i:07d}", "f", None, "", None, [], None, None, None) for i in range(n)]
    registry = spark.createDataFrame(rows, catalogue.REGISTRY_SCHEMA)
    queries = spark.range(n).selectExpr("id AS query_id", "concat('agent-', lpad(id, 7, '0'), ' zq') AS query")
    assert catalogue.search_batch(registry, queries, 3).count() == 0
    exact = spark.createDataFrame([(1, "agent-0001999")], "query_id bigint, query string")
    assert [r["ord"] for r in catalogue.search_batch(registry, exact, 3).collect()] == [1999]
