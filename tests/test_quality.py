"""Data-quality findings and roll-up."""

import pytest

from repoquarry.functions import front_matter as fm
from repoquarry.operators import quality

DOC = "---\nname: x\ndescription: d\n---\nbody"
FILES = {
    "sound": {".github/skills/a/SKILL.md": DOC, ".github/agents/a.agent.md": "---\nname: x\ndescription: d\ntools:\n  - a\n---\n",
              ".github/hooks/h.yaml": 'name: h\nevent: pre-commit\ncommands:\n  - "x"\n', "skills-registry.jsonl": '{"name":"a","type":"skill"}\n'},
    "skills": {".github/skills/plain/SKILL.md": "no fence", ".github/skills/open/SKILL.md": "---\nname: x\n", ".github/skills/nameless/SKILL.md": "---\ndescription: d\n---\n",
               ".github/skills/nodesc/SKILL.md": "---\nname: x\n---\n", ".github/skills/missing/other.md": "x", ".github/skills/blank/SKILL.md": "---\n\n---\n",
               ".github/skills/dash/SKILL.md": "---\nname: a---b\ndescription: d\n---\n"},
    "agents": {".github/agents/scalar.agent.md": "---\nname: x\ndescription: d\ntools: codebase\n---\n", ".github/agents/flow.agent.md": "---\nname: x\ndescription: d\ntools: ['a']\n---\n",
               ".github/agents/empty.agent.md": "---\nname: ''\ndescription: d\ntools:\n---\n", ".github/agents/skip.md": "x"},
    "no_agents": {".github/agents/bad.agent.md": "oops", ".github/skills/readme.md": "x"},
    "hooks": {".github/hooks/event.yml": "name: h\nevent: on-save\ncommands: [a]\n", ".github/hooks/none.yaml": "event: pre-push\ncommands: []\n", ".github/hooks/x.txt": "x",
              ".github/hooks/quoted.yaml": "name: \"h\" \nevent: 'post-commit' \ncommands:\n- a\n", ".github/hooks/scalar.yaml": "name: h\ncommands: x # c\n"},
    "registry": {"skills-registry.jsonl": '\n{"name":"a","type":"skill"}\n\nnot json\n{"name":"a"}\n{"name":"","type":"x"}\n[]\nnull\n{"name":0,"type":"t"}\n{"a":1} x\n'},
    "blank_registry": {"skills-registry.jsonl": " \n"},
}


@pytest.fixture(scope="module")
def findings(spark):
    rows = [(repo, path, text) for repo, files in FILES.items() for path, text in files.items()]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    return quality.validate_assets(files).cache()


@pytest.fixture(scope="module")
def by_area(findings):
    out = {}
    for r in findings.collect():
        out.setdefault((r["repo_id"], r["area"]), set()).add((r["severity"], r["message"]))
    return out


def test_sound_repository(by_area):
    assert not [key for key in by_area if key[0] == "sound"]


def test_skills(by_area):
    assert by_area["skills", "skills"] == {
        ("error", "plain/SKILL.md: Missing YAML frontmatter"), ("error", "open/SKILL.md: Malformed YAML frontmatter"),
        ("error", "nameless/SKILL.md: Missing 'name' in frontmatter"), ("warning", "nodesc/SKILL.md: Missing 'description' in frontmatter"),
        ("error", "missing: Missing SKILL.md file"), ("error", "blank/SKILL.md: Empty YAML frontmatter"),
        # the fence closes at the next three dashes anywhere, here inside the name
        ("warning", "dash/SKILL.md: Missing 'description' in frontmatter")}
    assert by_area["agents", "skills"] == {("warning", "No .github/skills/ directory found")}
    assert by_area["no_agents", "skills"] == {("warning", "No skills found in .github/skills/")}


def test_agents(by_area):
    assert by_area["agents", "agents"] == {("error", "scalar.agent.md: 'tools' must be an array"), ("error", "empty.agent.md: Missing 'name' in frontmatter")}
    assert by_area["no_agents", "agents"] == {("error", "bad.agent.md: Missing YAML frontmatter"), ("error", "No .agent.md files found in .github/agents/")}
    assert by_area["hooks", "agents"] == {("error", "No .github/agents/ directory found")}


def test_hooks(by_area):
    events = "pre-commit, post-commit, pre-push, pre-analyze, post-generate"
    assert by_area["hooks", "hooks"] == {
        ("error", f"hooks/event.yml: Invalid event 'on-save'. Must be one of: {events}"), ("error", "hooks/none.yaml: Missing 'name' field"),
        ("error", "hooks/none.yaml: Missing or empty 'commands' array"), ("error", "hooks/scalar.yaml: Missing 'event' field"),
        ("error", "hooks/scalar.yaml: Missing or empty 'commands' array")}


def test_registry(by_area):
    line = "skills-registry.jsonl line {}: {}".format
    assert by_area["registry", "registry"] == {("error", line(2, "Invalid JSON")), ("error", line(6, "Invalid JSON")), ("error", line(8, "Invalid JSON"))} | {
        ("error", line(n, "Missing 'name' or 'type'")) for n in (3, 4, 5, 7)}
    assert by_area["blank_registry", "registry"] == {("warning", "skills-registry.jsonl is empty")}
    assert by_area["hooks", "registry"] == {("warning", "No skills-registry.jsonl found")}


def test_rollup(spark, findings):
    repos = spark.createDataFrame([(r,) for r in FILES], "repo_id string")
    got = {r["repo_id"]: (r["errors"], r["warnings"], r["valid"]) for r in quality.rollup(findings, repos).collect()}
    assert got["sound"] == (0, 0, True) and got["hooks"] == (6, 2, False) and got["blank_registry"][2] is False


def test_flat_values(column_of):
    text = "a: plain # note\nb: \"q # x\"\nc:\nd: {x: 1}\ne:\n  - 1\nf:\n  k: v\ng: [ ]\nh: false\ni: 0\nj:x\nk: |\n  text\n"
    kinds = {key: column_of(lambda c, k=key: fm.value_kind(c, k), [text])[0] for key in "abcdefghijkz"}
    assert kinds == {"a": "SCALAR", "b": "SCALAR", "c": "NONE", "d": "MAP", "e": "ARRAY", "f": "MAP", "g": "EMPTY_ARRAY", "h": "NONE", "i": "NONE", "j": "NONE",
                     "k": "SCALAR", "z": "NONE"}
    assert column_of(lambda c: fm.scalar(c, "a"), [text]) == ["plain"] and column_of(lambda c: fm.scalar(c, "b"), [text]) == ["q # x"]


@pytest.mark.parametrize("listed", [None, ["sound", "hooks", "nothing at all"]])
def test_one_pass_equals_the_areas(spark, listed):
    """`validate_assets` gives the rows of the four functions together, also with null contents, and for other repositories."""
    rows = [(repo, path, text) for repo, files in FILES.items() for path, text in files.items()]
    rows += [("nulls", f".github/{path}", None) for path in ("skills/n/SKILL.md", "agents/n.agent.md", "hooks/n.yaml", "skills//x")] + [("nulls", "skills-registry.jsonl", None)]
    files = spark.createDataFrame(rows, "repo_id string, path string, content string")
    repos = files.select("repo_id").distinct() if listed is None else spark.createDataFrame([(r,) for r in listed], "repo_id string")
    want = quality.skill_findings(files, repos).unionByName(quality.agent_findings(files, repos)).unionByName(quality.hook_findings(files))
    want = want.unionByName(quality.registry_findings(files, repos))
    got = quality.validate_assets(files, None if listed is None else repos)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_files_no_findings(spark):
    files = spark.createDataFrame([], "repo_id string, path string, content string")
    assert quality.validate_assets(files).collect() == []
