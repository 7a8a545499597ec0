"""Language, framework, directories, domains, samples and the defaults derived from them."""

import pytest
from pyspark.sql import functions as F

from repoquarry.operators import defaults, profile, sampling


def _dict(df, key="repo_id"):
    rows = [r.asDict() for r in df.collect()]
    return {r[key]: tuple(v for k, v in r.items() if k != key) for r in rows}


def test_language_local(make_files):
    files = make_files({
        "ts": ["src/index.ts", "src/utils.ts", "src/main.ts"],
        "js": ["src/app.js", "src/utils.js", "src/main.js"],
        "override": ["src/app.js", "src/utils.js", "src/main.js", "tsconfig.json"],
        "py": ["app.py", "utils.py", "main.py"],
        "go": ["main.go", "server.go", "handler.go"],
        "none": ["data.csv", "readme.txt"],
        "unsummed": [f"{i}.ts" for i in range(3)] + [f"{i}.tsx" for i in range(3)] + [f"{i}.py" for i in range(4)],
        "tie": ["a.py", "b.ts"],
        "php": ["a.php"],
    })
    got = {k: v[0] for k, v in _dict(profile.detect_language(files)).items()}
    assert got == {"ts": "TypeScript", "js": "JavaScript", "override": "TypeScript", "py": "Python", "go": "Go", "none": "Unknown",
                   "unsummed": "Python", "tie": "TypeScript", "php": "PHP"}


def test_language_remote(make_files):
    files = make_files({"tie": ["a.py", "b.ts"], "php": ["a.php"], "bare": ["py"]}, "remote")
    got = {k: v[0] for k, v in _dict(profile.detect_language(files, "remote")).items()}
    assert got == {"tie": "Python", "php": "Unknown", "bare": "Python"}


def test_framework_from_manifests(make_files):
    def package(content):
        return [("package.json", 1, content)]

    files = make_files({
        "next": package('{"dependencies":{"next":"^14.0.0","react":"1"}}'),
        "react": package('{"dependencies":{"react":"^18"}}'),
        "dev": package('{"devDependencies":{"express":"4"}}'),
        "cleared": package('{"dependencies":{"next":"1","vue":"3"},"devDependencies":{"next":null}}'),
        "angular": package('{"dependencies":{"@angular/core":"1"}}'),
        "broken": [("package.json", 1, "{oops"), ("requirements.txt", 1, "Flask\nflask==1")],
        "case": [("requirements.txt", 1, "Django")],
        "pyproject": [("pyproject.toml", 1, "django")],
        "go": [("go.mod", 1, "require github.com/labstack/echo")],
        "nested": [("app/package.json", 1, '{"dependencies":{"next":"1"}}')],
        "none": ["src/main.ts"],
    })
    got = {k: v[0] for k, v in _dict(profile.detect_framework(files)).items()}
    assert got == {"next": "Next.js", "react": "React", "dev": "Express.js", "cleared": "Vue", "angular": "Angular", "broken": "Flask",
                   "case": None, "pyproject": None, "go": "Echo", "nested": None, "none": None}


def test_framework_from_paths(make_files):
    files = make_files({"n": ["angular.json", "next.config.mjs"], "v": ["vue.config.js"], "x": ["nuxt.config.js"], "o": ["sub/angular.json"]}, "remote")
    got = {k: v[0] for k, v in _dict(profile.detect_framework(files, "remote")).items()}
    assert got == {"n": "Next.js", "v": "Vue", "x": "Nuxt", "o": None}


def _dirs(df):
    out = {}
    for r in df.orderBy("repo_id", "pos").collect():
        out.setdefault(r["repo_id"], []).append(r["dir"])
    return out


def test_source_dirs(make_files):
    files = make_files({
        "common": ["lib/a.ts", "src/b.ts", "custom/c.ts", "src/d.ts"],
        "fallback": ["custom/a.ts", "custom/b.ts", "other/c.ts"],
        "top3": ["a/1", "b/1", "b/2", "c/1", "d/1", "d/2"],
        "index_keys": ["z/1", "10/1", "2/1", "y/1"],
        "tests_only": ["tests/a.ts", "package.json"],
        "internal": ["internal/x.go"],
    })
    assert _dirs(profile.source_dirs(files)) == {
        "common": ["lib", "src"], "fallback": ["custom", "other"], "top3": ["b", "d", "a"],
        "index_keys": ["2", "10", "z"], "internal": ["internal"],
    }
    assert _dirs(profile.source_dirs(files, "remote")) == {"common": ["lib", "src"]}


def test_domains(make_files):
    files = make_files({
        "few": ["api/a", "api/b"],
        "hit": [f"services/module{i}/index.ts" for i in range(10)],
        "tests": [f"api/test_{i}.ts" for i in range(10)],
        "order": [f"api/{i}" for i in range(8)] + [f"utils/{i}" for i in range(12)],
        "root": ["README.md"] + [f"custom-not-a-pattern/{i}" for i in range(10)],
        "five": [f"api/{i}" for i in range(5)],
        "six": [f"Api/{i}" for i in range(6)],
    })
    got = {}
    for r in profile.domains(files).orderBy("repo_id", F.desc("file_count"), "first_ord").collect():
        got.setdefault(r["repo_id"], []).append((r["name"], r["file_count"]))
    assert got == {"hit": [("services", 10)], "order": [("utils", 12), ("api", 8)], "six": [("Api", 6)]}
    windows = make_files({"w": [f"utils\\file{i}.ts" for i in range(10)]})
    assert [r["name"] for r in profile.domains(windows, "\\").collect()] == ["utils"]


def test_inventory_drops_unreadable_and_hidden(make_files):
    files = {"r": ["src/ok.ts", ("src/broken.ts", None), ".github/workflows/ci.yml", "a/.hidden"]}
    assert [r["path"] for r in make_files(files, include_dotfiles=False).collect()] == ["src/ok.ts"]
    assert make_files(files).count() == 3


def test_samples_cut_before_size(make_files):
    paths = [f"d/{i:02}.ts" for i in range(19)] + [("d/19.ts", 10_001), "d/20.ts"]
    files = make_files({"r": paths, "c": ["a/b/deep.ts", "top.ts", "x/package.json", "test_x.py"]})
    got = sampling.sample_files(files)
    assert got.where("repo_id = 'r'").count() == 19
    order = [r["path"] for r in got.where("repo_id = 'c'").orderBy("rank").collect()]
    assert order == ["x/package.json", "top.ts", "a/b/deep.ts"]


def test_priority_files(make_files):
    files = make_files({
        "r": [("a/package.json", 60_000), "b/package.json", "README.md", "setup.py", "x/y.ts", "main.go", "z.tsx", ("big.py", 50_000)],
        "many": [f"s/{i:02}.py" for i in range(20)] + ["go.mod"],
    }, "remote")
    got = sampling.priority_files(files)
    order = [r["path"] for r in got.where("repo_id = 'r'").orderBy("rank").collect()]
    assert order == ["setup.py", "README.md", "main.go", "x/y.ts"]
    many = [r["path"] for r in got.where("repo_id = 'many'").orderBy("rank").collect()]
    assert many == ["go.mod"] + [f"s/{i:02}.py" for i in range(14)]


def test_first_paths_keep_order(make_files):
    files = make_files({"r": [f"f{i}" for i in range(150)]})
    (row,) = sampling.first_paths(files).collect()
    assert row["paths"].split("\n") == [f"f{i}" for i in range(100)]


def test_default_tools_and_hooks(spark):
    rows = spark.createDataFrame(
        [("a", "TypeScript", True, True), ("b", "JavaScript", False, False), ("c", "Python", False, True), ("d", "Go", True, False), ("e", "Rust", True, True)],
        "repo_id string, language string, pkg boolean, tests boolean")
    lang = F.col("language")
    got = rows.select(
        "repo_id", F.transform(defaults.default_tools(lang, F.col("pkg")), lambda t: t["command"]).alias("config"),
        F.transform(defaults.default_tools(lang), lambda t: t["command"]).alias("plain"),
        F.transform(defaults.default_hooks(lang, F.col("tests")), lambda h: h["event"]).alias("events"),
    ).collect()
    found = {r["repo_id"]: (r["config"], r["plain"], r["events"]) for r in got}
    assert found["a"] == (["npm install", "npm run build", "npm test", "npm run lint"], ["npm install", "npm run build", "npm test"], ["pre-commit", "pre-push", "post-generate"])
    assert found["b"] == ([], ["npm install", "npm run build", "npm test"], ["pre-commit", "post-generate"])
    assert found["c"][0] == ["pip install -e .", "pytest", "ruff check ."] and found["c"][2] == ["pre-commit", "pre-push", "post-generate"]
    assert found["d"][1] == ["go build ./...", "go test ./..."]
    assert found["e"] == ([], [], ["post-generate"])


def test_heuristic_agents(make_files):
    files = make_files({"r": [f"client/{i}.py" for i in range(7)] + [f"clients/{i}.py" for i in range(9)] + ["web/a.py"]})
    agents = {r["name"]: r for r in defaults.local_agents(profile.repo_profile(files)).collect()}
    assert agents["client"]["skills"] == ["client-patterns"] and agents["client"]["parent_agent"] == "root"
    assert agents["client"]["description"] == "Agent for the client domain (7 files)"
    # the directory next to the domain belongs to neither agent
    assert agents["root"]["skills"] == ["web-patterns"] and agents["root"]["sub_agents"] == ["client"]
    assert agents["root"]["triggers"] == ["python", "main", "primary"]


def test_assign_by_prefix(spark):
    items = spark.createDataFrame([("r", "client/a", 0), ("r", "clients", 1), ("r", "client", 2), ("q", "client/a", 3), ("r", "", 4)], "repo_id string, dir string, ord bigint")
    known = spark.createDataFrame([("r", "client"), ("r", "cli")], "repo_id string, p string")
    loose = sorted((r["repo_id"], r["dir"], r["p"] or "") for r in defaults.assign_by_prefix(items, known, ["repo_id"], "dir", "p", "ord").collect())
    assert loose == [("q", "client/a", ""), ("r", "", ""), ("r", "client", "cli"), ("r", "client", "client"), ("r", "client/a", "cli"),
                     ("r", "client/a", "client"), ("r", "clients", "cli"), ("r", "clients", "client")]
    strict = sorted((r["repo_id"], r["dir"], r["p"] or "") for r in defaults.assign_by_prefix(items, known, ["repo_id"], "dir", "p", "ord", "/").collect())
    assert strict == [("q", "client/a", ""), ("r", "", ""), ("r", "client", "client"), ("r", "client/a", "client"), ("r", "clients", "")]


@pytest.mark.parametrize("mode", ["local", "remote"])
def test_merged_states_give_the_profile_of_all_files(make_files, mode):
    import random

    random.seed(5)
    names = ["src", "lib", "api", "auth", "7", "10", "07", "pkg", "docs", "web", "test", "Core"]
    repos = {
        f"r{i}": [random.choice(["", *[f"{name}/" for name in names]]) + f"{j}" + random.choice([".ts", ".py", ".js", ".go", ".txt", ".test.ts"]) for j in range(40)]
        for i in range(12)
    }
    for i in range(0, 12, 3):
        repos[f"r{i}"] += [("package.json", 1, '{"dependencies":{"vue":"3"}}'), ("go.mod", 1, "gin"), "vue.config.js", "tsconfig.json"]
    repos["many"] = [f"d{i}/x.py" for i in range(400)] + [f"d{i}/y.py" for i in range(390, 400)]
    files = make_files(repos, mode)
    whole = _dict(profile.repo_profile(files, mode))
    parts = [profile.repository_state(files.where(F.col("ord") % 3 == part), mode) for part in range(3)]
    assert _dict(profile.profile_of_state(profile.merge_states(*parts), mode)) == whole
    twice = profile.merge_states(profile.merge_states(parts[2], parts[0]), parts[1])
    assert _dict(profile.profile_of_state(twice, mode)) == whole
    # and the profile's lists are those of the single operators
    dirs, areas = {}, {}
    for row in profile.source_dirs(files, mode).orderBy("repo_id", "pos").collect():
        dirs.setdefault(row["repo_id"], []).append(row["dir"])
    for row in profile.domains(files).orderBy("repo_id", F.desc("file_count"), "first_ord").collect():
        areas.setdefault(row["repo_id"], []).append((row["name"], row["path"], row["file_count"]))
    for row in profile.repo_profile(files, mode).collect():
        assert row["source_dirs"] == dirs.get(row["repo_id"], [])
        assert [tuple(d) for d in row["domains"]] == areas.get(row["repo_id"], [])
    if mode == "local":
        assert dirs["many"] == ["d390", "d391", "d392"]
    assert _dict(profile.repo_profile(files.limit(0), mode)) == {}
