"""Sources, prompt inputs and the registered queries."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from repoquarry.operators import profile
from repoquarry.plans import analyse, prompts
from repoquarry.plans.storage import StageStore
from repoquarry.sources import assets, exports, files
from workload import catalogue_queries, document_queries, file_queries, quality_queries, response_queries, session_queries, views


def test_metadata_and_tree(spark, tmp_path):
    (tmp_path / "meta.json").write_text(
        json.dumps({"owner": "o", "repo": "a", "default_branch": "main", "license": {"spdx_id": "MIT"}}) + "\n"
        + json.dumps({"owner": "o", "repo": "b", "default_branch": "dev", "license": None}))
    got = [tuple(r) for r in exports.read_metadata(spark, str(tmp_path / "meta.json")).orderBy("repo_id").collect()]
    assert got == [("o/a", "o", "a", "main", "MIT"), ("o/b", "o", "b", "dev", None)]
    (tmp_path / "tree.json").write_text(json.dumps({"repo_id": "o/a", "tree": [
        {"path": "src/index.ts", "type": "blob", "size": 100, "sha": "abc"}, {"path": "src", "type": "tree", "sha": "def"}, {"path": ".github", "type": "commit", "sha": "ghi"}]}))
    tree = [tuple(r) for r in exports.read_trees(spark, str(tmp_path / "tree.json")).orderBy("ord").collect()]
    assert tree == [("o/a", 0, "src/index.ts", "file", 100, "abc"), ("o/a", 1, "src", "dir", None, "def")]


def test_contents(spark):
    packed = base64.b64encode("Hello Wörld".encode()).decode()
    rows = [("a", "base64", packed[:6] + "\n" + packed[6:]), ("b", "utf-8", "raw text"), ("c", None, None), ("d", "base64", base64.b64encode(b"\xff a").decode())]
    df = spark.createDataFrame(rows, "k string, e string, c string")
    got = {r["k"]: r["t"] for r in df.select("k", exports.decode_content(F.col("e"), F.col("c")).alias("t")).collect()}
    assert got == {"a": "Hello Wörld", "b": "raw text", "c": "", "d": "� a"}


def test_scan_repositories(spark, tmp_path):
    for name, data in {"r1/src/a.py": b"print(1)", "r1/README.md": b"\xff!", "r2/lib/b.go": b"x"}.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    for root in (f"{tmp_path}/root", f"file:{tmp_path}//root/", f"file://{tmp_path}/root"):
        raw = files.scan_repositories(spark, root)
        got = sorted((r["repo_id"], r["path"], r["size"], r["content"]) for r in raw.collect())
        assert got == [("r1", "README.md", 2, "�!"), ("r1", "src/a.py", 8, "print(1)"), ("r2", "lib/b.go", 1, "x")]
    with pytest.raises(ValueError):
        files.scan_repositories(spark, "root")
    listing = files.inventory(files.scan_repositories(spark, str(tmp_path / "root"), with_content=False))
    assert sorted((r["path"], r["ext"], r["is_test"]) for r in listing.collect()) == [("README.md", ".md", False), ("lib/b.go", ".go", False), ("src/a.py", ".py", False)]


def test_prompts(make_files):
    listing = make_files({"r": [("package.json", 5, "{}"), ("api/a.ts", 6, "code-a"), ("tests/t.ts", 1, "hidden")] + [(f"api/{i}.ts", 20_000, "big") for i in range(6)]})
    (row,) = prompts.local_prompts(listing, listing, profile.repo_profile(listing)).collect()
    assert "TypeScript" in row["system"] and "Likely areas: api" in row["system"]
    assert "\n--- package.json ---\n{}\n" in row["prompt"] and "\n--- api/a.ts ---\ncode-a\n" in row["prompt"]
    assert "hidden" not in row["prompt"] and "big" not in row["prompt"] and "Config files: package.json" in row["prompt"]
    remote = make_files({"r": [("a.py", 6, "x" * 6000), ("b.py", 0, "")]}, "remote")
    (row,) = prompts.remote_prompts(remote, remote, profile.repo_profile(remote, "remote")).collect()
    assert "x" * 5000 in row["prompt"] and "x" * 5001 not in row["prompt"] and "--- b.py ---" not in row["prompt"]


def test_every_query_has_its_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {name for module in (file_queries, response_queries, catalogue_queries, document_queries, quality_queries, session_queries) for name in module.QUERIES} <= set(sql)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["source", "permissive", "blocked", "proprietary"] and df.count() > 0


@pytest.mark.parametrize("name", ["language_vote", "domain_boundaries", "agent_flatten", "registry_search_batch", "conventions", "session_assemble"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    rows = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    expected = sorted(str([row[names.index(c)] for c in columns]) for row in rows)
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == expected


def test_scans_agree_and_leave_out_what_cannot_be_read(spark, tmp_path):
    """Odd names are files like any other, `ord` follows the sorted paths for any split, gone files lose their row."""
    names = ["r1/__init__.py", "r1/.eslintrc.js", "r1/a b/é.py", "r1/a/_x.md", "r1/a-b.py", "r2/deep/er/and/deeper/f.go", "r2/gone.py", "r2/empty.txt", "beside.txt"]
    for name in names:
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("" if "empty" in name else name)
    (tmp_path / "root" / "r1" / "dangling").symlink_to(tmp_path / "nowhere")
    (tmp_path / "root" / "r3").mkdir()
    root = f"{tmp_path}/root"
    want = [("r1", i, p, len(f"r1/{p}".encode()), f"r1/{p}") for i, p in enumerate(sorted([".eslintrc.js", "__init__.py", "a b/é.py", "a/_x.md", "a-b.py"]))]
    want += [("r2", 0, "deep/er/and/deeper/f.go", 26, "r2/deep/er/and/deeper/f.go"), ("r2", 1, "empty.txt", 0, ""), ("r2", 2, "gone.py", 10, "r2/gone.py")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for split in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", split)
        try:
            assert sorted(map(tuple, files.scan_repositories(spark, root).collect())) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    scan = files.scan_repositories(spark, root)
    (tmp_path / "root" / "r2" / "gone.py").unlink()
    assert sorted(map(tuple, scan.collect())) == want[:-1]
    assert files.scan_repositories(spark, str(tmp_path / "root" / "r3")).collect() == []


def test_written_files_are_found(spark, tmp_path):
    rows = [("r", 0, "a/b.py", 1, "é"), ("r", 1, "c", 0, None)]
    made = spark.createDataFrame(rows, "repo_id string, ord bigint, path string, size bigint, content string")
    assert files.write_files(made, f"file:{tmp_path}/out") == 2
    got = sorted(map(tuple, files.scan_repositories(spark, f"file://{tmp_path}/out").collect()))
    assert got == [("r", 0, "a/b.py", 2, "é"), ("r", 1, "c", 0, "")]


def test_store_writes_a_stage_once_and_resumes(spark, tmp_path):
    with StageStore(spark, f"{tmp_path}/kept") as store:
        first = store.keep(spark.range(3), "numbers")
        assert sorted(r["id"] for r in store.keep(spark.range(9), "numbers").collect()) == [0, 1, 2] and first.count() == 3
        # one opened again on the folder reads what is whole and writes anew what broke off
        (tmp_path / "kept" / "broken").mkdir()
        (tmp_path / "kept" / "broken" / "part-0.parquet").write_text("cut")
        again = StageStore(spark, f"{tmp_path}/kept")
        assert again.has("numbers") and not again.has("broken") and not again.has("other")
        assert again.keep(spark.range(2), "broken").count() == 2
        again.discard("numbers")
        assert not store.has("numbers") and store.has("broken")
        for name in ("", "_hidden", "a/b"):
            with pytest.raises(ValueError):
                store.keep(spark.range(1), name)
    assert not (tmp_path / "kept").exists()


def test_analysis_is_written_once_and_leaves_nothing(spark, tmp_path):
    """All tables, the gate and the catalogue read the one copy of a run; resumed, it needs no session."""
    profile = views.part_profiles(spark, "/root/testdata/sf0.001")
    sessions = response_queries._sessions(spark, "/root/testdata/sf0.001")
    with StageStore(spark, f"{tmp_path}/run") as store:
        run = analyse.analyse_local(profile, sessions, store=store)
        counts = [t.count() for t in (run.repos, run.skills, run.agents, run.hooks, run.registry, run.assets())]
        assert os.listdir(tmp_path / "run") == ["routed-local"] and min(counts) > 0
        resumed = analyse.analyse_local(profile, sessions.where("false"), store=StageStore(spark, f"{tmp_path}/run"))
        assert [t.count() for t in (resumed.repos, resumed.skills, resumed.agents, resumed.hooks, resumed.registry)] == counts[:-1]
    assert os.listdir(tmp_path) == []


def _files_of(root):
    return {f"{folder}/{name}": os.stat(f"{folder}/{name}").st_mtime_ns for folder, _, names in os.walk(root) for name in names if name.endswith(".parquet")}


def test_upsert_rewrites_only_what_changes(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/stored"
    managed = assets.INSTRUCTIONS_PATH
    start, end = f"<!-- {assets.MANAGED_TAG} -->", f"<!-- /{assets.MANAGED_TAG} -->"

    def table(rows):
        return spark.createDataFrame(rows, assets.ASSETS_SCHEMA)

    def stored():
        return {(r["repo_id"], r["path"]): r["content"] for r in assets.read_assets(spark, root).collect()}

    first = [(f"r{i}", "a.md", f"text {i}") for i in range(40)] + [("r1", managed, "mine"), ("r2", "none.md", None)]
    assert len(assets.upsert_assets(table(first), root, buckets=8)) > 1
    assert stored() == {**{(r, p): c for r, p, c in first}, ("r1", managed): "mine"}
    before = _files_of(root)
    assert assets.upsert_assets(table([row for row in first if row[1] != managed]), root, buckets=8) == [] and _files_of(root) == before
    # one text changes, a block is spliced in, a row is new: two repositories, so two buckets at most
    block = f"{start}b{end}"
    second = [("r1", "a.md", "new"), ("r1", managed, block), ("r2", "b.md", "added"), ("r3", "a.md", "text 3"), ("r2", "none.md", None)]
    changed = assets.upsert_assets(table(second), root, buckets=8)
    want = {**{(r, p): c for r, p, c in first}, **{(r, p): c for r, p, c in second}, ("r1", managed): f"{block}\n\nmine"}
    assert stored() == want and 1 <= len(changed) <= 2
    after = _files_of(root)
    for name, written in before.items():
        bucket = int(name.split("bucket=")[1].split("/")[0])
        assert (after.get(name) == written) == (bucket not in changed)
    assert assets.upsert_assets(table(second), root, buckets=8) == [] and _files_of(root) == after
    # broken off while buckets are replaced: the next call finishes it first
    whole = assets._replace_buckets

    def broken(rows, path):
        raise OSError("executor lost")

    monkeypatch.setattr(assets, "_replace_buckets", broken)
    with pytest.raises(OSError):
        assets.upsert_assets(table([("r5", "a.md", "late")]), root, buckets=8)
    monkeypatch.setattr(assets, "_replace_buckets", whole)
    assert stored() == want
    assert assets.upsert_assets(table([("r6", "a.md", "text 6")]), root, buckets=8) == []
    assert stored() == {**want, ("r5", "a.md"): "late"} and not os.path.exists(f"{root}/_pending")
    assert assets.upsert_assets(table([]), root, buckets=8) == []
