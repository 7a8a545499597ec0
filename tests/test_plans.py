"""Physical plans: no cross joins, few shuffles, limits before shuffles, pruned scans."""

import pytest

import __spark_entry__ as entry
from repoquarry.functions.licences import classify_license
from repoquarry.operators import profile, sampling
from repoquarry.sources.files import FILES_SCHEMA

SF_DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_files(spark, make_files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files") / "files")
    make_files({f"r{i}": ["src/a.ts", ("package.json", 5, "{}"), "lib/b.py"] for i in range(20)}).write.parquet(path)
    return spark.read.schema(FILES_SCHEMA).parquet(path)


# every registered query with a join in it, but for those that run a job while they are built
JOINING = """license_resolution framework_manifests sample_contents prompts_local prompts_remote
prefix_assign response_routing registry_scan_strict registry_search_batch root_agent_documents
sub_agent_documents instruction_documents rendered_assets managed_merge testing_info run_summary registry_findings_large
validate_rollup session_assemble session_assemble_local session_timeouts""".split()


@pytest.mark.parametrize("name", JOINING)
def test_joins_have_keys(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_DIR))
    assert "Join" in plan and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_language_is_one_shuffle_of_metadata(stored_files):
    plan = _plan(profile.detect_language(stored_files))
    assert plan.count("Exchange") == 1 and "partial_" in plan
    assert "content" not in plan


def test_manifest_filter_reaches_the_scan(stored_files):
    plan = _plan(profile._manifest_framework(stored_files))
    assert "PushedFilters: [In(path, [go.mod,package.json,requirements.txt])]" in plan


def test_ranking_reads_no_content(stored_files):
    plan = _plan(sampling.sample_files(stored_files))
    assert "content" not in plan and plan.count("WindowGroupLimit") >= 4
    assert "EqualTo(is_test,true)" in plan.split("PushedFilters")[1]


def test_classification_needs_no_shuffle(stored_files):
    plan = _plan(classify_license(stored_files))
    assert "Exchange" not in plan and "Join" not in plan


def test_validation_is_one_pass(spark, tmp_path):
    """One scan for findings about files, one for what is absent, two of the registry's lines; no anti join."""
    from repoquarry.operators import quality

    spark.createDataFrame([("r", ".github/skills/a/SKILL.md", "x")], "repo_id string, path string, content string").write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    plan = _plan(quality.validate_assets(files))
    scans, exchanges = plan.count("FileScan"), len([line for line in plan.splitlines() if "Exchange" in line and "Reused" not in line])
    # the absent parts share one aggregation, which the adaptive plan reuses when it runs
    assert scans <= 5 and exchanges <= 8 and "LeftAnti" not in plan


def test_rendering_reads_each_input_a_few_times(spark, tmp_path):
    """Lists come from one long table of lines: three shuffles, whatever the number of lists."""
    from repoquarry.operators import documents
    from workload import views

    tables = []
    for view in (views.brands, views.skills, views.agents, views.hooks):
        view(spark, SF_DIR).write.parquet(str(tmp_path / view.__name__))
        tables.append(spark.read.parquet(str(tmp_path / view.__name__)))
    plan = _plan(documents.render_assets(*tables))
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Reused" not in line]
    assert plan.count("FileScan") <= 9 and len(exchanges) <= 12
    blocks = _plan(documents.instruction_blocks(documents.repo_shape(tables[0], tables[2]), tables[1], tables[2]))
    assert blocks.count("FileScan") <= 4 and "Window" not in blocks


def test_profile_reads_metadata_once(stored_files):
    """One pass over metadata, one over root manifests; three shuffles, no join."""
    plan = _plan(profile.repo_profile(stored_files))
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 3 and "Join" not in plan
    assert len([line for line in plan.splitlines() if "FileScan" in line and "content" in line.split("ReadSchema")[-1]]) == 1
