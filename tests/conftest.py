import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files per repository from `{repo: [path or (path, size) or (path, size, content)]}`."""
    from repoquarry.sources.files import inventory

    def build(repos, mode="local", include_dotfiles=True):
        rows = []
        for repo, files in repos.items():
            for position, item in enumerate(files):
                path, size, content = (item + (100, None)[len(item) - 1 :]) if isinstance(item, tuple) else (item, 100, None)
                rows.append((repo, position, path, size, content))
        raw = spark.createDataFrame(rows, "repo_id string, ord bigint, path string, size bigint, content string")
        return inventory(raw, mode, include_dotfiles)

    return build


@pytest.fixture(scope="session")
def column_of(spark):
    """Evaluate a `Column -> Column` function over Python values."""
    from pyspark.sql import functions as F

    def evaluate(function, values, type_="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
        return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]

    return evaluate
