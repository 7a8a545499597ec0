"""The stored index of the catalogue answers as the search over the catalogue itself does."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from repoquarry.operators import catalogue, search_index

WORDS = ["auth", "author", "Auth-Core", "route", "tests", "é😀x", "db", "a", "blue green", "(x"]


@pytest.fixture(scope="module")
def registry(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        name = rng.choice(WORDS) + rng.choice(["", "-kit", str(i % 7)])
        agent = rng.random() < 0.3
        rows.append((
            f"r{i % 9}", i // 9 * 2, "agent" if agent else "skill", None if i % 97 == 0 else name, "f", None,
            rng.choice([None, "", "Handles " + rng.choice(WORDS), rng.choice(WORDS) * 40]), None if agent else rng.choice(["quality", "misc", None]),
            rng.choice([None, [], [rng.choice(WORDS)], [rng.choice(WORDS), None, rng.choice(WORDS)]]), None, None, rng.random() < 0.5 if agent else None,
        ))
    return spark.createDataFrame(rows, catalogue.REGISTRY_SCHEMA).cache()


@pytest.fixture(scope="module")
def queries(spark):
    texts = [*WORDS, "AUTH", "", "z", "zzz", "qual", "kit", "auth-core", "Handles a", "handles author", "misc", "AUTH", "th", "😀x"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string").cache()


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _write(registry, path, **options):
    """In two parts, by repository."""
    for part in (F.col("repo_id") < "r4", F.col("repo_id") >= "r4"):
        search_index.write_index(registry.where(part), path, **options)


@pytest.fixture(scope="module")
def index(spark, registry, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "x")
    _write(registry, path, buckets=16, block=4)
    return search_index.read_index(spark, path)


@pytest.mark.parametrize("k,type", [(3, None), (1000, None), (5, "agent"), (1, "skill")])
def test_index_answers_like_the_catalogue(registry, queries, index, k, type):
    got = _rows(search_index.search_indexed(index, queries, k, type, buckets=16))
    assert got == _rows(catalogue.search_batch(registry, queries, k, type))


def test_single_searches_agree(registry, queries, index):
    got = _rows(search_index.search_indexed(index, queries, 4, buckets=16))
    for query_id, query in [tuple(r) for r in queries.collect()][::5]:
        want = [(r["score"], r["repo_id"], r["ord"]) for r in catalogue.search(registry, query, limit=4).collect()]
        assert [row[2:] for row in got if row[0] == query_id] == want


def test_blocks_are_bounded_and_cover_every_entry(registry, index):
    entries, blocks = index
    assert entries.count() == registry.count()
    assert blocks.agg(F.max("n")).first()[0] <= 40 and blocks.where("n <> size(members)").count() == 0
    twice = blocks.select("gram", F.inline("members")).groupBy("gram", "repo_id", "ord").count().where("count > 1")
    assert twice.count() == 0
    # no entry scores more for a word than the bound of any of its grams says
    asked = blocks.select("gram", "bound", F.inline("members")).join(entries, ["repo_id", "ord"])
    words = asked.where("'auth' LIKE concat('%', gram, '%')").withColumn("score", catalogue.relevance(F.lit("auth")))
    assert words.count() > 0 and words.where("score > bound").count() == 0


def test_only_asked_folders_are_read(spark, index):
    one = spark.createDataFrame([(1, "auth")], "query_id int, query string")
    plan = search_index.search_indexed(index, one, 3, buckets=16)._jdf.queryExecution().executedPlan().toString()
    kept = re.findall(r"PartitionFilters: \[([^\]]*bucket[^\]]*)\]", plan)
    assert kept and all(len(re.findall(r"\d+", re.sub(r"#\d+", "", part))) <= 2 for part in kept)
    folders = {os.path.basename(os.path.dirname(name)) for name in index[1].inputFiles()}
    assert len(folders) > 2


def test_empty_index_and_no_queries(spark, registry, queries, index, tmp_path):
    search_index.write_index(registry.where("false"), f"{tmp_path}/none")
    assert _rows(search_index.search_indexed(search_index.read_index(spark, f"{tmp_path}/none"), queries, 3)) == []
    assert _rows(search_index.search_indexed(index, queries.where("false"), 3, buckets=16)) == []
    assert _rows(search_index.search_indexed(index, queries, 0, buckets=16)) == []


def test_entries_of_one_file_are_dealt_before_their_grams_are_listed(spark, registry, tmp_path, monkeypatch):
    """The n-grams of an entry are many times its size: one file of entries must not be listed in one task."""
    registry.coalesce(1).write.parquet(str(tmp_path / "entries"))
    seen, plain = [], search_index.spread_join
    monkeypatch.setattr(search_index, "spread_join", lambda big, *rest, **options: seen.append(big) or plain(big, *rest, **options))
    search_index.write_index(spark.read.parquet(str(tmp_path / "entries")), str(tmp_path / "index"))
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    listed, read = plan.index("Generate explode(gram_list"), plan.index("FileScan")
    assert "Exchange hashpartitioning(repo_id" in plan[listed:read]
