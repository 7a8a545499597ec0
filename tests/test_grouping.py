"""The grouped operators against plain computations, with one key holding most rows."""

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from repoquarry.operators import grouping


@pytest.fixture(scope="module")
def skewed(spark):
    ids = spark.range(20_000)
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return ids.select(key.alias("k"), F.col("id").alias("pos"), F.pmod(F.hash("id"), F.lit(1000)).alias("v")).cache()


def _groups(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["k"]].append((r["pos"], r["v"]))
    return out


def test_top_k(skewed):
    got = defaultdict(list)
    for r in grouping.top_k_per_group(skewed, ["k"], [F.col("v").desc(), F.col("pos")], 7, ["pos"]).collect():
        got[r["k"]].append((r["rank"], r["pos"]))
    for key, rows in _groups(skewed).items():
        best = sorted(rows, key=lambda r: (-r[1], r[0]))[:7]
        assert sorted(got[key]) == [(i + 1, pos) for i, (pos, _) in enumerate(best)]


def test_top_k_limits_before_the_shuffle(skewed):
    plan = grouping.top_k_per_group(skewed, ["k"], [F.col("pos")], 7, ["pos"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_first_seen(skewed):
    got = {(r["k"], r["v"]): r["pos"] for r in grouping.first_seen(skewed, ["k", "v"], ["pos"]).collect()}
    expected = {}
    for key, rows in _groups(skewed).items():
        for pos, v in rows:
            expected[key, v] = min(pos, expected.get((key, v), pos))
    assert got == expected


def test_ordered_concat(skewed):
    rows = skewed.withColumn("t", F.col("v").cast("string"))
    got = {r["k"]: r["t"] for r in grouping.ordered_concat(rows, ["k"], "pos", "t", ",", chunk=64).collect()}
    assert got == {k: ",".join(str(v) for _, v in sorted(r)) for k, r in _groups(skewed).items()}


def test_number_rows(skewed):
    got = {(r["k"], r["pos"]): r["n"] for r in grouping.number_rows(skewed, ["k"], "pos", "n", chunk=500).collect()}
    expected = {(k, pos): i + 1 for k, rows in _groups(skewed).items() for i, (pos, _) in enumerate(sorted(rows))}
    assert got == expected


def test_spread_join(spark, skewed):
    small = skewed.groupBy("k").agg(F.max("pos").alias("top")).limit(20)
    plain = skewed.join(small, "k", "left").select("k", "pos", "top").collect()
    spread = grouping.spread_join(skewed, small, ["k"], "pos", "left").select("k", "pos", "top").collect()
    assert sorted(map(str, plain)) == sorted(map(str, spread))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.text(alphabet="xyz\n,", max_size=4)), max_size=30))
def test_concat_any_text(spark, rows):
    df = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(rows)], "k string, pos bigint, t string")
    got = {r["k"]: r["t"] for r in grouping.ordered_concat(df, ["k"], "pos", "t", "|", chunk=3).collect()}
    expected = defaultdict(list)
    for k, t in rows:
        expected[k].append(t)
    assert got == {k: "|".join(v) for k, v in expected.items()}


def test_neither_side_of_a_spread_join_is_broadcast(spark):
    """The small side is repeated after its size was judged: a broadcast of it does not fit the driver."""
    big = spark.range(1000).select((F.col("id") % 200).alias("k"), F.col("id").alias("pos"))
    kept = grouping.spread_join(big, spark.range(100).select(F.col("id").alias("k")).distinct(), ["k"], "pos", "left_semi")
    assert kept.count() == 500
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def test_numbered_rows_are_not_broadcast(spark, tmp_path):
    """Counts per slice come from a window in few tasks: rows joined to them by broadcast would be numbered there."""
    spark.range(5000).select(F.lit("a").alias("k"), F.col("id").alias("pos")).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = grouping.number_rows(table, ["k"], "pos", "n", chunk=500)
    assert got.where("n <> pos + 1").count() == 0 and got.count() == 5000
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_parts_of_an_even_join_are_neither_broadcast_nor_merged(spark, how):
    left = spark.createDataFrame([(i % 90 if i % 9 else None, i) for i in range(300)], "k bigint, v int")
    right = spark.createDataFrame([(k,) for k in (*range(0, 60), 3, None)], "k bigint")
    joined = grouping.even_join(left, right, ["k"], how)
    assert sorted(map(str, joined.collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    assert joined.select(F.spark_partition_id()).distinct().count() == 4
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
    spread = grouping.spread_join(left, right.distinct(), ["k"], "v", "left_semi", even=True)
    assert spread.select(F.spark_partition_id()).distinct().count() == 4
