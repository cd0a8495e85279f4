import random

import pytest
from pyspark.sql import functions as F

from rankfold.operators import ranking as rk

ORDER = ["source_rank", "board_rank", "item_pos"]


@pytest.fixture(scope="module")
def postings(spark):
    rng = random.Random(7)
    data = [(rng.choice(["", "a", "b", f"u{i}"]), i % 3, i % 5, i, rng.random() < 0.3) for i in range(400)]
    return data, spark.createDataFrame(data, "url string, source_rank int, board_rank bigint, item_pos bigint, hit boolean")


def _first(data):
    best = {}
    for row in sorted(data, key=lambda r: r[1:4]):
        best.setdefault(row[0], row)
    return best


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_keep_first_does_not_depend_on_partitioning(postings, collect, partitions):
    data, df = postings
    got = rk.keep_first(df.repartition(partitions), "url", ORDER)
    assert collect(got) == sorted(_first(data).values(), key=repr)
    assert collect(rk.keep_first(got, "url", ORDER)) == collect(got)


def test_keep_first_can_keep_rows_without_a_link(postings, collect):
    data, df = postings
    expected = [r for k, r in _first(data).items() if k] + [r for r in data if not r[0]]
    assert collect(rk.keep_first(df, "url", ORDER, empty="keep_all")) == sorted(expected, key=repr)


def test_keep_first_limits_groups_before_the_shuffle(postings):
    plan = rk.keep_first(postings[1], "url", ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("limit", [0, 1, 50, 10_000, None])
def test_cap_by_priority(postings, collect, limit):
    data, df = postings
    expected = sorted(data, key=lambda r: (not r[4], r[1:4]))[:limit]
    got = rk.cap_by_priority(df.repartition(9), F.col("hit"), limit)
    assert collect(got, "item_pos", "priority") == sorted([(r[3], 0 if r[4] else 1) for r in expected], key=repr)


def test_cap_sends_only_keys_through_the_top_k(spark):
    df = spark.range(10).select(
        F.lit(0).alias("source_rank"), F.lit(0).alias("board_rank"), F.col("id").alias("item_pos"), F.lit("long").alias("description"))
    plan = rk.cap_by_priority(df, F.col("item_pos") > 5, 3)._jdf.queryExecution().executedPlan().toString()
    top = next(line for line in plan.splitlines() if "TakeOrderedAndProject" in line)
    assert "description" not in top and "CartesianProduct" not in plan


def test_rank_rows(postings):
    data, df = postings
    got = rk.rank_rows(df, [F.desc("hit"), "item_pos"], 20).orderBy("rank").collect()
    expected = sorted(data, key=lambda r: (not r[4], r[3]))[:20]
    assert [(r["rank"], r["item_pos"]) for r in got] == [(i + 1, r[3]) for i, r in enumerate(expected)]


def test_first_success(spark, collect):
    tries = spark.createDataFrame(
        [("a", 0, "x", False), ("a", 1, "y", True), ("a", 2, "z", True), ("b", 0, "q", False)], "k string, pos int, v string, ok boolean")
    assert collect(rk.first_success(tries, ["k"], "pos", F.col("ok"), ["v"])) == [("a", 1, "y"), ("b", None, None)]


def test_lowest_ok_host(spark, collect):
    probes = spark.createDataFrame([("a", 1, False), ("a", 3, True), ("a", 2, True), ("b", 1, False)], "tenant string, n int, ok boolean")
    assert collect(rk.lowest_ok_host(probes)) == [("a", 2)]
