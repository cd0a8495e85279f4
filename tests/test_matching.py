import random

import pytest
from pyspark.sql import functions as F

from rankfold import schema as sc
from rankfold.config import SearchConfig
from rankfold.operators import exclusions, matching as mt
from rankfold.session import spread


def test_targets_are_lowered_but_not_stripped(many):
    assert many(mt.target_flag, ["TCS", "tcs ", "GE HealthCare", "x", None]) == [True, False, True, False, False]


def test_flag_members_keeps_the_row_count(spark, collect):
    df = spark.createDataFrame([("A",), ("a",), ("b",), (None,)], "c string")
    members = spark.createDataFrame([("a",), ("A",), ("a",), (None,)], "m string")
    assert collect(mt.flag_members(df, "c", members, "m")) == [("A", True), ("a", True), ("b", False), (None, False)]


@pytest.mark.parametrize("most", [mt.SHIPPED, 0])   # by automaton, by join
def test_keyword_semi_join_against_brute_force(spark, most):
    rng = random.Random(3)
    letters = "abcÄ "
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))) for i in range(200)] + [(900, None), (900, "abc"), (900, "abc")]
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(12)} | {""}
    got = mt.keyword_semi_join(
        spark.createDataFrame(texts, "id int, t string"), "t",
        spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "w string"), "w", most)
    expected = [i for i, t in texts if any(w and w.lower() in (t or "").lower() for w in words)]
    assert sorted(r["id"] for r in got.collect()) == expected


def test_no_keyword_and_short_texts(spark):
    texts = spark.createDataFrame([(1, "abc"), (2, "")], "id int, t string")
    none = mt.keyword_semi_join(texts, "t", spark.createDataFrame([("",)], "w string"), "w")
    longer = mt.keyword_semi_join(texts, "t", spark.createDataFrame([("abcd",)], "w string"), "w")
    assert none.count() == longer.count() == 0


def test_null_descriptions_are_filled(spark):
    posts = spark.createDataFrame([("u", None), ("v", "own"), ("", None)], "url string, description string")
    pages = spark.createDataFrame([("u", "<p>from the page</p>", "")], "url string, html string, rendered_html string")
    got = mt.fill_descriptions(posts, pages).collect()
    assert sorted((r["url"], r["description"]) for r in got) == [("", ""), ("u", "from the page"), ("v", "own")]


@pytest.mark.parametrize("most", [mt.SHIPPED, 0])
def test_long_texts_take_linear_time(spark, most):
    import time

    body = "some plain words of a very long text with ünïcode 😀 and no keyword at all; " * 14_000   # over 1 MB
    texts = spark.createDataFrame([(1, body), (2, body + "needle"), (3, "needl" + body), (4, "x" * 300 + "needle in a window's end")], "id int, t string")
    words = spark.createDataFrame([("needle",), ("haystack",), ("needles in another place",)], "w string")
    start = time.perf_counter()
    assert sorted(r["id"] for r in mt.keyword_semi_join(texts, "t", words, "w", most).collect()) == [2, 4]
    assert time.perf_counter() - start < 20   # cutting every substring from the beginning takes minutes


@pytest.mark.parametrize("width", [1, 3, 256])
def test_pairs_of_texts_and_words(spark, width):
    rng = random.Random(4)
    texts = [(i, "".join(rng.choice("abÄ😀") for _ in range(rng.randrange(0, 40)))) for i in range(60)]
    words = sorted({"".join(rng.choice("abÄ😀") for _ in range(rng.randrange(2, 6))) for _ in range(15)})
    got = mt.keyword_pairs(spark.createDataFrame(texts, "id int, t string"), ["id"], "t",
                           spark.createDataFrame([(w,) for w in words], "w string"), "w", width)
    assert sorted(map(tuple, got.collect())) == sorted((i, w) for i, t in texts for w in words if w in t)


def test_long_keyword_tables_join_on_equality(spark):
    texts = spark.createDataFrame([(1, "abc")], "id int, t string")
    words = spark.range(50).select(F.concat(F.lit("w"), F.col("id")).alias("w"))
    plan = mt.keyword_semi_join(texts, "t", words, "w", 0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


SHELL = '<div id="root"></div>'
LONG = "<p>" + "long text " * 30 + "</p>"


def test_fill_descriptions(spark, collect):
    posts = spark.createDataFrame(
        [("has", "u1"), ("", "u1"), ("", "u2"), ("", "u3"), ("", "u4"), ("", "u5"), ("", "")], "description string, url string")
    pages = spark.createDataFrame([
        ("u1", LONG, None), ("u2", f"<p>short</p>{SHELL}", "<p>rendered</p>"), ("u3", f"<p>short</p>{SHELL}", None),
        ("u4", "<p>short</p>", "<p>rendered</p>"), ("u5", "", "<p>rendered</p>"), ("", "<p>never</p>", None), ("u9", LONG, None),
    ], sc.PAGES_SCHEMA)
    got = dict((u, d) for d, u in collect(mt.fill_descriptions(posts, pages)) if d != "has")
    assert got == {"u1": ("long text " * 30).strip(), "u2": "rendered", "u3": "short", "u4": "short", "u5": "", "": ""}


def test_fill_descriptions_cuts_and_never_multiplies_rows(spark):
    posts = spark.createDataFrame([("", "u")], "description string, url string")
    pages = spark.createDataFrame([("u", "x" * 9000, None), ("u", "y" * 9000, None)], sc.PAGES_SCHEMA)
    rows = mt.fill_descriptions(posts, pages, SearchConfig().published_limits()).collect()
    assert len(rows) == 1 and rows[0]["description"] == "x" * 8000
    whole = mt.fill_descriptions(posts, pages).head()
    assert len(whole["description"]) == 9000


def test_residual(spark, collect):
    df = spark.createDataFrame([("a",), ("b",)], "c string")
    assert collect(mt.residual(df, "c", spark.createDataFrame([("a",), ("a",)], "x string"), "x")) == [("b",)]


def test_exclusion_order(spark, collect):
    from datetime import datetime
    df = spark.createDataFrame([
        ("Dev", "java", "2020-01-01"), ("Dev", "java", "1d"), ("Dev", "", "1d"), ("C# dev", "java", ""), ("Dev", "", "2020-01-01"),
    ], "role string, description string, posted string")
    marked = exclusions.with_exclusion(df, datetime(2026, 6, 30))
    assert [r["flag"] for r in marked.select(F.col("exclusion.flag").alias("flag")).collect()] == [
        "stale_posting", "wrong_stack", None, None, "stale_posting"]
    assert collect(exclusions.excluded_rows(marked), "score", "verdict", "reason") == sorted([
        (0, "EXCLUDED", "Posting is older than 30 days"), (0, "EXCLUDED", "Posting is older than 30 days"),
        (0, "EXCLUDED", "No C#/.NET stack found in job description")], key=repr)


def test_gate(spark):
    df = spark.createDataFrame([(50, "GOOD_FIT"), (51, "GOOD_FIT"), (99, "EXCLUDED"), (51, "")], "s int, v string")
    assert [r[0] for r in df.select(exclusions.passes_gate(F.col("s"), F.col("v"))).collect()] == [False, True, False, True]


def test_spread_only_adds_a_shuffle_to_small_scans(spark, tmp_path):
    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    spark.range(10).coalesce(1).write.parquet(small)
    spark.range(100).repartition(40).write.parquet(large)
    one = spark.read.parquet(small)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 * 1024 * 1024))
    try:
        many_files = spark.read.parquet(large)
        assert spread(many_files) is many_files
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
