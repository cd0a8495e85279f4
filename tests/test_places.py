"""Places as data, lists from files, and what plans must look like."""

import pytest
from pyspark.sql import functions as F

from rankfold import config as cf
from rankfold import schema as sc
from rankfold.config import CompanyRule, SearchConfig
from rankfold.operators import matching as mt, places, ranking as rk, rules as rl
from rankfold.plans import search
from rankfold.sources.landed import read_list_files

PLACES = [
    ("Berlin, Germany", "berlin", True), ("London", "london", True), ("Paris, TX", "paris", False), ("Paris , TX 75460 ", "paris", False),
    ("Paris, TX, France", "paris", True), ("Ontario, CA", None, False), ("Remote - Brazil", "brazil", True), ("New York, NY", None, False),
    ("Santa Fe, New Mexico", None, False), ("Mexico City, Mexico", "mexico", True), ("Belfast, Northern Ireland", "northern ireland", True),
    ("Remote, U.S. or Canada", "canada", False), ("Austin, United States of America", None, False), ("Indiana", None, False),
    ("Türkiye / São Paulo", None, False), ("", None, False), (None, None, False), ("ukiah", None, False), ("UK", "uk", True),
]


def test_places(spark):
    df = spark.createDataFrame([(i, p, "x") for i, (p, _, _) in enumerate(PLACES)] + [(0, "Berlin, Germany", "x")], "i int, location string, place string")
    got = sorted((r["i"], r["place"], r["is_foreign"]) for r in places.with_foreign(df.drop("place")).collect())
    assert got == sorted([(i, place, foreign) for i, (_, place, foreign) in enumerate(PLACES)] + [(0, "berlin", True)])


def test_names_of_any_length_and_very_long_locations(spark):
    table = spark.createDataFrame([("one two three four five", True, False), ("two three", False, False), ("five", True, None)], sc.PLACES_SCHEMA)
    df = spark.createDataFrame([(0, "One-Two: three four five"), (1, "zero two three five"), (2, "four " * 20000 + "five")], "i int, location string")
    got = {r["i"]: (r["place"], r["is_foreign"]) for r in places.with_foreign(df, table).collect()}
    assert got == {0: ("one two three four five", True), 1: ("five", False), 2: ("five", True)}


def test_list_files(spark, tmp_path):
    for n, data in enumerate((b"| a \xc3\xa9 |", b"latin \xe9", b"", b"x" * 100)):
        folder = tmp_path / "source=s" / f"doc_no={n}"
        folder.mkdir(parents=True)
        (folder / "list.md").write_bytes(data)
    got = sorted(map(tuple, read_list_files(spark, str(tmp_path), most_bytes=50).collect()))
    assert got == [("s", 0, "| a é |", None), ("s", 1, "latin é", "not UTF-8"), ("s", 3, None, "100 bytes")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_markup_is_parsed_after_keep_first(spark):
    from datetime import datetime

    payload = '{"jobs": [{"title": "software engineer", "content": "&lt;p&gt;c# text&lt;/p&gt;", "absolute_url": "u", "location": {"name": "x"}}]}'
    boards = spark.createDataFrame([("s", 0, payload), ("t", 1, payload)], sc.PAYLOADS_SCHEMA)
    run = search.run_search(search.Inputs(board_a=boards), datetime(2026, 6, 30), save_stages=False)
    plan = plan_of(run.unique)
    # from the root down: the parser stands above the window that keeps the first
    assert 0 <= plan.index("ArrowEvalPython") < plan.index("Window")
    assert [(r["description"], r["has_signal"]) for r in run.unique.collect()] == [("c# text", True)]
    assert run.run_counts.head()["n_found"] == 2


def test_counts_score_nothing(spark):
    from datetime import datetime

    def scorer(rows):
        raise AssertionError("scored")

    postings = spark.createDataFrame([("s", "list", "html-table", "", "", 0)], sc.SOURCES_SCHEMA)
    docs = spark.createDataFrame([("s", 0, "<tr><td>a<td>b<td>c<td><a href='https://x.example'>y</a><tr>")], sc.RAW_DOCS_SCHEMA)
    run = search.run_search(search.Inputs(sources=postings, raw_docs=docs), datetime(2026, 6, 30), scorer=scorer)
    assert run.run_counts.head()["n_unique"] == 1 and run.source_counts.count() == 1
    with pytest.raises(AssertionError):
        run.results  # noqa: B018


SKEW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def skewed(spark):
    """Thresholds low enough for a small table to be skewed."""
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "Hot").otherwise(F.concat(F.lit("c"), F.col("id").cast("string"))).alias("company"),
                                     F.sha2(F.col("id").cast("string"), 256).alias("description"), F.lit("Engineer").alias("role"), F.lit("x").alias("location")).repartition(6)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_hot_member_is_split(spark, skewed):
    members = spark.range(50_000).select(F.concat(F.lit("C"), (F.col("id") * 2).cast("string")).alias("m")).union(spark.createDataFrame([("hot",)], "m string"))
    flagged = mt.flag_members(skewed, "company", members, "m")
    assert flagged.filter("is_member").count() > 20_000
    flagged.write.format("noop").mode("overwrite").save()
    grouped = flagged.select("is_member", "description")
    grouped.collect()
    assert "skew=true" in plan_of(grouped)


def test_a_hot_company_is_split(spark, skewed):
    attrs = spark.range(40_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("company_lower"), F.lit("small").alias("size_class"),
                                       F.lit(True).alias("is_tech"), F.lit(True).alias("is_sponsor"), F.lit(True).alias("is_known"))
    scored = rl.score_by_rules(skewed, SearchConfig(rules=()), company_attrs=attrs).select("score", "description")
    scored.collect()
    assert "skew=true" in plan_of(scored)


def test_many_rules_of_one_company(spark):
    rules = [("acme", f"t{i:04d}", i % 50 + 10, f"f{i}") for i in range(2500)] + [("acme", None, 70, "all"), ("other", "", 30, "any"), ("big", None, 20, "b")]
    table = spark.createDataFrame(rules, sc.COMPANY_RULES_SCHEMA)
    titles = [("Acme", "x t0007 t0003"), ("Acme", "none"), ("Other", "t0001"), ("Big", "t0002"), ("None", "t0001"), ("acme", "T2499"), ("Acme", "x t0007 t0003")]
    df = rl.with_rule_text(spark.createDataFrame([(i, c, t, "", "") for i, (c, t) in enumerate(titles)], "i int, company string, role string, location string, description string"))
    few, many = ({r["i"]: (r["company_cap"], r["company_flag"]) for r in rl.with_company_facts(df, SearchConfig(), table, most=most).collect()}
                 for most in (10_000, 1000))
    assert few == many == {0: (13, "f3"), 1: (70, "all"), 2: (30, "any"), 3: (20, "b"), 4: (None, None), 5: (59, "f2499"), 6: (13, "f3")}


def test_large_caps_are_found_by_range(spark, monkeypatch):
    df = spark.range(3000).select(F.lit(0).alias("source_rank"), (F.col("id") % 7).alias("board_rank"), F.col("id").alias("item_pos")).repartition(5)
    want = sorted(map(tuple, rk.cap_by_priority(df, F.col("item_pos") % 3 == 0, 1700).collect()))
    monkeypatch.setattr(rk, "SORTED_AT_ONCE", 100)
    capped = rk.cap_by_priority(df, F.col("item_pos") % 3 == 0, 1700)
    assert sorted(map(tuple, capped.collect())) == want and len(want) == 1700
    assert "TakeOrdered" not in plan_of(capped)


def test_company_rules_of_the_settings(spark):
    config = SearchConfig(company_rules=(CompanyRule("acme", None, 30, "a"), CompanyRule("acme", "x", 20, "b")), rules=(cf.Rule("r", cf.POINTS, "title", "substring", ("q",), 1),))
    df = spark.createDataFrame([("Acme", "x", "", ""), ("Acme", "y", "", "")], "company string, role string, location string, description string")
    assert sorted((r["role"], r["score"], r["flag"]) for r in rl.score_by_rules(df, config).collect()) == [("x", 20, "b"), ("y", 30, "a")]
