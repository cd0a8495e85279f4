"""Cases that default settings, odd markup and missing values must get right."""

import time

import pytest
from pyspark.sql import functions as F

from rankfold.config import SearchConfig
from rankfold.functions.html import table_rows, visible_text
from rankfold.operators import ranking as rk, registry as rg, rules as rl


# ---- markup

@pytest.mark.parametrize("markup, text", [
    ("a<![foo[x]]>b", "a\nb"), ("a<![if gte mso 9]>b<![endif]>c", "a\nb\nc"), ("a<![CDATA[x]]>b", "a\nx\nb"),
    ("a<!DOCTYPE html>b", "a\nb"), ("a<!-- x > y -->b", "a\nb"),
])
def test_marked_sections_do_not_raise(markup, text):
    assert visible_text(markup) == text


def test_cut_and_random_markup_never_raises():
    import random

    rng = random.Random(5)
    parts = ["<", ">", "<!", "<![", "]]>", "<!--", "-->", "</", "<p", "<td>", "</td>", "<tr>", "</tr>", "x", "&amp", "&#x", " ", "'", '"', "<?", "="]
    for _ in range(3000):
        markup = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        visible_text(markup)
        list(table_rows(markup))


@pytest.mark.parametrize("markup", ["<br><p>x</p>" * 100_000, "<div>" * 100_000 + "</span></p>" * 50_000 + "</div>" * 100_000])
def test_many_tags_take_linear_time(markup):
    start = time.perf_counter()
    visible_text(markup)
    assert time.perf_counter() - start < 8   # quadratic walks take minutes


# ---- default rules

def scored(spark, description="", title="Software Developer", location="Austin, TX", company="acme"):
    df = spark.createDataFrame([(title, description, location, company)], "role string, description string, location string, company string")
    return rl.score_by_rules(df).head()


def cosmetic(spark, description):
    df = spark.createDataFrame([("t", description, "", "")], "role string, description string, location string, company string")
    return rl.with_rule_text(df).select(rl.is_cosmetic(SearchConfig())).head()[0]


@pytest.mark.parametrize("text, expected", [
    ("We use Java or Python. You will build .NET services daily. Maintain our Java codebase.", False),
    ("Java, Python, .NET or TypeScript. Build Java microservices.", True),
    ("Java, Python, or C#. We go above and beyond.", False),
    ("Java, Python, or C#. Services in Go, and tests.", True),
    ("C# and golang. Much golang.", True),
])
def test_or_lists(spark, text, expected):
    assert cosmetic(spark, text) is expected


@pytest.mark.parametrize("text, expected", [
    ("pays $680K a year", True), ("pays $1.2M", True), ("pays $120,000 - $150,000.", False), ("pays $90k", False),
    ("pays $700,000", True), ("pays $1234567890123456789012", True), ("no amount", False),
])
def test_salaries(spark, text, expected):
    df = spark.createDataFrame([(text.lower(),)], "b string")
    assert df.select(rl.salary_outlier(F.col("b"), 500_000)).head()[0] is expected


@pytest.mark.parametrize("place, foreign", [
    ("Berlin, Germany", True), ("London", True), ("Paris, TX", False), ("Ontario, CA", False), ("Remote - Brazil", True),
    ("New York, NY", False), ("Dublin, OH 43017", False), ("Dublin", True), ("Remote, US or Canada", False), ("Indiana", False), ("", False),
])
def test_places(spark, place, foreign):
    assert (scored(spark, "C# .NET", location=place)["flag"] == "non-US location") is foreign


def test_required_names_with_dots(spark):
    from rankfold.config import Rule

    config = SearchConfig(rules=(Rule("r", "points", "description", "required", (".net",), 7),))
    df = spark.createDataFrame([("t", "Some words. Strong experience with ASP.NET Core v1.5 required! More.", "", "")],
                               "role string, description string, location string, company string")
    assert rl.with_rule_text(df).select(rl.rule_points(config)).head()[0] == 7


# ---- rows that used to vanish

def test_companies_without_candidates_are_not_found(spark):
    candidates = spark.createDataFrame([("a", 0, ["x"]), ("b", 1, []), ("c", 2, None)], "company string, company_pos int, slugs array<string>")
    probes = spark.createDataFrame([("greenhouse", "x", 200, '{"jobs": []}', None)],
                                   "ats string, slug string, http_status int, payload string, error string")
    found = rg.discover(candidates, probes)
    assert rg.confirmed(found).count() == 1
    assert sorted(r["company"] for r in rg.not_found(found).collect()) == ["b", "c"]


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "u"), (3, "u"), (4, None)], "item_pos int, url string")
    kept = rk.keep_first(df, "url", ["item_pos"], empty="keep_all")
    assert sorted(r["item_pos"] for r in kept.collect()) == [0, 1, 2, 4]


def test_hosts_outside_the_range_do_not_count(spark):
    probes = spark.createDataFrame([("a", 6, True), ("b", 0, True), ("b", 5, True)], "tenant string, n int, ok boolean")
    assert [(r["tenant"], r["host_no"]) for r in rk.lowest_ok_host(probes).collect()] == [("b", 5)]
    assert rk.lowest_ok_host(probes, (0, 9)).count() == 2


def test_rank_of_all_rows(spark):
    df = spark.range(5000).select(F.col("id"), F.hash("id").alias("h")).repartition(7)
    ranked = rk.rank_rows(df, [F.desc("h"), "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 5001))
    assert [r["id"] for r in ranked] == [r["id"] for r in sorted(ranked, key=lambda r: (-r["h"], r["id"]))]


def test_defaults_process_everything():
    assert SearchConfig().max_jobs is None and SearchConfig().description_chars is None
    published = SearchConfig().published_limits()
    assert (published.max_jobs, published.description_chars) == (200, 8000)
