import pytest
from pyspark.sql import functions as F

from rankfold import config as cf
from rankfold import schema as sc
from rankfold.config import CompanyRule, Rule, SearchConfig
from rankfold.operators import rules as rl

COLUMNS = "company string, role string, location string, description string"
GOOD = ("C# and .NET on Azure Functions with microservices in healthcare. Junior role, remote. "
        "Redis, CI/CD, CQRS, LLM integration. Lambda. $90,000")


def scores(spark, cases, config=SearchConfig(), **tables):
    """Scores of many variations of one good posting, in order."""
    rows = [(i, c.get("company", "Acme"), c.get("role", "Software Engineer"), c.get("location", "Austin, TX"), c.get("description", GOOD))
            for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, " + COLUMNS)
    return sorted(rl.score_by_rules(df, config, **tables).collect(), key=lambda r: r["i"])


def score(spark, config=SearchConfig(), company_rules=None, company_attrs=None, **case):
    return scores(spark, [case], config, company_rules=company_rules, company_attrs=company_attrs)[0]


def test_strong_fit(spark):
    row = score(spark)
    assert (row["score"], row["verdict"], row["flag"]) == (100, "STRONG_FIT", "")


def test_disqualifiers(spark):
    cases = [
        ({"description": "Active Secret Clearance needed"}, "clearance required"),
        ({"description": "DoD work"}, "clearance required"),
        ({"location": "London, UK"}, "non-US location"),
        ({"location": "Remote in UK"}, "non-US location"),
        ({"role": "FPGA Engineer"}, "wrong role type"),
        ({"description": "6 month contract"}, "contract or placement"),
        ({"description": "we will not sponsor"}, "no sponsorship"),
        ({"role": "Sr. Software Engineer"}, "seniority mismatch"),
        ({"company": "Peraton"}, "known false positive"),
        ({"company": "Adtran", "role": "Software Engineer II"}, "known false positive"),
        ({"company": "FetchJobs.co"}, "known false positive"),
    ]
    got = [(r["score"], r["verdict"], r["flag"]) for r in scores(spark, [c for c, _ in cases])]
    assert got == [(0, "EXCLUDED", flag) for _, flag in cases]


def test_words_are_matched_whole_and_title_rules_need_the_title(spark):
    cases = [
        {"description": GOOD + " a polyglot and a leader"}, {"location": "Ukiah, CA"}, {"role": "Leadership Software Engineer"},
        {"company": "Adtran", "role": "Backend Developer"}, {"company": "Boeing", "role": "Software Engineer"},
    ]
    assert all(r["score"] > 0 for r in scores(spark, cases))


def test_remote_alone_is_flagged_but_kept(spark):
    row = score(spark, location=" Remote ")
    assert (row["score"], row["verdict"], row["flag"]) == (100, "FLAGGED", "verify location")


def test_caps(spark):
    many = "java python go rust ruby php scala kotlin swift perl react vue django flask spring rails kafka spark hadoop"
    cases = [
        ({"company": "Lockheed Martin"}, 50),
        ({"description": GOOD + " up to $680,000"}, 40),
        ({"description": GOOD + " $99999999999999999999"}, 40),
        ({"description": GOOD + " Customer Service, MS Office"}, 40),
        ({"description": f"{GOOD} {many}"}, 40),
    ]
    rows = scores(spark, [c for c, _ in cases])
    assert [(r["score"], r["verdict"]) for r in rows] == [(cap, "FLAGGED") for _, cap in cases]
    assert all(r["flag"] for r in rows)


def test_a_filter_on_the_score_does_not_run_the_rules_again(spark):
    df = spark.createDataFrame([("c", "r", "l", "d")], COLUMNS)
    plan = rl.score_by_rules(df).filter("score >= 51")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("placed at client") == 1


def test_penalties_look_at_the_sentence(spark):
    cases = [
        ("salary", 0), ("salary. Angular is required", -15), ("salary. Angular is nice to have", 0),
        ("salary. Angular. Java is required", 0), ("salary. Strong experience in Terraform", -10), ("salary. On-site in Austin", -5),
        ("salary. On-site or hybrid", 5), ("salary. 5+ years", -5), ("salary. 2+ years", 0), ("no pay named", -3), ("", 0),
    ]
    rows = [(i, "c", "r", "l", text) for i, (text, _) in enumerate(cases)]
    df = rl.with_rule_text(spark.createDataFrame(rows, "i int, " + COLUMNS))
    got = [r[1] for r in sorted(df.select("i", rl.rule_points(SearchConfig())).collect())]
    assert got == [expected for _, expected in cases]


def test_or_lists(spark):
    cases = [
        ("Java, Python or C#", False),
        ("Java, Python or C#. Build Java services", True),
        ("Java, Python or C#. Build Java services. Maintain our C# code", False),
        ("Build Java services", False), ("C# only", False),
    ]
    rows = [(i, "c", "r", "l", text) for i, (text, _) in enumerate(cases)]
    df = rl.with_rule_text(spark.createDataFrame(rows, "i int, " + COLUMNS))
    assert [r[1] for r in sorted(df.select("i", rl.is_cosmetic(SearchConfig())).collect())] == [c for _, c in cases]


def test_company_attributes(spark):
    text = "C#. Java or C#. Build Java. $1"
    attrs = spark.createDataFrame([
        ("big", "large", True, True, True), ("tiny", "small", True, False, True), ("ngo", None, False, None, True), ("vague", None, None, None, False),
        ("big", None, None, None, None),
    ], sc.COMPANY_ATTRS_SCHEMA)
    mixed = "Java or C#. Build Java. $1"
    rows = scores(spark, [
        {"company": "none", "description": mixed}, {"company": "BIG", "description": mixed}, {"company": "none", "description": text},
        {"company": "tiny", "description": text}, {"company": "ngo"}, {"company": "vague"}], company_attrs=attrs)
    got = [r["score"] for r in rows]
    assert got[1] == got[0] + 20 + 5 and got[3] == got[2] - 5
    assert rows[4]["flag"] == "non-tech organisation" and got[5] == 40


def test_zero_wins_over_a_cap_and_rules_never_multiply_rows(spark):
    config = SearchConfig(company_rules=(
        CompanyRule("acme", None, 50, "cap"), CompanyRule("acme", "engineer", 0, "zero"), CompanyRule("acme", "nurse", 10, "other")))
    df = spark.createDataFrame([("Acme", "Engineer", "", GOOD), ("Acme", "Developer", "", GOOD)], COLUMNS)
    got = {r["role"]: (r["score"], r["flag"]) for r in rl.score_by_rules(df, config).collect()}
    assert got == {"Engineer": (0, "zero"), "Developer": (50, "cap")}


def test_company_rules_from_a_table(spark):
    table = spark.createDataFrame([("acme", None, 30, "seen")], sc.COMPANY_RULES_SCHEMA)
    assert score(spark, company_rules=table)["score"] == 30


def test_scores_stay_in_range(spark):
    low = SearchConfig(rules=(Rule("low", cf.POINTS, "title", "substring", ("e",), -500),))
    assert score(spark, config=low)["score"] == 0
    assert score(spark, config=SearchConfig(rules=()))["verdict"] == "EXCLUDED"


def test_bands(spark):
    df = spark.createDataFrame([(0,), (50,), (51,), (65,), (66,), (79,), (80,), (100,)], "s int")
    assert [r[0] for r in df.select(rl.band(F.col("s"))).collect()] == [
        "EXCLUDED", "EXCLUDED", "NEAR_MISS", "NEAR_MISS", "GOOD_FIT", "GOOD_FIT", "STRONG_FIT", "STRONG_FIT"]


def test_rules_can_be_loaded_from_a_table(spark):
    schema = "rule_id string, rule_order int, kind string, scope string, match string, keyword string, value int, flag string"
    table = spark.createDataFrame([
        ("b", 2, "points", "both", "substring", "y", 5, None), ("a", 1, "disqualify", "title", "word", "k2", None, "f"),
        ("a", 1, "disqualify", "title", "word", "k1", None, "f")], schema)
    assert rl.load_rules(table) == (
        Rule("a", "disqualify", "title", "word", ("k1", "k2"), 0, "f"), Rule("b", "points", "both", "substring", ("y",), 5, ""))
    with pytest.raises(ValueError):
        rl.load_rules(table, limit=2)
