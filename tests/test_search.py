"""A whole run over landed fixtures, and properties of its stages."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rankfold import schema as sc
from rankfold.config import SearchConfig
from rankfold.operators import reports
from rankfold.plans import search
from rankfold.sources.sinks import read_csv, write_results

AS_OF = datetime(2026, 6, 30, 12)
TEXT = "C# and .NET, Azure SQL, microservices, healthcare, junior, remote. $90,000"


@pytest.fixture(scope="module")
def inputs(spark):
    markdown = "\n".join([
        "| Company | Role | Location | Apply | Age |", "| --- | --- | --- | --- | --- |",
        "| TCS | .NET Developer | Austin | [Apply](https://jobs.example/1) | 0d |",
        "| Beta | Engineer | Remote | [Apply](https://jobs.example/2) | 3d |",
        "| Copy | Developer | Austin | [Apply](https://a.example/1) | 3d |",
        "| Gamma | Engineer | NYC | [Apply](https://jobs.example/3) | Jun 30 |",
    ])
    payload = json.dumps({"jobs": [
        {"title": "Developer", "content": TEXT, "absolute_url": "https://a.example/1", "updated_at": "2026-06-29T00:00:00Z"},
        {"title": "Software Engineer", "content": TEXT, "absolute_url": "https://a.example/2", "updated_at": "2026-01-01T00:00:00Z"},
        {"title": "Backend Engineer", "content": "Java only", "absolute_url": "https://a.example/3", "updated_at": "2026-06-30T00:00:00Z"},
        {"title": "Software Engineer", "content": TEXT},
    ]})
    b_payload = json.dumps([{"text": "Engineer", "descriptionPlain": TEXT + " Secret Clearance", "hostedUrl": "https://b.example/1"},
                            {"text": "Engineer", "descriptionPlain": TEXT}])
    c_payload = json.dumps({"jobPostings": [{"title": "Developer", "externalPath": "p/1", "locationsText": "Seattle"}]})
    make = spark.createDataFrame
    return search.Inputs(
        sources=make([("md", "list", "markdown-html", "", "", 0)], sc.SOURCES_SCHEMA),
        raw_docs=make([("md", 0, markdown)], sc.RAW_DOCS_SCHEMA),
        board_a=make([("inovalon", 0, payload)], sc.PAYLOADS_SCHEMA),
        board_b=make([("bee", 0, b_payload)], sc.PAYLOADS_SCHEMA),
        board_c=make([("cee", "ext", 0, 0, c_payload)], sc.CAPTURED_SCHEMA),
        host_probes=make([("cee", 2, True)], sc.HOST_PROBES_SCHEMA),
        pages=make([("https://jobs.example/1", f"<p>{TEXT}</p>", None), ("https://jobs.example/3", "<p>Java</p>", None)], sc.PAGES_SCHEMA),
    )


@pytest.fixture(scope="module")
def stages(inputs):
    return search.run_search(inputs, AS_OF)


def test_union_keeps_source_order(stages, collect):
    counts = {r["source"]: r["n"] for r in stages.postings.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert counts == {"md": 4, "greenhouse": 4, "lever": 2, "workday": 1}
    ranks = [r[0] for r in stages.postings.orderBy(*sc.ORDER_COLUMNS).select("source").collect()]
    assert ranks == ["md"] * 4 + ["greenhouse"] * 4 + ["lever"] * 2 + ["workday"]


def test_list_row_wins_over_board_row_and_empty_links_collapse(stages, collect):
    assert stages.unique.count() == 9
    assert collect(stages.unique.filter("url IN ('https://a.example/1', '')"), "company", "source") == [
        ("Copy", "md"), ("inovalon", "greenhouse")]


def test_outcomes(stages, collect):
    got = {r["url"]: (r["score"] > 0, r["verdict"], r["flag"]) for r in stages.scored.collect()}
    assert got["https://jobs.example/1"] == (True, "STRONG_FIT", "")
    assert got["https://jobs.example/3"] == (False, "EXCLUDED", "wrong_stack")
    assert got["https://a.example/2"] == (False, "EXCLUDED", "stale_posting")
    assert got["https://a.example/3"] == (False, "EXCLUDED", "wrong_stack")
    assert got["https://b.example/1"] == (False, "EXCLUDED", "clearance required")
    assert got["https://jobs.example/2"][1:] == ("FLAGGED", "verify location")
    assert len(got) == stages.scored.count() == stages.unique.count()


def test_results_are_ranked_and_marked(stages):
    rows = stages.results.collect()
    assert [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)
    assert all(r["score"] >= 51 and r["verdict"] != "EXCLUDED" for r in rows) and rows
    assert {r["company"]: r["target"] for r in rows}["TCS"] == "🎯"
    assert {r["company"]: r["target"] for r in rows}["inovalon"] == "🎯"


def test_histogram_counts_every_processed_row(stages):
    assert stages.histogram.agg(F.sum("cnt")).head()[0] == stages.scored.count()
    assert stages.histogram.count() == 7


def test_source_counts(stages, collect):
    found = dict(collect(stages.source_counts))
    assert found["greenhouse"] == 4 and sum(found.values()) == stages.postings.count()


def test_run_counts(stages, inputs):
    row = stages.run_counts.head()
    assert (row["n_found"], row["n_unique"], row["n_recent"]) == (stages.postings.count(), 9, 9)
    assert row["n_signal"] == stages.unique.filter("has_signal").count() and row["n_to_process"] == 9
    capped = search.run_search(inputs, AS_OF, SearchConfig(max_jobs=3), save_stages=False)
    assert capped.run_counts.head()["n_to_process"] == 3


def test_csv_output(spark, stages, tmp_path, collect):
    path = write_results(stages.results, str(tmp_path), AS_OF)
    assert path.endswith("/jobs_20260630_120000.csv")
    schema = search.output_table(stages).schema
    assert collect(read_csv(spark, path, schema)) == collect(search.output_table(stages))
    assert search.output_table(stages).columns == [
        "score", "verdict", "flag", "target", "company", "role", "location", "posted", "reason", "source", "url"]
    parquet = write_results(stages.results, str(tmp_path), AS_OF, "parquet")
    assert spark.read.parquet(parquet).count() == stages.results.count()


def test_today_filter_runs_after_keep_first(inputs, collect):
    today = search.run_search(inputs, AS_OF, SearchConfig(today_only=True), save_stages=False)
    assert collect(today.recent, "url") == sorted([("https://jobs.example/1",), ("https://jobs.example/3",), ("https://a.example/3",)])


def test_cap_counts_rows_that_are_excluded_later(inputs):
    capped = search.run_search(inputs, AS_OF, SearchConfig(max_jobs=3))
    assert capped.scored.count() == 3
    assert capped.scored.filter("flag = 'stale_posting'").count() == 1


def test_uncapped_run_and_kept_empty_links(inputs):
    run = search.run_search(inputs, AS_OF, SearchConfig(max_jobs=None, empty_url="keep_all"))
    assert run.scored.count() == 10


def test_lazy_and_saved_runs_agree(inputs, stages, collect):
    lazy = search.run_search(inputs, AS_OF, save_stages=False)
    assert collect(search.output_table(lazy)) == collect(search.output_table(stages))


def test_landed_replies_as_scorer(spark, inputs, collect):
    replies = spark.createDataFrame([("https://jobs.example/1", '{"score": 77, "verdict": "GOOD_FIT"}')], "url string, reply string")
    run = search.run_search(inputs, AS_OF, scorer=search.reply_scorer(replies))
    assert collect(run.results, "url", "score") == [("https://jobs.example/1", 77)]
    assert run.scored.filter("flag = 'parse_error'").count() == 5


def test_model_as_scorer(spark, inputs, collect):
    import pandas as pd

    def answer(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: '{"score": %d, "verdict": "GOOD_FIT"}' % (90 if "TCS" in p else 60))

    run = search.run_search(inputs, AS_OF, scorer=search.model_scorer(answer, partitions=3))
    assert [(r["company"], r["score"]) for r in run.results.collect()][0] == ("TCS", 90)
    assert run.results.count() == 6 and run.scored.count() == 9


def test_prompts_for_a_model(stages):
    row = search.prompts(stages.capped.filter("url = 'https://jobs.example/2'")).head()
    assert row["prompt"].startswith("Job to evaluate:\nTitle: Engineer\nCompany: Beta\n")


def test_prompts_hold_the_rubric_and_the_profile(spark, inputs, stages):
    import pandas as pd

    row = search.prompts(stages.capped.filter("url = 'https://jobs.example/2'"), "Rate for {profile}.", "me").head()
    assert row["prompt"].startswith("Rate for me.\n\nJob to evaluate:\nTitle: Engineer")

    def answer(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: '{"score": 70, "verdict": "GOOD_FIT"}' if p.startswith("Rate for me.") else "")

    run = search.run_search(inputs, AS_OF, scorer=search.model_scorer(answer, "Rate for {profile}.", "me"))
    assert {r["score"] for r in run.results.collect()} == {70}


def test_missing_sources(spark, inputs):
    only = search.all_postings(search.Inputs(board_b=inputs.board_b))
    assert only.count() == 2
    with pytest.raises(ValueError):
        search.all_postings(search.Inputs())


def test_histogram_bars(spark):
    df = spark.createDataFrame([(s,) for s in [0, 0, -3, 30, 31, 50, 51, 79, 80, 120]], "score int")
    lines = {r["label"]: (r["cnt"], r["line"]) for r in reports.score_histogram(df).collect()}
    assert {k: v[0] for k, v in lines.items()} == {
        "0 (error/excluded)": 2, "1–30": 2, "31–40": 1, "41–50": 1, "51–65": 1, "66–79": 1, "80+": 2}
    assert lines["80+"][1] == "80+" + " " * 19 + ":   2  ██"


def test_total_counts(spark, collect):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert collect(reports.total_counts(df, n_big=F.col("x") > 1)) == [(3, 2)]
