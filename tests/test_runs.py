"""The registered runs reach every part of a run."""

import os

import pytest
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.plans.table_queries import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


@pytest.fixture(scope="module")
def rows(spark):
    return all_queries()["search_run"](spark, SF_DIR).collect()


def test_every_source_priority_and_outcome_occurs(rows):
    assert {r["source"] for r in rows} == {"pipes", "tables", fv.BOARD_A, fv.BOARD_B, fv.BOARD_C}
    assert {r["priority"] for r in rows} == {0, 1}
    assert {r["flag"] for r in rows} >= {"", fv.STALE_FLAG, fv.OFF_STACK_FLAG, "blue", "known", "check place"}
    assert {r["verdict"] for r in rows} >= {"EXCLUDED", "FLAGGED", "NEAR_MISS"}
    assert {r["target"] for r in rows} == {"", fv.TARGET_MARK}


def test_descriptions_are_filled_from_pages_and_their_rendered_form(spark, rows):
    filled = [r for r in rows if r["source"] == "tables" and r["digest"] != "d41d8cd98f00b204e9800998ecf8427e"]
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").withColumn("short", F.length("html") <= 2000)
    kinds = {f"https://apply.example/{r['page_id']}?a=1&b=2": r["short"] for r in pages.collect()}
    assert {kinds[r["url"]] for r in filled} == {True, False}


def test_the_flagship_ranks_documents_and_pages(spark):
    import __spark_entry__ as driver

    ranked = driver.entry(spark).collect()
    outcomes = all_queries()["capped_outcomes"](spark, SF_DIR)
    assert {r["source"] for r in outcomes.select("source").distinct().collect()} == {"documents", "pages"}
    assert {r["priority"] for r in outcomes.select("priority").distinct().collect()} == {0, 1}
    assert sorted(r["rank"] for r in ranked) == list(range(1, len(ranked) + 1)) and len(ranked) > 50
