import pytest

from rankfold import fixed_values as fv
from rankfold import schema as sc
from rankfold.functions.slugs import slug_variants
from rankfold.plans import registry as plan
from rankfold.operators import registry as rg

A, B, C = fv.BOARD_A, fv.BOARD_B, fv.BOARD_C


@pytest.mark.parametrize("ats, slug, expected", [
    (A, "point-click", ["pointclick", "point-clickinc", "point-clicktechnologies", "point-clicksystems", "point-clicksoftware",
                        "point-clicklabs", "point-clickhealth"]),
    (A, "pointclickcare", ["pointclickcareinc", "pointclickcaretechnologies", "pointclickcaresystems", "pointclickcaresoftware",
                           "pointclickcarelabs", "pointclickcarehealth", "pcc"]),
    (B, "acme-hq", ["acmehq", "acme-hqinc", "acme-hqhq", "acme-hqcareers", "acme-hqsoftware", "acme-"]),
    (B, "guidewiresoftware", ["guidewiresoftwareinc", "guidewiresoftwarehq", "guidewiresoftwarecareers",
                              "guidewiresoftwaresoftware", "guidewire"]),
    (B, "inc", ["incinc", "inchq", "inccareers", "incsoftware"]),
    (C, "bentleysystems", ["bentleysystemsinc", "bentleysystemscorp", "bentleysystemsllc", "bentley", "bentleysystemscareers"]),
])
def test_slug_variants(one, ats, slug, expected):
    assert one(lambda c: slug_variants(c, ats), slug) == expected


@pytest.fixture(scope="module")
def probes(spark):
    jobs = '{"jobs": [{}, {}]}'
    return spark.createDataFrame([
        (A, "ok", 200, jobs, None), (A, "empty", 200, "{}", None), (A, "fixinc", 200, jobs, None), (A, "fixlabs", 200, jobs, None),
        (A, "gone", 404, "", None), (A, "ok", 500, None, None), (A, "html", 200, "<html>", None), (A, "list", 200, "[]", None),
        (B, "ok", 200, "[{}]", None), (B, "object", 200, '{"data": [{}]}', None), (B, "objecthq", 200, "[]", None),
    ], sc.PROBES_SCHEMA)


def test_probe_counts(probes, collect):
    assert collect(rg.probe_counts(probes)) == sorted([
        (A, "ok", 2), (A, "empty", 0), (A, "fixinc", 2), (A, "fixlabs", 2), (A, "gone", None), (A, "html", None), (A, "list", None),
        (B, "ok", 1), (B, "object", None), (B, "objecthq", 0)], key=repr)


def test_validation(spark, probes, collect, tmp_path):
    registry = spark.createDataFrame([
        (A, "ok", "", 0), (A, "empty", "", 1), (A, "fix", "", 2), (A, "gone", "", 3), (A, "html", "", 4),
        (B, "ok", "", 5), (B, "object", "", 6), (B, "my-board", "", 7), (C, "tenant", "ext", 8),
    ], sc.REGISTRY_SCHEMA)
    result = plan.validate(registry, probes)
    assert collect(result.outcome, "position", "status", "fixed", "jobs") == [
        (0, "ok", None, 2), (1, "ok", None, 0), (2, "fixed", "fixinc", 2), (3, "failed", None, None), (4, "failed", None, None),
        (5, "ok", None, 1), (6, "fixed", "objecthq", 0), (7, "failed", None, None), (8, "skipped", None, None)]
    assert collect(result.counts) == sorted([(A, 2, 1, 2, 0), (B, 1, 1, 1, 0), (C, 0, 0, 0, 1)])
    assert collect(result.needs_update) == [(True,)]
    assert collect(result.registry, "position", "slug", "was") == [
        (0, "ok", None), (1, "empty", None), (2, "fixinc", "fix"), (5, "ok", None), (6, "objecthq", "object"), (8, "tenant", None)]
    assert ("My-Board", B, "my-board", "https://jobs.lever.co/my-board", "my-board: check https://jobs.lever.co/my-board") in collect(
        result.unconfirmed, "name", "ats", "slug", "check_url", "line")
    kept, failed = plan.write_validation(result, str(tmp_path))
    plan.write_validation(result, str(tmp_path))          # a snapshot replaces the one before
    assert spark.read.parquet(kept).count() == 6 and spark.read.parquet(failed).count() == 3


def test_nothing_to_update(spark, probes, collect):
    registry = spark.createDataFrame([(A, "ok", "", 0)], sc.REGISTRY_SCHEMA)
    assert collect(plan.validate(registry, probes, save=False).needs_update) == [(False,)]


def test_discovery(spark, collect, tmp_path):
    candidates = spark.createDataFrame([
        ("First", 0, ["a1", "a2"]), ("Second", 1, ["b1", "b2"]), ("Late", 2, ["c1", "c2"]), ("Epic Systems", 3, ["d1"]),
        ("Nobody", 4, ["e1"]), ("Limited", 5, ["f1"]), ("Zero", 6, ["g1"]), ("Html", 7, ["h1"]),
    ], sc.CANDIDATES_SCHEMA)
    probes = spark.createDataFrame([
        (A, "a1", 200, '{"jobs": [{}]}', None), (A, "a2", None, None, "never reached"), (A, "b1", 404, None, None),
        (A, "b2", 200, '{"jobs": [{}, {}]}', None), (A, "c1", None, None, "Read Timeout"), (A, "c2", 200, "{}", None),
        (A, "d1", 404, None, None), (A, "e1", None, None, "x" * 80), (A, "f1", 429, None, None), (A, "g1", 200, '{"jobs": []}', None),
        (B, "e1", 200, "[]", None), (A, "h1", 200, "<html>", None),
    ], sc.PROBES_SCHEMA)
    result = plan.discover(candidates, probes)
    assert collect(result.confirmed, "company_pos", "slug", "jobs", "url") == [
        (0, "a1", 1, "https://boards-api.greenhouse.io/v1/boards/a1/jobs"), (1, "b2", 2, "https://boards-api.greenhouse.io/v1/boards/b2/jobs"),
        (2, "c2", 0, "https://boards-api.greenhouse.io/v1/boards/c2/jobs"), (6, "g1", 0, "https://boards-api.greenhouse.io/v1/boards/g1/jobs")]
    assert collect(result.not_found, "company") == [("Epic Systems",), ("Html",), ("Limited",), ("Nobody",)]
    assert collect(result.errors, "kind", "message") == sorted([
        ("error", "Late (c1): timeout"), ("error", f"Nobody (e1): {'x' * 80}"), ("status", "Limited (f1): HTTP 429"),
        ("error", "Html (h1): unreadable answer")], key=repr)
    assert collect(result.totals) == [(4, 4, 3)]
    assert collect(result.by_category, "category", "company") == [("WORKDAY", "Epic Systems")]
    assert collect(result.uncategorised, "company") == [("Html",), ("Limited",), ("Nobody",)]
    assert collect(result.lines, "line")[0] == ('"a1",  # First (1 jobs)',)
    written = spark.read.parquet(plan.write_discovery(result, str(tmp_path)))
    assert collect(written, "position", "slug", "company", "jobs") == [
        (0, "a1", "First", 1), (1, "b2", "Second", 2), (2, "c2", "Late", 0), (6, "g1", "Zero", 0)]
