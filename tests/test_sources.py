import json

from pyspark.sql import functions as F

from rankfold import schema as sc
from rankfold.config import SearchConfig
from rankfold.sources import boards, lists
from rankfold.sources.landed import default_registry, default_sources, empty_landed, read_landed, read_list_documents

MARKDOWN = """# Jobs
| Company | Role | Location | Apply | Age |
| --- | --- | --- | --- | --- |
| **[Acme](https://acme.example)** | Software Engineer | Austin, TX | <a href="https://jobs.acme.example/1">Apply</a> | 0d |
| Beta :rocket: | Backend Developer | | [Apply](https://beta.example/x) | 5h |
| Closed Co | Engineer | NYC | closed | 1d |
 | Indented | Engineer | NYC | [a](https://i.example) | 1d |
| OnlyTwo | [a](https://t.example) |
| Company | Role | NYC | [a](https://h.example) | 1d |
"""
HTML = (
    "<table><tr><th>Company</th><th>Role</th><th>Where</th></tr>"
    '<tr><td>Acme</td><td>Engineer</td><td>NYC</td><td><a href="https://x.example/a?b=1&amp;c=2">Apply</a></td><td>Jun 30</td></tr>'
    '<tr><td>two</td><td><a href="https://y.example">b</a></td></tr>'
    '<tr><td>Gamma</td><td>Dev</td><td><a href="https://github.com/g">src</a><a href="https://g.example/apply">go</a></td></tr></table>'
)
SOURCES = [("md", "list", "markdown-html", "", "", 0), ("html", "list", "html-table", "", "", 1), ("other", "board_a", None, "", "", 2)]


def test_list_postings(spark, collect):
    docs = spark.createDataFrame([("md", 0, MARKDOWN), ("html", 0, HTML), ("html", 1, ""), ("unknown", 0, MARKDOWN)], sc.RAW_DOCS_SCHEMA)
    found = lists.list_postings(docs, spark.createDataFrame(SOURCES, sc.SOURCES_SCHEMA))
    assert found.schema.simpleString() == spark.createDataFrame([], sc.POSTING_SCHEMA).schema.simpleString()
    assert collect(found, "source", "company", "role", "location", "url", "posted", "description", "source_rank", "board_rank", "item_pos") == sorted([
        ("md", "Acme", "Software Engineer", "Austin, TX", "https://jobs.acme.example/1", "0d", "", 0, 0, 3),
        ("md", "Beta", "Backend Developer", "Apply", "https://beta.example/x", "5h", "", 0, 0, 4),
        ("html", "Acme", "Engineer", "NYC", "https://x.example/a?b=1&c=2", "Jun 30", "", 1, 0, 1),
        ("html", "Gamma", "Dev", "srcgo", "https://g.example/apply", "", "", 1, 0, 3),
    ], key=repr)


def test_keep_empty_cells(spark, collect):
    docs = spark.createDataFrame([("md", 0, MARKDOWN)], sc.RAW_DOCS_SCHEMA)
    found = lists.list_postings(docs, spark.createDataFrame(SOURCES, sc.SOURCES_SCHEMA), keep_empty_cells=True)
    assert ("Beta", "", "5h") in collect(found, "company", "location", "posted")


def test_a_table_line_is_split_once(spark):
    docs = spark.createDataFrame([("md", 0, MARKDOWN)], sc.RAW_DOCS_SCHEMA)
    plan = lists.markdown_postings(docs, ("source",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(r"split(line") == 1


def test_board_a(spark, collect):
    payload = json.dumps({"jobs": [
        {"title": "Software Engineer", "content": "&lt;p&gt;C# &amp;amp; more&lt;/p&gt;", "company_name": "Acme",
         "location": {"name": "NYC"}, "absolute_url": "https://a.example/1", "updated_at": "2026-06-30T00:00:00Z"},
        {"title": "Senior Manager", "content": "x"},
        {"title": "Developer", "content": None, "location": None, "company_name": None},
        {"title": None},
    ]})
    landed = spark.createDataFrame(
        [("acme", 0, payload), ("none", 1, "{}"), ("bad", 2, "<html>"), ("cut", 3, payload[:-3]), ("list", 4, "[]"),
         ("more", 5, payload + " trailing"), ("null", 6, None)], sc.PAYLOADS_SCHEMA)
    found = boards.board_a_postings(landed, 5)
    assert collect(found, "company", "role", "location", "url", "posted", "description", "source", "board_rank", "item_pos") == sorted([
        ("Acme", "Software Engineer", "NYC", "https://a.example/1", "2026-06-30T00:00:00Z", "C# & more", "greenhouse", 0, 0),
        ("acme", "Developer", "", "", "", "", "greenhouse", 0, 2),
    ], key=repr)


def test_description_limit_is_a_setting(spark):
    payload = json.dumps({"jobs": [{"title": "Developer", "content": "x" * 9000}]})
    landed = spark.createDataFrame([("a", 0, payload)], sc.PAYLOADS_SCHEMA)
    length = lambda c: boards.board_a_postings(landed, 0, c).select(F.length("description")).head()[0]
    assert length(SearchConfig().published_limits()) == 8000 and length(SearchConfig()) == 9000


def test_board_b(spark, collect):
    jobs = [
        {"text": "Software Engineer", "categories": {"location": "Remote"}, "createdAt": 1704067207179,
         "descriptionPlain": "plain", "description": "<p>html</p>", "hostedUrl": "https://b.example/1"},
        {"text": "Developer", "createdAt": 0, "descriptionPlain": "", "description": "<p>from <b>html</b></p>", "company": "Named"},
        {"text": "Designer"},
    ]
    landed = spark.createDataFrame(
        [("point-click", 0, json.dumps(jobs)), ("wrapped", 1, json.dumps({"data": jobs[1:2]})), ("object", 2, '{"x": 1}'),
         ("bad", 3, "oops"), ("empty", 4, "[]"), ("number", 5, "7")], sc.PAYLOADS_SCHEMA)
    found = boards.board_b_postings(landed, 6)
    assert collect(found, "company", "role", "location", "url", "posted", "description", "board_rank", "item_pos") == sorted([
        ("Point-Click", "Software Engineer", "Remote", "https://b.example/1", "2024-01-01T00:00:07.179000+00:00", "plain", 0, 0),
        ("Named", "Developer", "", "", "", "from\nhtml", 0, 1),
        ("Named", "Developer", "", "", "", "from\nhtml", 1, 0),
    ], key=repr)


def test_board_c(spark, collect):
    page = lambda *titles: json.dumps({"jobPostings": [
        {"title": t, "externalPath": p, "locationsText": "Seattle"} for t, p in titles]})
    captured = spark.createDataFrame([
        ("acme", "ext", 0, 0, page(("Software Engineer", "path/1"), ("Director", "path/2"))),
        ("acme", "ext", 0, 1, page(("Developer", ""))), ("lost", "ext", 1, 0, page(("Developer", "p"))),
        ("acme", "ext", 0, 2, "broken"),
    ], sc.CAPTURED_SCHEMA)
    hosts = spark.createDataFrame([("acme", 1, False), ("acme", 5, True), ("acme", 3, True), ("lost", 1, False)], sc.HOST_PROBES_SCHEMA)
    found = boards.board_c_postings(captured, hosts, 7)
    assert collect(found, "company", "role", "location", "url", "posted", "description", "item_pos") == sorted([
        ("Acme", "Software Engineer", "Seattle", "https://acme.wd3.myworkdayjobs.com/ext/job/path/1", "", "", 0),
        ("Acme", "Developer", "Seattle", "", "", "", 1 << 32),
    ], key=repr)


def test_title_gate_runs_before_html_parsing(spark):
    landed = spark.createDataFrame([("a", 0, "{}")], sc.PAYLOADS_SCHEMA)
    plan = boards.board_a_postings(landed, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Contains(lower")   # the filter is below
    assert plan.count("from_json") == 1


def test_landed_readers(spark, tmp_path, collect):
    path = str(tmp_path / "probes")
    spark.createDataFrame([("greenhouse", "a", 200, "{}", None)], sc.PROBES_SCHEMA).write.json(path)
    assert collect(read_landed(spark, "probes", path, "json")) == [("greenhouse", "a", 200, "{}", None)]
    folder = tmp_path / "docs" / "source=md" / "doc_no=3"
    folder.mkdir(parents=True)
    (folder / "list.md").write_text("| a |\n| b |\n")
    assert collect(read_list_documents(spark, str(tmp_path / "docs"))) == [("md", 3, "| a |\n| b |\n")]
    assert empty_landed(spark, "pages").columns == ["url", "html", "rendered_html"]


def test_configured_sources_and_boards(spark, collect):
    assert collect(default_sources(spark), "source_rank", "format") == [
        (0, "markdown-html"), (1, "html-table"), (2, "markdown-html"), (3, "markdown-html")]
    assert collect(default_registry(spark).groupBy("ats").count()) == [("greenhouse", 3), ("lever", 1), ("workday", 4)]
