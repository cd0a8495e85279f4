from pyspark.sql import functions as F

from rankfold.functions import html as hm

PAGES = [
    ("<p>a</p><p>b &amp; c</p>", "a\nb & c"),
    ("<nav>menu <b>x</b></nav><p>a</p><script>var t='</p>';</script><style>p{}</style>", "a"),
    ("<header>h</header><main>m</main><footer>f</footer><aside>s</aside>", "m"),
    ("a<!-- c -->b", "a\nb"),
    ("  line one \n\n  line two  ", "line one\nline two"),
    ("<p>un<b>closed<p>again", "un\nclosed\nagain"),
    ("<nav>never closed <p>hidden</p>", ""),
    ("x</nav>y", "x\ny"),
    ("a<br>b<br/>c", "a\nb\nc"),
    ("<template>t</template><ruby>k<rt>r</rt></ruby>", "k"),
    ("<title>T</title>A&nbsp;&#65;&#x42;&unknown;", "T\nA AB&unknown;"),
    ("", ""),
]


def test_visible_text():
    for markup, expected in PAGES[:-2]:
        assert hm.visible_text(markup) == expected, markup
    assert hm.visible_text("<title>T</title>A&nbsp;&#65;&#x42;") == "T\nA AB"


def test_html_to_text_column(many):
    assert many(hm.html_to_text, [p[0] for p in PAGES[:4]] + [None]) == [p[1] for p in PAGES[:4]] + [None]


def test_escaped_markup_is_resolved_first(many):
    escaped = lambda c: hm.html_to_text(c, escaped=True)
    assert many(escaped, ["&lt;p&gt;a &amp;amp; b&lt;/p&gt;"]) == ["a & b"]


def test_filter_on_text_parses_once(spark):
    df = spark.createDataFrame([("<p>x</p>",)], "h string").select(hm.html_to_text(F.col("h")).alias("t")).filter("t = 'x'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert df.count() == 1


def test_table_rows():
    markup = (
        "<table><tr><th>Company</th></tr>"
        '<tr><td>Acme</td><td>En<b>gin</b>eer</td><td>NYC</td><td><a HREF="https://x.example/a?b=1&amp;c=2">Apply</a></td></tr>'
        "<tr><td>a</td><td>b</td></tr></table>"
    )
    assert list(hm.table_rows(markup)) == [(
        1, ["Acme", "Engineer", "NYC", "Apply"],
        '<tr><td>Acme</td><td>En<b>gin</b>eer</td><td>NYC</td><td><a href="https://x.example/a?b=1&c=2">Apply</a></td>',
    )]


def test_nested_tables_give_inner_cells_to_both_rows():
    markup = "<tr><td>1</td><td>2<table><tr><td>x</td><td>y</td><td>z</td></tr></table></td><td>3</td></tr>"
    found = list(hm.table_rows(markup))
    assert [(p, c) for p, c, _ in found] == [(0, ["1", "2xyz", "x", "y", "z", "3"]), (1, ["x", "y", "z"])]


def test_unclosed_row_runs_to_the_end():
    assert [c for _, c, _ in hm.table_rows("<tr><td>a<td>b<td>c")] == [["abc", "bc", "c"]]


def test_html_rows_keeps_columns_and_splits_output(spark, collect):
    body = "<table>" + "".join(f"<tr><td>{i}</td><td>b</td><td>c</td></tr>" for i in range(25)) + "</table>"
    df = spark.createDataFrame([("s", 7, body), ("t", 8, None)], "source string, doc_no bigint, content string")
    out = hm.html_rows(df, keep=("source", "doc_no"), chunk_rows=10, chunk_chars=200)
    assert out.columns == ["source", "doc_no", "item_pos", "cells", "markup"]
    assert [r[2] for r in collect(out.orderBy("item_pos"), "source", "doc_no", "item_pos")] == sorted(range(25), key=str)


def test_implied_end_tags():
    rows = lambda markup: [(c, m) for _, c, m in hm.table_rows(markup, implied=True)]
    open_rows = "<table><thead><tr><th>Company<tbody><tr><td>Acme<td><p>En<b>gin</b>eer<p>II<td>NYC<tr><td>B<td>C<td>D</table><p>after"
    assert [c for c, _ in rows(open_rows)] == [["Acme", "EngineerII", "NYC"], ["B", "C", "D"]]
    assert rows(open_rows)[1][1] == "<tr><td>B</td><td>C</td><td>D</td>"
    # an inner table's rows end neither the outer row nor its cells
    nested = "<tr><td>1<td>2<table><tr><td>x<td>y<td>z<tr><td>u<td>v<td>w</table><td>3<tr><td>a<td>b<td>c"
    assert [c for c, _ in rows(nested)] == [["1", "2xyzuvw", "x", "y", "z", "u", "v", "w", "3"], ["x", "y", "z"], ["u", "v", "w"], ["a", "b", "c"]]
    # an end tag inside an inner table does not reach out of it
    assert [c for c, _ in rows("<tr><td>1<td><table><tr></td><td>x</table>2<td>3</tr>")] == [["1", "x2", "x", "3"]]
    lists = "<tr><td><ul><li>one<li>two<ul><li>three</ul><li>four</ul><td>b<td>c"
    assert rows(lists) == [(["onetwothreefour", "b", "c"],
                            "<tr><td><ul><li>one</li><li>two<ul><li>three</li></ul></li><li>four</li></ul></td><td>b</td><td>c")]


def test_both_ways_agree_on_closed_markup():
    import random

    rng = random.Random(1)

    def cell(depth):
        inner = rng.choice(["x", "<b>y</b>", "<ul><li>1</li><li>2</li></ul>", "<p>p</p>", "<a href='u'>l</a>", "<!-- c -->", "<script>s</script>"])
        return f"<td>{table(depth + 1) if depth < 2 and rng.random() < 0.2 else inner}</td>"

    def table(depth):
        return "<table>" + "".join(f"<tr>{''.join(cell(depth) for _ in range(rng.randrange(1, 5)))}</tr>" for _ in range(rng.randrange(1, 4))) + "</table>"

    for _ in range(300):
        markup = table(0)
        assert list(hm.table_rows(markup)) == list(hm.table_rows(markup, implied=True))


def test_open_rows_take_linear_time(spark):
    import time

    start = time.perf_counter()
    found = list(hm.table_rows("<table>" + "<tr><td>a<td>b<td>c" * 100_000, implied=True))
    assert time.perf_counter() - start < 15   # nested reading is cubic: it would not end
    assert len(found) == 100_000 and all(c == ["a", "b", "c"] for _, c, _ in found)
    df = spark.createDataFrame([(1, "<tr><td>a<td>b<td>c" * 3000)], "doc_no int, content string")
    assert hm.html_rows(df, keep=("doc_no",)).count() == 3000
