import pytest

from rankfold.functions import text as tx


def test_strip_removes_every_unicode_blank(many):
    values = [" a ", " 　a\t\n", "\x1ca\x85", "  ", "a b"]
    assert many(tx.strip_space, values) == [v.strip() for v in values]


def test_split_lines_agrees_with_python(many):
    values = ["a\r\nb\rc\nd", "a\x0bb\x0cc", "a\x1cb\x1dc\x1ed\x85e f g"]
    assert many(tx.split_lines, values) == [v.splitlines() for v in values]


def test_urls_href_first_then_markdown(many):
    values = [
        "[m](https://m.example/1) <a href=\"https://h.example/1\">x</a> <a href='http://h.example/2'>",
        "[![img](https://img.example/i.png)](https://outer.example)",
        "<a href=https://bare.example/x>y</a> [no](ftp://x)", "none",
    ]
    assert many(tx.extract_urls, values) == [
        ["https://h.example/1", "http://h.example/2", "https://m.example/1"],
        ["https://img.example/i.png"], ["https://bare.example/x"], [],
    ]


@pytest.mark.parametrize("urls, expected", [
    (["https://a.example", "https://JOBS.b.example/1"], "https://JOBS.b.example/1"),
    (["https://github.com/a", "https://c.example"], "https://c.example"),
    (["https://github.com/a", "https://simplify.jobs/c/x"], "https://simplify.jobs/c/x"),
    (["https://github.com/a", "https://github.com/b"], "https://github.com/b"),
    (["https://simplify.jobs/c/x", "https://simplify.jobs/p/y"], "https://simplify.jobs/p/y"),
    ([], ""),
])
def test_pick_url_tiers(one, urls, expected):
    assert one(tx.pick_url, urls, schema="array<string>") == expected


def test_clean_cell(many):
    values = [
        '**[Acme](https://acme.example)**', 'Beta :rocket: ', '<a href="x">Go\nnow</a>', '<strong>A</strong><br/>B',
        "*it* and **bo** :Up: :a_b:", " x ", None,
    ]
    assert many(tx.clean_cell, values) == ["Acme", "Beta", "Go\nnow", "AB", "it and bo :Up:", "x", ""]


def test_title_class(many):
    titles = [
        "Software Engineer II", "Senior Software Engineer", "Staff Engineer", "Engineering Director",
        "Factory Software Engineer", "Designer, Mobile", "Portfolios Associate", "Engineering VP",
        "VP Engineering", "Accountant", "", None,
    ]
    assert many(tx.title_class, titles) == [
        True, True, False, False, False, False, True, True, False, False, False, False]


def test_title_class_by_word(many):
    by_word = lambda c: tx.title_class(c, match="word")
    assert many(by_word, ["Factory Software Engineer", "Portfolios Associate", "CTO Engineer"]) == [True, False, False]


def test_signal_looks_at_title_and_description(spark):
    df = spark.createDataFrame(
        [("C# dev", ""), ("dev", "we use .NET"), ("dev", None), ("delinquent", "x"), (None, "BLAZOR")], "t string, d string")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(tx.has_signal(F.col("t"), F.col("d"))).collect()] == [True, True, False, True, True]


def test_title_case_like_python(many):
    slugs = ["point-click", "abc1def", "o'neil", "two words", "x"]
    assert many(tx.title_case, slugs) == [s.title() for s in slugs]


def test_shell_and_thin_page(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("x" * 199, "__NEXT_DATA__"), ("x" * 200, "__NEXT_DATA__"), ("x", "__next_data__")], "t string, h string")
    got = df.select(tx.is_thin_page(F.col("t"), F.col("h")), tx.looks_like_shell(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, False)]


def test_cut_counts_characters(one):
    assert one(lambda c: tx.cut(c, 3), "äöüß") == "äöü"
    assert one(lambda c: tx.cut(c, None), "äöüß") == "äöüß"


def test_long_word_lists_stay_shallow(one):
    words = [f"word{i}" for i in range(3000)] + ["needle"]
    assert one(lambda c: tx.contains_any(c, words), "a needle here") is True
    assert one(lambda c: tx.contains_any(c, ()), "x") is False
