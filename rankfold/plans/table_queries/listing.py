"""Table extraction and union: one small document per row of a given table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfold.functions.text import split_lines
from rankfold.operators import reports
from rankfold.operators.matching import fill_descriptions
from rankfold.config import SearchConfig
from rankfold.plans.table_queries.common import sql_contains_any, sql_visible_text, spread_table, table
from rankfold.schema import canonical
from rankfold.functions.text import has_signal
from rankfold.sources.lists import HTML_TABLE, html_postings, list_postings, markdown_postings

WORDS = ("trash", "idiot", "worthless")
LONG_TEXT = 1500


def _key(column: str):
    return F.col(column).cast("string")


def _part_documents(spark, sf):
    """A pipe table per part: one listing, and lines every rule has to reject."""
    content = F.concat(
        F.lit("# Open roles\n| Company | Role | Location | Apply | Age |\n| --- | :---: | --- | --- | --- |\n"),
        F.lit("| **["), "p_brand", F.lit("](https://brand.example/"), _key("p_partkey"),
        F.lit(")** | "), "p_name", F.lit(" :rocket: | "), "p_type",
        F.lit(' | <a href="https://jobs.example/'), _key("p_partkey"), F.lit('">Apply</a> | '),
        _key("p_size"), F.lit("d |\n"),
        F.lit("| Closed | "), "p_name", F.lit(" | nowhere | closed | 1d |\r\n"),
        F.lit(" | Indented | x | y | [a](https://i.example) |\n"),
        F.lit("| OnlyTwo | [a](https://t.example) |\n"),
        F.lit("| Short | "), "p_name", F.lit(" | | [Go](https://short.example/"), _key("p_partkey"), F.lit(") |\n"),
        F.lit("| Name | a | b | [c](https://n.example) |"),
    )
    part = spread_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return part.select(F.col("p_partkey").alias("doc_no"), content.alias("content"))


def line_table_parse(spark, sf):
    return markdown_postings(_part_documents(spark, sf), keep=("doc_no",))


def _customer_documents(spark, sf):
    """An HTML table per customer, with a header row and a short row."""
    content = F.concat(
        F.lit("<h1>Roles</h1><table><thead><tr><th>Company</th><th>Role</th><th>x</th></tr></thead><tbody>"),
        F.lit("<tr><td><b>"), "c_name", F.lit("</b></td><td>"), F.lower("c_mktsegment"),
        F.lit(" &amp; co</td><td>nation "), _key("c_nationkey"),
        F.lit('</td><td><a href="https://github.com/x"><img src="i.png"></a><a href="https://apply.example/'),
        _key("c_custkey"), F.lit('?a=1&amp;b=2">Apply</a></td><td>'), _key("c_nationkey"), F.lit("d</td></tr>"),
        F.lit('<tr><td>two</td><td><a href="https://two.example">x</a></td></tr>'),
        F.lit("<tr><td>nolink</td><td>b</td><td>c</td></tr>"),
        F.lit('<tr><td>three</td><td>b</td><td><a href="https://three.example/'), _key("c_custkey"),
        F.lit('">c</a></td></tr></tbody></table>'),
    )
    customer = spread_table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return customer.select(F.col("c_custkey").alias("doc_no"), content.alias("content"))


def html_rows(spark, sf):
    return html_postings(_customer_documents(spark, sf), keep=("doc_no",))


def list_inputs(spark, sf):
    """Landed documents of both list formats and their sources."""
    docs = _part_documents(spark, sf).withColumn("source", F.lit("pipes")).unionByName(
        _customer_documents(spark, sf).withColumn("source", F.lit("tables"))
    )
    region = table(spark, sf, "region").select("r_regionkey")
    sources = region.filter("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, "pipes").otherwise("tables").alias("source"),
        F.lit("list").alias("kind"),
        F.when(F.col("r_regionkey") == 0, "markdown-html").otherwise(HTML_TABLE).alias("format"),
        F.col("r_regionkey").alias("source_rank"),
    )
    return docs, sources


def list_scan(spark, sf):
    """Both list formats, dispatched by the configured format of their source."""
    found = list_postings(*list_inputs(spark, sf))
    return found.select("source", "source_rank", "board_rank", "item_pos", "company", "role", "location", "url", "posted")


def union_sources(spark, sf):
    docs = table(spark, sf, "documents").select(
        "source", F.lit(0).alias("source_rank"), F.lit(0).alias("board_rank"), F.col("doc_id").alias("item_pos"),
        F.col("lang").alias("location"), F.col("text").alias("description"),
    )
    pages = table(spark, sf, "pages").select(
        F.lit("pages").alias("source"), F.lit(1).alias("source_rank"), F.lit(0).alias("board_rank"),
        F.col("page_id").alias("item_pos"), "url", F.col("html").alias("description"),
    )
    talks = table(spark, sf, "conversations").select(
        F.lit("talks").alias("source"), F.lit(2).alias("source_rank"), F.col("turn").alias("board_rank"),
        F.col("conv_id").alias("item_pos"), "role", F.col("text").alias("description"),
    )
    union = canonical(docs).unionByName(canonical(pages)).unionByName(canonical(talks))
    return union.select(
        "source", "source_rank", "board_rank", "item_pos", "role", "location", "url", "posted",
        F.char_length("description").alias("body_len"),
    )


def description_fallback_join(spark, sf):
    """Documents that are short count as having no description and take a page's text."""
    link = F.concat(F.lit("https://x.example/"), _key("doc_id"))
    postings = table(spark, sf, "documents").select(
        "doc_id", link.alias("url"),
        F.when(F.col("n_chars") > LONG_TEXT, F.col("text")).otherwise("").alias("description"),
    )
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("https://x.example/"), _key("page_id")).alias("url"), "html",
        F.lit("").alias("rendered_html"),
    )
    filled = fill_descriptions(postings, pages, SearchConfig())
    return filled.select(
        "doc_id", F.char_length("description").alias("n_chars"), F.md5("description").alias("digest")
    )


def stage_counts(spark, sf):
    docs = spread_table(spark, sf, "documents", "source", "text", "n_chars")
    return reports.stage_counts(
        docs, "source", n_signal=has_signal(F.lit(""), F.col("text"), WORDS), n_long=F.col("n_chars") > LONG_TEXT
    )


def line_split(spark, sf):
    docs = spread_table(spark, sf, "documents", "doc_id", "text")
    return docs.select("doc_id", F.size(split_lines(F.col("text"))).alias("n_lines"))


QUERIES = {
    "line_table_parse": line_table_parse,
    "html_rows": html_rows,
    "list_scan": list_scan,
    "union_sources": union_sources,
    "description_fallback_join": description_fallback_join,
    "stage_counts": stage_counts,
    "line_split": line_split,
}

_PIPES = """
    SELECT p_partkey AS doc_no, 3 AS item_pos, p_brand AS company, p_name AS role, p_type AS location,
           'https://jobs.example/' || p_partkey AS url, p_size || 'd' AS posted FROM part
    UNION ALL
    SELECT p_partkey, 7, 'Short', p_name, 'Go', 'https://short.example/' || p_partkey, '' FROM part"""
_TABLES = """
    SELECT c_custkey AS doc_no, 1 AS item_pos, c_name AS company, lower(c_mktsegment) || ' & co' AS role,
           'nation ' || c_nationkey AS location, 'https://apply.example/' || c_custkey || '?a=1&b=2' AS url,
           c_nationkey || 'd' AS posted FROM customer
    UNION ALL
    SELECT c_custkey, 4, 'three', 'b', 'c', 'https://three.example/' || c_custkey, '' FROM customer"""

ORACLES = {
    "line_table_parse": f"SELECT doc_no, CAST(item_pos AS INTEGER) AS item_pos, company, role, location, url, posted FROM ({_PIPES})",
    "html_rows": f"SELECT doc_no, CAST(item_pos AS BIGINT) AS item_pos, company, role, location, url, posted FROM ({_TABLES})",
    "list_scan": f"""
        SELECT 'pipes' AS source, 0 AS source_rank, CAST(doc_no AS BIGINT) AS board_rank,
               CAST(item_pos AS BIGINT) AS item_pos, company, role, location, url, posted FROM ({_PIPES})
        UNION ALL
        SELECT 'tables', 1, CAST(doc_no AS BIGINT), CAST(item_pos AS BIGINT), company, role, location, url, posted
        FROM ({_TABLES})""",
    "union_sources": """
        SELECT source, 0 AS source_rank, CAST(0 AS BIGINT) AS board_rank, doc_id AS item_pos, '' AS role, lang AS location,
               '' AS url, '' AS posted, CAST(length(text) AS INTEGER) AS body_len FROM documents
        UNION ALL SELECT 'pages', 1, 0, page_id, '', '', url, '', CAST(length(html) AS INTEGER) FROM pages
        UNION ALL SELECT 'talks', 2, turn, conv_id, role, '', '', '', CAST(length(text) AS INTEGER)
        FROM conversations""",
    "description_fallback_join": f"""
        WITH texts AS (SELECT page_id, {sql_visible_text('html')} AS body FROM pages),
        filled AS (
            SELECT doc_id, CASE WHEN n_chars > {LONG_TEXT} AND text <> '' THEN text
                                ELSE coalesce(body, '') END AS description
            FROM documents LEFT JOIN texts ON page_id = doc_id)
        SELECT doc_id, CAST(length(description) AS INTEGER) AS n_chars, md5(description) AS digest FROM filled""",
    "stage_counts": f"""
        SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE {sql_contains_any('lower(text)', WORDS)}) AS n_signal,
               count(*) FILTER (WHERE n_chars > {LONG_TEXT}) AS n_long FROM documents GROUP BY source""",
    "line_split": r"""
        SELECT doc_id, CAST(len(regexp_split_to_array(text, '\r\n|[\n\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]')) AS INTEGER) AS n_lines
        FROM documents""",
}
