"""List sources: markdown pipe tables and HTML tables to posting rows.

Parsing is a narrow transformation.  A source may consist of any number of
documents, so one that holds much of the data is still spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankfold import fixed_values as fv
from rankfold.functions import text as tx
from rankfold.functions.html import html_rows
from rankfold.schema import canonical, compute_once, each_item

HTML_TABLE = "html-table"
_KEYS = ("source", "source_rank", "doc_no")


def split_cells(line: Column, keep_empty: bool = False) -> Column:
    """Stripped cells of a pipe-table line; empty ones are dropped unless kept."""
    cells = F.transform(F.split(line, r"\|"), tx.strip_space)
    if keep_empty:   # the line starts (and usually ends) with a pipe: not cells
        inner = F.slice(cells, F.lit(2), F.size(cells))
        return F.when(F.element_at(inner, -1) == "", F.slice(inner, F.lit(1), F.size(inner) - 1)).otherwise(inner)
    return F.filter(cells, lambda c: c != "")


def table_lines(documents: DataFrame, content: str = "content") -> DataFrame:
    """Rows of pipe tables in documents: adds item_pos (line number) and line."""
    others = [c for c in documents.columns if c != content]
    lines = each_item(
        documents.filter(F.col(content) != ""), others, tx.split_lines(F.col(content)), "item_pos", "line"
    )
    return lines.filter(
        F.col("line").startswith("|") & ~F.rlike("line", F.lit(fv.TABLE_SEPARATOR_PATTERN))
    )


def _columns_to_postings(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Rows with ``cells`` and ``urls``: column rule, header rejection, link choice."""
    cells = F.col("cells")
    named = compute_once(
        rows.filter(F.size("urls") > 0),
        company=tx.clean_cell(F.get(cells, F.lit(0))), url=tx.pick_url(F.col("urls")),
    ).filter((F.col("url") != "") & ~F.lower("company").isin(*fv.TABLE_HEADER_CELLS))
    return named.select(
        *keep, "item_pos", "company",
        tx.clean_cell(F.get(cells, F.lit(1))).alias("role"),
        tx.clean_cell(F.get(cells, F.lit(2))).alias("location"),
        "url",
        F.when(F.size(cells) > 3, tx.clean_cell(F.element_at(cells, -1))).otherwise("").alias("posted"),
    )


def markdown_postings(documents: DataFrame, keep: tuple[str, ...] = _KEYS,
                      keep_empty_cells: bool = False) -> DataFrame:
    """Postings of pipe tables (columns company, role, location, ..., posted)."""
    lines = table_lines(documents.select(*keep, "content"))
    rows = compute_once(lines, cells=split_cells(F.col("line"), keep_empty_cells)).filter(F.size("cells") >= 3)
    links = F.flatten(F.transform("cells", lambda c: tx.extract_urls(c)))
    return _columns_to_postings(compute_once(rows, urls=links), keep)


def html_postings(documents: DataFrame, keep: tuple[str, ...] = _KEYS) -> DataFrame:
    """Postings of HTML tables; links are taken from the whole row."""
    rows = html_rows(documents.filter(F.col("content") != ""), "content", keep)
    return _columns_to_postings(compute_once(rows, urls=tx.extract_urls(F.col("markup"))), keep)


def list_postings(raw_docs: DataFrame, sources: DataFrame, keep_empty_cells: bool = False) -> DataFrame:
    """All list sources, each parsed by its format, in the posting schema.

    ``sources`` has one row per configured source; it joins without a hint, so
    Spark broadcasts it only while its measured size is under the threshold.
    """
    listed = sources.filter(F.col("kind") == "list").select("source", "source_rank", "format")
    documents = raw_docs.filter(F.col("content") != "").join(listed, "source")
    is_html = F.coalesce(F.col("format") == HTML_TABLE, F.lit(False))
    parsed = markdown_postings(documents.filter(~is_html), keep_empty_cells=keep_empty_cells).unionByName(
        html_postings(documents.filter(is_html))
    )
    return canonical(parsed.withColumnRenamed("doc_no", "board_rank"))
