"""Schemas of landed inputs and of the canonical posting row."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

# Source order is explicit: position of the source, of the board or document in
# it, and of the item in that.  The three columns are unique per posting.
ORDER_COLUMNS = ("source_rank", "board_rank", "item_pos")

POSTING_SCHEMA = (
    "company STRING, role STRING, location STRING, url STRING, posted STRING, "
    "description STRING, source STRING, source_rank INT, board_rank BIGINT, item_pos BIGINT"
)
POSTING_COLUMNS = (
    "company", "role", "location", "url", "posted", "description", "source",
) + ORDER_COLUMNS
TEXT_COLUMNS = POSTING_COLUMNS[:7]

SOURCES_SCHEMA = (
    "source STRING, kind STRING, format STRING, key STRING, board STRING, source_rank INT"
)
RAW_DOCS_SCHEMA = "source STRING, doc_no BIGINT, content STRING"
PAYLOADS_SCHEMA = "slug STRING, board_rank BIGINT, payload STRING"
CAPTURED_SCHEMA = "tenant STRING, board STRING, board_rank BIGINT, seq INT, payload STRING"
HOST_PROBES_SCHEMA = "tenant STRING, n INT, ok BOOLEAN"
PAGES_SCHEMA = "url STRING, html STRING, rendered_html STRING"
CANDIDATES_SCHEMA = "company STRING, company_pos INT, slugs ARRAY<STRING>"
PROBES_SCHEMA = "ats STRING, slug STRING, http_status INT, payload STRING, error STRING"
REGISTRY_SCHEMA = "ats STRING, slug STRING, board STRING, position INT"
CATEGORIES_SCHEMA = "category STRING, category_rank INT, company STRING"
COMPANY_RULES_SCHEMA = "company_lower STRING, title_contains STRING, cap INT, flag STRING"
#: Names of places; ``ending`` ones (codes of states) count only as the last part of a location.
PLACES_SCHEMA = "name STRING, abroad BOOLEAN, ending BOOLEAN"
#: One row per keyword; the other columns are those of the keyword's rule.
RULES_SCHEMA = (
    "rule_id STRING, rule_order INT, kind STRING, scope STRING, match STRING, keyword STRING, value INT, flag STRING, "
    "unless ARRAY<STRING>, unless_pattern STRING"
)
COMPANY_ATTRS_SCHEMA = (
    "company_lower STRING, size_class STRING, is_tech BOOLEAN, is_sponsor BOOLEAN, is_known BOOLEAN"
)

BOARD_A_PAYLOAD = (
    "jobs: ARRAY<STRUCT<title: STRING, content: STRING, company_name: STRING, "
    "location: STRUCT<name: STRING>, absolute_url: STRING, updated_at: STRING>>"
)
BOARD_B_POSTINGS = (
    "ARRAY<STRUCT<text: STRING, company: STRING, categories: STRUCT<location: STRING>, "
    "createdAt: BIGINT, descriptionPlain: STRING, description: STRING, hostedUrl: STRING>>"
)
BOARD_C_PAYLOAD = (
    "jobPostings: ARRAY<STRUCT<title: STRING, externalPath: STRING, locationsText: STRING>>"
)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Settings as a local relation: Spark knows its exact size when it plans joins."""
    fields = DataType.fromDDL(schema).fields
    columns = {f.name: pa.array([row[i] for row in rows]) for i, f in enumerate(fields)}
    table = spark.createDataFrame(pa.table(columns))
    return table.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def each_item(df: DataFrame, keep: Sequence[str], array: Column, position: str, item: str) -> DataFrame:
    """One row per array item with its position, building the array only once.

    A plain ``posexplode`` lets the optimizer add a "size > 0" filter below it,
    which computes an array that is not a stored column a second time.
    """
    items = df.select(*keep, F.posexplode_outer(array).alias(position, item))
    return items.filter(F.col(position).isNotNull())


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later filters can test without computing them again.

    The optimizer moves a filter below a projection by copying what it tests,
    so costly expressions would run once per filter and once more for output.
    It does not move a filter below a generator; this one makes one row of one.
    """
    record = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline_outer(F.array(record)))


def canonical(df: DataFrame) -> DataFrame:
    """Project to the posting schema: absent or null text becomes ''."""
    present = set(df.columns)
    texts = [
        text_or_empty(F.col(c)).alias(c) if c in present else F.lit("").alias(c)
        for c in TEXT_COLUMNS
    ]
    order = [
        F.col("source_rank").cast("int").alias("source_rank"),
        F.col("board_rank").cast("bigint").alias("board_rank"),
        F.col("item_pos").cast("bigint").alias("item_pos"),
    ]
    return df.select(*texts, *order)
